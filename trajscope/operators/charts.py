"""Value curves as SVG text, one row per chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape

WIDTH, HEIGHT, PAD = 480, 160, 12


def _point(x: Column, y: Column) -> Column:
    """x,y with one decimal each: floor(10 v + 0.5) of the double, as SQL has it; a format alone rounds the shortest decimal."""
    tenth = lambda v: F.floor(v.cast("double") * 10 + 0.5).cast("double") / 10
    return F.format_string("%.1f,%.1f", tenth(x), tenth(y))


def polyline(values: Column) -> Column:
    """Points of a curve over the whole width; a constant curve lies in the middle."""
    low, high, n = F.array_min(values), F.array_max(values), F.size(values)
    share = lambda v: F.coalesce(F.try_divide(v - low, high - low), F.lit(0.5))
    x = lambda i: F.lit(PAD) + i * F.coalesce(F.try_divide(F.lit(float(WIDTH - 2 * PAD)), (n - 1).cast("double")), F.lit(0.0))
    y = lambda v: F.lit(HEIGHT - PAD) - share(v) * (HEIGHT - 2 * PAD)
    return F.array_join(F.transform(values, lambda v, i: _point(x(i), y(v))), " ")


def triangle(n: Column) -> Column:
    """The ideal cycle over n places as a polyline: up to the top in the middle and down again."""
    turn = F.greatest((n - 1) / 2, F.lit(0.5))
    x = lambda i: F.lit(PAD) + i * (F.lit(float(WIDTH - 2 * PAD)) / F.greatest(n - 1, F.lit(1)))
    y = lambda i: F.lit(HEIGHT - PAD) - F.least(i, n - 1 - i) / turn * (HEIGHT - 2 * PAD)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _point(x(i), y(i))), " ")


def cycle_target(position: Column, n_path: Column) -> Column:
    """The ideal triangle: up to 1 at the turn and down again."""
    turn = (n_path - 1) / 2
    return F.least(position, (n_path - 1) - position) / turn


def charts(curves: DataFrame, title: str = "episode", values: str = "values") -> DataFrame:
    """title and svg."""
    text = html_escape(F.col(title))
    svg = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}"><title>'), text, F.lit('</title><polyline fill="none" stroke="black" points="'), polyline(F.col(values)), F.lit('"/></svg>'))
    return curves.select(title, svg.alias("svg"))


def cycle_charts(curves: DataFrame, title: str = "episode", up: str = "up", down: str = "down") -> DataFrame:
    """title and svg of cycles: values on the way up and back as one line over the ideal triangle, the turn marked."""
    whole = F.concat(F.col(up), F.slice(F.col(down), F.lit(2), F.greatest(F.size(down) - 1, F.lit(0))))
    line = lambda points, style: F.concat(F.lit(f'<polyline fill="none" {style} points="'), points, F.lit('"/>'))
    middle = F.format_string("%.1f", F.lit(PAD) + (F.size(up) - 1) * (F.lit(float(WIDTH - 2 * PAD)) / F.greatest(F.size(whole) - 1, F.lit(1))))
    mark = F.concat(F.lit('<line stroke="grey" x1="'), middle, F.lit('" x2="'), middle, F.lit(f'" y1="{PAD}" y2="{HEIGHT - PAD}"/>'))
    head = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}"><title>'), html_escape(F.col(title)), F.lit("</title>"))
    svg = F.concat(head, mark, line(triangle(F.size(whole)), 'stroke="silver"'), line(polyline(whole), 'stroke="black"'), F.lit("</svg>"))
    return curves.select(title, svg.alias("svg"))


def selected(curves: DataFrame, score: str, most: int, keys: tuple[str, ...] = ("domain", "task")) -> DataFrame:
    """The `most` best and worst curves of each cell by score, with `place` (best or worst) and its number: a short selection for a sheet."""
    own = Window.partitionBy(*keys)
    first = curves.withColumn("number", F.row_number().over(own.orderBy(F.desc(score), "episode"))).where(F.col("number") <= most).withColumn("place", F.lit("best"))
    last = curves.withColumn("number", F.row_number().over(own.orderBy(score, "episode"))).where(F.col("number") <= most).withColumn("place", F.lit("worst"))
    return first.unionByName(last)


def sheet(curves: DataFrame, columns: int = 3, title: str = "episode", values: str = "values") -> str:
    """One SVG with the charts of a short selection in a grid, by title. The rows come to the driver, as the sheet does."""
    cells = []
    for k, r in enumerate(charts(curves, title, values).orderBy(title).collect()):
        x, y = k % columns * WIDTH, k // columns * HEIGHT
        cells.append(r["svg"].replace("<svg ", f'<svg x="{x}" y="{y}" width="{WIDTH}" height="{HEIGHT}" ', 1))
    rows = -(-len(cells) // columns)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {min(columns, max(1, len(cells))) * WIDTH} {rows * HEIGHT}">' + "".join(cells) + "</svg>"
