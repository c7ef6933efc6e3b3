"""Order-dependent kernels on arrays, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<f:int,v:double>"


def drawdown(values: Column) -> Column:
    """Largest fall below the running maximum; 0 without one."""
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("down"))

    def step(a: Column, v: Column) -> Column:
        top = F.greatest(a["top"], v)
        return F.struct(top.alias("top"), F.greatest(a["down"], top - v).alias("down"))

    return F.aggregate(values, start, step, lambda a: a["down"])


def descents(curve: Column, threshold: Column) -> Column:
    """Descents (start, end, depth) of a curve array<struct<f,v>> by a zigzag of the given threshold.

    A plateau counts from its last point at the top and to its first at the
    bottom; what falls after the last peak counts even if it is below threshold.
    """
    p0 = F.get(curve, F.lit(0))
    none = F.lit(None).cast(POINT)
    found = F.expr("cast(array() as array<struct<start:int,end:int,depth:double>>)")
    descent = lambda peak, low: F.struct(peak["f"].alias("start"), low["f"].alias("end"), (peak["v"] - low["v"]).alias("depth"))
    state = lambda up, peak, low, out: F.struct(up.alias("up"), peak.alias("peak"), low.alias("low"), out.alias("out"))

    def step(a: Column, p: Column) -> Column:
        lower = F.when(a["low"].isNull() | (p["v"] < a["low"]["v"]), p).otherwise(a["low"])
        return (
            F.when(a["up"] & (p["v"] >= a["peak"]["v"]), state(F.lit(True), p, none, a["out"]))
            .when(a["up"], state((a["peak"]["v"] - p["v"]) < threshold, a["peak"], F.when((a["peak"]["v"] - p["v"]) >= threshold, p).otherwise(lower), a["out"]))
            .when(p["v"] < a["low"]["v"], state(F.lit(False), a["peak"], p, a["out"]))
            .when(p["v"] - a["low"]["v"] >= threshold, state(F.lit(True), p, none, F.concat(a["out"], F.array(descent(a["peak"], a["low"])))))
            .otherwise(a)
        )

    def finish(a: Column) -> Column:
        return F.when(a["low"].isNotNull() & (a["low"]["v"] < a["peak"]["v"]), F.concat(a["out"], F.array(descent(a["peak"], a["low"])))).otherwise(a["out"])

    rest = F.slice(curve, F.lit(2), F.greatest(F.size(curve) - 1, F.lit(0)))
    return F.when(F.size(curve) > 0, F.aggregate(rest, state(F.lit(True), p0, none, found), step, finish)).otherwise(found)


def steepest(found: Column) -> Column:
    """The deepest descent; of equals the shortest, then the earliest. Null without any."""
    ranked = F.array_min(F.transform(found, lambda d: F.struct((-d["depth"]).alias("a"), (d["end"] - d["start"]).alias("b"), d["start"].alias("c"), d.alias("d"))))
    return ranked["d"]


#: Numerators below this share of the denominator are what rounding leaves of nothing.
ROUNDING = 1e-12


def direction(values: Column, weights: Column) -> Column:
    """sum w_i w_j (v_j - v_i) / sum w_i w_j |v_j - v_i| over i < j; 0 for 0/0.

    Sums over pairs are folds over running sums: w_j (v_j W - S) with the weight W
    and the weighted sum S of those before. In the order of the values instead of
    the frames no difference is negative, which gives the denominator; so a stage of k
    frames takes k log k steps. Values count from the first, so equal ones differ by exactly 0.
    """
    both = F.transform(F.arrays_zip(values.alias("v"), weights.alias("w")), lambda x: F.struct((x["v"] - F.get(values, F.lit(0))).alias("v"), x["w"].alias("w")))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))

    def total(points: Column) -> Column:
        step = lambda a, x: F.struct((a["t"] + x["w"] * (x["v"] * a["w"] - a["s"])).alias("t"), (a["w"] + x["w"]).alias("w"), (a["s"] + x["w"] * x["v"]).alias("s"))
        return F.aggregate(points, zero, step, lambda a: a["t"])

    ratio = F.coalesce(F.try_divide(total(both), total(F.array_sort(both))), F.lit(0.0))
    return F.when(F.abs(ratio) < ROUNDING, 0.0).otherwise(ratio)


def rank_correlation(values: Column) -> Column:
    """Rank correlation of an array with its places, ties by their mean rank; null where all are equal. -0.0 equals 0.0.

    One fold over the sorted values: a run of equal ones adds its mean rank times
    the sum of its places when the next value begins.
    """
    placed = F.array_sort(F.transform(values, lambda v, i: F.struct((v.cast("double") + F.lit(0.0)).alias("v"), (i + 1).cast("double").alias("i"))))
    first = F.struct(*(F.lit(x).cast("double").alias(k) for k, x in (("v", None), ("n", 0.0), ("s", 0.0), ("done", 0.0), ("xy", 0.0), ("xx", 0.0))))

    def flushed(a: Column) -> tuple[Column, Column, Column]:
        rank = a["done"] + (a["n"] + 1) / 2
        return a["done"] + a["n"], a["xy"] + rank * a["s"], a["xx"] + rank * rank * a["n"]

    def step(a: Column, x: Column) -> Column:
        done, xy, xx = flushed(a)
        same = x["v"] == a["v"]
        go_on = F.struct(a["v"].alias("v"), (a["n"] + 1).alias("n"), (a["s"] + x["i"]).alias("s"), a["done"].alias("done"), a["xy"].alias("xy"), a["xx"].alias("xx"))
        begin = F.struct(x["v"].alias("v"), F.lit(1.0).alias("n"), x["i"].alias("s"), done.alias("done"), xy.alias("xy"), xx.alias("xx"))
        return F.when(same, go_on).otherwise(begin)

    def finish(a: Column) -> Column:
        n, xy, xx = flushed(a)
        sums, squares = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
        return F.try_divide(n * xy - sums * sums, F.sqrt((n * xx - sums * sums) * (n * squares - sums * sums)))

    return F.aggregate(placed, first, step, finish)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, clamped to [-1, 1]; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    ratio = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))


def softmax_progress(logits: Column) -> Column:
    """sum i * softmax(i) / (k - 1)."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return weighted / total / (F.size(logits) - 1)


def progress_fold(deltas: Column) -> Column:
    """v <- v + (1 - v) * delta, from 0."""
    return F.aggregate(deltas, F.lit(0.0), lambda v, d: v + (F.lit(1.0) - v) * d)


def signed_fold(deltas: Column) -> Column:
    """Gains close a share of what is left, losses take a share of what is there."""
    return F.aggregate(deltas, F.lit(0.0), lambda v, d: F.when(d >= 0, v + (F.lit(1.0) - v) * d).otherwise(v + v * d))
