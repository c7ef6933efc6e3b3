"""Exact order statistics of cells of any size: a sketch brackets the wanted ranks, counts settle them.

A first pass keeps, for each cell, its count and for each wanted quantile two
values of a mergeable sketch (relative error 1 / ACCURACY) that lie certainly
below and above. A second counts what lies under each bracket, and how often each
value within occurs. What a task then orders is the values within one bracket,
10 / ACCURACY of a cell, so no task holds a cell; cells of up to
ACCURACY rows are taken whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Ranks of the sketch are off by 1 / ACCURACY at most, and a wanted rank differs from q * n by less than two.
MARGIN = 5 / ACCURACY


def _positions(method: str, q: float, n: Column) -> tuple[Column, Column, Column]:
    """Ranks (from 1) of the two order statistics and the share of the upper one."""
    if method == "nearest":
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * n)).cast("long")
        return rank, rank, F.lit(0.0)
    at = F.lit(q) * (n - 1)
    low = F.floor(at).cast("long")
    return low + 1, F.least(low + 2, n), at - low


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """keys and a column for each wanted name: (method, q), method `linear` (between neighbours) or `nearest` (sorted[max(0, ceil(q n) - 1)]).

    Null values count for nothing; a cell without values has no row.
    """
    keys, names = list(keys), list(wanted)
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v_"))
    sides = [x for name in names for x in (max(0.0, wanted[name][1] - MARGIN), min(1.0, wanted[name][1] + MARGIN))]
    sketch = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("v_", [float(s) for s in sides], ACCURACY).alias("sides_"))
    small = F.col("n_") <= ACCURACY
    bracket = lambda k: F.struct(F.lit(k).alias("k"), F.when(small, float("-inf")).otherwise(F.col("sides_")[2 * k]).alias("low"), F.when(small, float("inf")).otherwise(F.col("sides_")[2 * k + 1]).alias("high"))
    brackets = sketch.select(*keys, "n_", F.array(*(bracket(k) for k in range(len(names)))).alias("brackets_"))
    held = own.join(brackets.withColumnsRenamed({k: f"{k}_of" for k in keys}), [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
    # a row counts below a bracket under no value of its own (NULL), in it under its value; above, not at all
    reached = F.filter("brackets_", lambda b: (F.col("v_") <= b["high"]) | F.isnan("v_") & (b["high"] == float("inf")))
    hits = held.select(*keys, "n_", "v_", F.explode(reached).alias("b_"))
    counted = hits.groupBy(*keys, "n_", F.col("b_.k").alias("k_"), F.when(F.col("v_") >= F.col("b_.low"), F.col("v_")).alias("v_")).agg(F.count(F.lit(1)).alias("c_"))
    upto = Window.partitionBy(*keys, "k_").orderBy(F.col("v_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto_", F.sum("c_").over(upto)).where("v_ IS NOT NULL")
    out = []
    for k, name in enumerate(names):
        first, second, share = _positions(*wanted[name], F.col("n_"))
        at = lambda rank, k=k: F.max(F.when((F.col("k_") == k) & (F.col("upto_") >= rank) & (F.col("upto_") - F.col("c_") < rank), F.col("v_")))
        low, high = at(first), at(second)
        out.append((low + (high - low) * F.max(share) if wanted[name][0] == "linear" else low).alias(name))
    return placed.groupBy(*keys).agg(*out)


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(rows, keys, value, {name: ("linear", 0.5)})
