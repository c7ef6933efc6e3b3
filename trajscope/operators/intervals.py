"""Points in intervals: an equi-join by bins instead of all pairs of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "frame", start: str = "start", end: str = "end") -> DataFrame:
    """Rows of points joined to the spans of their key with start <= at < end (other columns of both; keys once).

    A key's bins are as wide as its mean span, so all spans together fall into
    at most three bins each on average, and a point into one: what is joined is points
    times the spans of a bin. The bins are part of the join's key, so the points
    of a long key go to many tasks.
    """
    keys = list(keys)
    some = spans.where(F.col(end) > F.col(start))
    width = some.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.avg(F.col(end) - F.col(start)))).alias("width_"))
    bins = F.sequence(F.floor(F.col(start) / F.col("width_")), F.floor((F.col(end) - 1) / F.col("width_")))
    binned = some.join(width, keys).withColumn("bin_", F.explode(bins)).drop("width_")
    placed = points.join(width, keys).withColumn("bin_", F.floor(F.col(at) / F.col("width_"))).drop("width_")
    return placed.join(binned, [*keys, "bin_"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bin_")
