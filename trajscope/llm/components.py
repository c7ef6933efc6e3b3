"""Connected components by alternating large-star and small-star rounds, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of the edges (u, v); component is the smallest node reachable.

    Every step is a partial aggregate and a join that Spark may split; the edges
    of a node never meet in one list. Rounds grow with the logarithm of the size.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _signature(edges)
    if not last[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct(), "large")
        # small star: smaller neighbours and the node itself move to the smallest
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old, large, least)
        now = _signature(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
