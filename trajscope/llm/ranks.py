"""Positions in an order over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized

_ROW_BITS = 33  # monotonically_increasing_id puts the row within its partition there


def ranked(df: DataFrame, group: str, order: list[Column], tag: str) -> tuple[DataFrame, list[DataFrame]]:
    """df with `pos` (from 0, within `group`, by `order`) and `n` (rows of the group), and the tables to discard later.

    `order` should begin with the group. Rows go to range partitions, which are
    written sorted; counts of (group, partition), at most a row for each partition
    and each border of groups, give the offsets. Equal keys are dealt by a last
    key of their own, so many equal rows need not share a partition; among them
    positions are arbitrary.
    """
    salted = df.withColumn("tie_", F.monotonically_increasing_id())
    keys = [*order, F.col("tie_")]
    rows = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie_").withColumn("at_", F.monotonically_increasing_id())
    rows = materialize(rows, tag)
    rows = rows.withColumn("part_", F.shiftright("at_", _ROW_BITS))
    counts = materialize(rows.groupBy(group, "part_").agg(F.count(F.lit(1)).alias("c"), F.min("at_").alias("first_")), tag)
    w = Window.partitionBy(group)
    # a row for each partition that holds the group
    before = F.sum("c").over(w.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("g_"), F.col("part_").alias("p_"), "first_", F.coalesce(before, F.lit(0)).alias("before_"), F.sum("c").over(w).alias("n"))
    out = rows.join(sized(offsets), F.col(group).eqNullSafe(F.col("g_")) & (F.col("part_") == F.col("p_")))
    out = out.withColumn("pos", F.col("at_") - F.col("first_") + F.col("before_"))
    return out.drop("at_", "part_", "g_", "p_", "first_", "before_"), [rows, counts]


