"""Positions in an order over all rows, or over those of a group, without a window that spans them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path

#: monotonically_increasing_id keeps the row within its partition in so many bits.
_BITS = 33


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "ord", group: Sequence[str] = ()) -> DataFrame:
    """rows with their number in the order, from 0 on, among all or those of the same group; the order should leave no ties.

    Rows are dealt to range partitions, sorted there and written once to the
    shared folder; a count for each group in each partition, summed up, says
    where it begins. A group that holds most of the rows is many partitions.
    """
    spark: SparkSession = rows.sparkSession
    path, group = fresh_path(spark, "ordered"), list(group)
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("part_", F.shiftright("at_", _BITS))
    counts = placed.groupBy(*group, "part_").agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
    # a row for each partition, and each border of groups
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(g).alias(f"{g}_of") for g in group), F.col("part_").alias("p_"), "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    same = [F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in group] + [F.col("part_") == F.col("p_")]
    out = placed.join(starts, same).withColumn(name, F.col("start_") + F.col("at_") - F.col("first_"))
    return out.select(*rows.columns, name)
