"""How work is laid out: partitions of equal cost, and batches of equal shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import numbered

#: Pieces of a partition: what cannot be split further is this share of one.
PIECES = 16
#: Groups of keys whose sums are ordered among themselves.
GROUPS = 1024


def balanced(rows: DataFrame, keys: Sequence[str], order: str, cost: Column, partitions: int) -> DataFrame:
    """rows in `partitions` partitions of about equal cost (column partition), those of a key together as far as that allows, in order within.

    Costs are summed along each key; a key that costs more than a PIECES-th of a
    partition is cut there, so no partition holds more than its share and two
    pieces. Running sums over the pieces are taken within GROUPS of them and over
    the groups, and give each piece its partition. Spark sends rows to the partition named.
    """
    keys = list(keys)
    costed = rows.withColumn("cost_", cost.cast("double"))
    total = costed.agg(F.sum("cost_")).first()[0]
    if not total:
        return rows.withColumn("partition", F.lit(0))
    share = total / partitions
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = costed.withColumn("piece_", F.floor(F.coalesce(F.sum("cost_").over(along), F.lit(0.0)) / F.lit(share / PIECES)))
    pieces = cut.groupBy(*keys, "piece_").agg(F.sum("cost_").alias("sum_")).withColumn("group_", F.pmod(F.xxhash64(*keys, "piece_"), F.lit(GROUPS)))
    before = lambda w: F.coalesce(F.sum("sum_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    groups = pieces.groupBy("group_").agg(F.sum("sum_").alias("sum_"))
    starts = groups.select("group_", before(Window.partitionBy(F.lit(0)).orderBy("group_")).alias("start_"))  # GROUPS rows
    placed = pieces.withColumn("in_", before(Window.partitionBy("group_").orderBy(*keys, "piece_"))).join(F.broadcast(starts), "group_")
    number = F.least(F.floor((F.col("start_") + F.col("in_") + F.col("sum_") / 2) / F.lit(share)), F.lit(partitions - 1)).cast("int")
    placed = placed.select(*(F.col(k).alias(f"{k}_of") for k in keys), F.col("piece_").alias("piece_of"), number.alias("partition"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys] + [F.col("piece_") == F.col("piece_of")]
    out = cut.join(placed, same).select(*rows.columns, "partition")
    return out.repartitionById(partitions, "partition").sortWithinPartitions(*keys, order)


def packed(rows: DataFrame, shape: Sequence[str], frames: str, order: Sequence[str], budget: int = 64, most: int = 1 << 30) -> DataFrame:
    """rows with batch, a number within their shape: equal frames and equal shape, at most `budget` frames (one row at least) and `most` rows.

    All rows of a batch have the same number of frames, so a batch is full after
    budget / frames rows. Rows are numbered by range partitions
    (`positions.numbered`), so one instruction that everybody asks is no hot task.
    """
    size = F.least(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col(frames), F.lit(1)))), F.lit(most))
    placed = numbered(rows, [F.col(c) for c in order], "place_", [*shape, frames])
    return placed.withColumn("batch", F.floor(F.col("place_") / size).cast("long")).drop("place_")
