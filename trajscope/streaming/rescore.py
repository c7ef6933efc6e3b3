"""Scores of cells whose rows arrive as a stream: sums that merge, so that a batch does not read its cells again.

State is a table of (domain, task, episode, total, n), dealt to BUCKETS folders by
the cell; a batch rewrites the folders of the cells that it touches and commits
them together with its number (`sources.commits`). A batch that is replayed after a
restart finds its number and changes nothing, so every row counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics
from ..sources.commits import Log, Snapshot
from ..sources.storage import joined
from .replay import merge_stream

BUCKETS = 64
CELL = ["domain", "task"]
SUMS = "domain string, task string, episode string, total double, n long"


class CellScores:
    """Means by episode, of rows (domain, task, episode, score)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Log(spark, root)

    def _sums(self, snapshot: Snapshot, buckets: set[int] | None = None) -> DataFrame:
        paths = [joined(self.log.root, p) for p, facts in sorted(snapshot.files.items()) if buckets is None or facts["bucket"] in buckets]
        return self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Merge a batch; domain, task and score of the cells that it touches."""
        snapshot = self.log.snapshot()
        bucket = F.pmod(F.xxhash64(*CELL), F.lit(BUCKETS)).cast("int")
        fresh = rows.groupBy(*CELL, "episode").agg(F.sum("score").alias("total"), F.count("score").alias("n"))
        if snapshot.properties.get("batch", -1) < batch:
            touched = {r["b"] for r in fresh.select(bucket.alias("b")).distinct().collect()}  # BUCKETS numbers at most
            old = [p for p, facts in snapshot.files.items() if facts["bucket"] in touched]
            merged = self._sums(snapshot, touched).unionByName(fresh).groupBy(*CELL, "episode").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            folder = f"sums/{uuid.uuid4().hex}"
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(joined(self.log.root, folder))
            made = {f"{folder}/{name}": {"bucket": int(name.split("=")[1])} for name in self.log.storage.names(joined(self.log.root, folder)) if name.startswith("bucket=")}
            snapshot = self.log.commit(snapshot, add=made, remove=old, set={"batch": batch})
        return self.cells(snapshot).join(fresh.select(*CELL).distinct(), CELL, "left_semi")

    def episodes(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self._sums(snapshot or self.log.snapshot()).select(*CELL, "episode", (F.col("total") / F.col("n")).alias("score"))

    def cells(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.episodes(snapshot).groupBy(*CELL).agg(F.avg("score").alias("score"))

    def macro(self) -> DataFrame:
        return statistics.macro_mean(self.episodes())


def score_stream(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, state: str, on_conflict: str = "error"):
    """`replay.merge_stream`, with the scores of state following every batch; late rows count like others, conflicting ones as merge_stream has it."""
    scores = CellScores(spark, state)
    return merge_stream(spark, source, schema, store, checkpoint, on_conflict=on_conflict, on_rows=scores.add)
