"""Episode tables in the LeRobot layout: instructions instead of labels, and reference clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import remap_labels


def overlay(spark: SparkSession, root: str, target: str, labels: DataFrame) -> None:
    """Write tasks.parquet and episodes under target with labels (old, new) replaced; other columns stay as they are."""
    tasks = spark.read.parquet(f"{root}/tasks.parquet").join(F.broadcast(labels), F.col("task") == F.col("old"), "left")
    tasks.withColumn("task", F.coalesce("new", "task")).drop("old", "new").write.parquet(f"{target}/tasks.parquet")
    remap_labels(spark.read.parquet(f"{root}/episodes"), "tasks", labels).write.parquet(f"{target}/episodes")
    for name in ("tasks.parquet", "episodes"):
        before, after = spark.read.parquet(f"{root}/{name}"), spark.read.parquet(f"{target}/{name}")
        plain = [c for c in before.columns if c not in ("task", "tasks")]
        if before.columns != after.columns or before.count() != after.count() or before.select(*plain).exceptAll(after.select(*plain)).take(1):
            raise ValueError(f"{target}/{name} differs from its source by more than labels")


def reference_clips(episodes: DataFrame, instructions: DataFrame, fps: float) -> DataFrame:
    """instruction, path and first frame of the earliest episode that names it. instructions is the list of tasks."""
    named = episodes.select("*", F.explode("tasks").alias("instruction")).join(F.broadcast(instructions), "instruction", "left_semi")
    first = named.groupBy("instruction").agg(F.min_by(F.struct("chunk_index", "file_index", "from_timestamp"), "episode_index").alias("r"))
    path = F.format_string("chunk-%03d/file-%03d.mp4", F.col("r.chunk_index"), F.col("r.file_index"))
    return first.select("instruction", path.alias("path"), F.rint(F.col("r.from_timestamp") * F.lit(fps)).cast("int").alias("start"))
