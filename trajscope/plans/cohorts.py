"""Which episodes a metric takes, and why the others are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def declares(metrics: Column, metric: str) -> Column:
    """voc, cycle_voc and vs are content with either VOC or CYCLE-VOC."""
    if metric in ("voc", "cycle_voc", "vs"):
        return F.arrays_overlap(metrics, F.array(F.lit("VOC"), F.lit("CYCLE-VOC")))
    return F.array_contains(metrics, {"voc_mem": "VOC-MEM", "tga_easy": "TGA", "tga_hard": "TGA", "csvc": "CSPC"}.get(metric, metric.upper()))


def exclusion_reason(success: Column, in_group: Column, solution: Column, annotated: Column) -> Column:
    """The first reason against a normal successful trajectory; null if there is none."""
    return (
        F.when(~success, "unsuccessful").when(in_group, "trr_branch").when(solution.eqNullSafe(F.lit("diverse")), "diverse_solution").when(~annotated, "no_cycle_voc_annotations")
    )


def value_accuracy(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All episodes; and the (domain, task) cells that lack one of the two outcomes."""
    return episodes, episodes.groupBy("domain", "task").agg(F.count_distinct("success").alias("n")).where("n < 2")


def grounding(episodes: DataFrame) -> DataFrame:
    return episodes.where(F.col("success") & F.col("trr_group").isNull() & ~F.col("solution").eqNullSafe(F.lit("diverse")))


def failure_point(episodes: DataFrame) -> DataFrame:
    return episodes.where(F.col("onset").isNotNull() & ~F.col("role").eqNullSafe(F.lit("r_zero")))


def complete_group_keys(episodes: DataFrame) -> DataFrame:
    """domain, task, trr_group of the groups that have all three roles, once each."""
    roles = episodes.groupBy("domain", "task", "trr_group").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count("role").alias("n"))
    whole = roles.where((F.col("roles") == F.array(F.lit("r_minus"), F.lit("r_plus"), F.lit("r_zero"))) & (F.col("n") == 3))
    return whole.select("domain", "task", "trr_group")


def complete_groups(episodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Episodes of groups with all three roles, once each; a role that repeats in a group is an error of the data. keys may come from a lighter table of the same episodes."""
    return episodes.join(keys if keys is not None else complete_group_keys(episodes), ["domain", "task", "trr_group"], "left_semi")


def frame_audit(rows: DataFrame) -> DataFrame:
    """status from num_frames (metadata), video_frames and last_annotated."""
    n, video, last = F.col("num_frames"), F.col("video_frames"), F.col("last_annotated")
    status = F.when(n > video, "metadata_exceeds_video").when(last >= video, "annotation_exceeds_video").when(video > n, "video_longer_than_metadata").otherwise("ok")
    return rows.withColumn("status", status)


def policy_filter(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells (baseline, metric, task) no rule (with null for any) excludes. The rules are a hand-written list."""
    c, r = cells.alias("c"), F.broadcast(rules).alias("r")
    meets = lambda k: F.col(f"r.{k}").isNull() | (F.col(f"r.{k}") == F.col(f"c.{k}"))
    return c.join(r, meets("baseline") & meets("metric") & meets("task"), "left_anti")
