"""What speaks against a plan or its annotations, as rows; empty frames mean that nothing does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import numbered

CELL = ["domain", "task"]
LEAST_SAMPLES = 7


def raise_if_any(rows: DataFrame, what: str) -> None:
    """Raise with a count and the first three rows by all columns."""
    first = rows.orderBy(*rows.columns).limit(3).collect()
    if first:
        raise ValueError(f"{what}: {rows.count()} rows, e.g. " + "; ".join(str(tuple(r)) for r in first))


def one_sided_cells(episodes: DataFrame) -> DataFrame:
    """Cells that lack successes or failures."""
    return episodes.groupBy(*CELL).agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures")).where("successes = 0 OR failures = 0")


def repeated_roles(episodes: DataFrame) -> DataFrame:
    """Groups in which a role occurs twice: an error of the data, other than a group that is not complete."""
    return episodes.where("trr_group IS NOT NULL").groupBy(*CELL, "trr_group", "role").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def short_memories(episodes: DataFrame) -> DataFrame:
    """Successful episodes with memory annotations at fewer than two frames."""
    return episodes.where(F.col("success") & (F.size("voc_mem") == 1)).select(*CELL, "episode", F.size("voc_mem").alias("n_points"))


def solution_gaps(episodes: DataFrame) -> DataFrame:
    """Tasks of the first domain that lack successful normal or successful diverse episodes."""
    own = episodes.where("domain = 'id'")
    roles = own.groupBy("task").agg(F.count_if(F.col("success") & (F.col("solution") == "normal")).alias("n_normal"), F.count_if(F.col("success") & (F.col("solution") == "diverse")).alias("n_diverse"))
    return roles.where("n_normal = 0 OR n_diverse = 0")


def point_spans(spans: DataFrame) -> DataFrame:
    """Spans (start, end) of one frame or none, from which no change can be read."""
    return spans.where(F.col("end") - F.col("start") <= 1)


def sample_exclusion(n_samples: Column) -> Column:
    return F.when(n_samples < LEAST_SAMPLES, "fewer_than_seven_samples")


def uncovered_frames(grid: DataFrame, annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Grid frames (keys, frame) that the annotations lack."""
    return grid.join(annotated.select(*keys, "frame").distinct(), [*keys, "frame"], "left_anti")


def uneven_domains(episodes: DataFrame) -> DataFrame:
    """Tasks that do not cover all the domains that some task covers."""
    wanted = episodes.agg(F.array_sort(F.collect_set("domain")).alias("wanted"))  # domains are three
    own = episodes.groupBy("task").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    return own.join(F.broadcast(wanted)).where(F.col("domains") != F.col("wanted")).select("task", F.array_join("domains", ",").alias("domains"))


def bad_anchors(queries: DataFrame, episodes: DataFrame) -> DataFrame:
    """query_id, rule of queries (task, episode, anchor, and task_b, anchor_b of compares) outside their episode."""
    n = episodes.select("task", "episode", "num_frames")
    out = lambda c: (F.col(c) < 0) | (F.col(c) >= F.col("num_frames"))
    rule = F.when(F.col("num_frames").isNull(), "unknown_episode").when(F.col("task_b").isNotNull() & (F.col("task_b") != F.col("task")), "other_task").when(out("anchor") | F.coalesce(out("anchor_b"), F.lit(False)), "outside")
    return queries.join(n, ["task", "episode"], "left").select("query_id", rule.alias("rule")).where("rule IS NOT NULL")


def span_order(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with `ordinal` from 1 on by start and end, and `link` to the next: touches, gap, overlaps or last."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "id")
    after = F.lead("start").over(w)
    link = F.when(after.isNull(), "last").when(after == F.col("end"), "touches").when(after > F.col("end"), "gap").otherwise("overlaps")
    return spans.withColumn("ordinal", F.row_number().over(w)).withColumn("link", link)


def group_ordinals(episodes: DataFrame) -> DataFrame:
    """Complete groups numbered from 0 on by domain, task and group."""
    groups = episodes.groupBy(*CELL, "trr_group").agg(F.count_distinct("role").alias("n")).where("n = 3").select(*CELL, "trr_group")
    return numbered(groups, [F.col(c) for c in (*CELL, "trr_group")], "ordinal")


def missing_samples(plan: DataFrame, predictions: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` planned ids by name without a prediction (a report, not a filter)."""
    return plan.select("query_id").join(predictions.select("query_id"), "query_id", "left_anti").orderBy("query_id").limit(most)


def in_plan_order(results: DataFrame, plan: DataFrame) -> DataFrame:
    """results with `ord` of the plan; sort by it where an order is shown."""
    return results.join(plan.select("query_id", "ord"), "query_id")


def shortest_first(queries: DataFrame, partitions: int) -> DataFrame:
    """Queries of an episode together, short prefixes before long ones, so that a predictor can go on from what it has seen."""
    return queries.repartition(partitions, "task", "episode").sortWithinPartitions("task", "episode", "anchor")
