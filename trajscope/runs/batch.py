"""Which (baseline, metric, task) cells a batch of runs has, which are left out and why, and the jobs that remain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cohorts
from ..sources.dataset import Dataset
from .registry import METRICS

CELL = ["baseline", "metric", "task"]


def expand(asked: list[str], known: list[str]) -> list[str]:
    """Names of comma-separated items, each once; `all` stands for the known ones, others are errors."""
    names = [x.strip() for item in asked for x in item.split(",") if x.strip()]
    if "all" in names:
        names = [*known]
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown names {unknown}")
    return list(dict.fromkeys(names))


def eligibility(data: Dataset, metrics: list[str], tasks: list[str], domains: list[str]) -> DataFrame:
    """metric, task, reason (null if a plan can be made): what planning each cell alone would say.

    Every metric is planned once for all of its tasks; only where that is refused
    are its tasks planned one by one, to tell whose episodes break the rule.
    """
    spark = data.tasks.sparkSession
    asked = data.tasks.where(F.col("task_id").isin(*tasks))
    declared: dict[str, set] = {m: set() for m in metrics}
    named = F.filter(F.array(*(F.when(cohorts.declares(F.col("metrics"), m), F.lit(m)) for m in metrics)), lambda m: m.isNotNull())
    for r in asked.select("task_id", F.explode(named).alias("metric")).collect():  # a row per metric and task
        declared[r["metric"]].add(r["task_id"])
    rows = []
    for metric in metrics:
        own = [t for t in tasks if t in declared[metric]]
        rows += [(metric, t, "the task does not declare the metric") for t in tasks if t not in declared[metric]]
        try:
            some = {r["task"] for r in METRICS[metric].plan(data, own, domains).select("task").distinct().collect()} if own else set()
            rows += [(metric, t, None if t in some else "no episode is eligible") for t in own]
        except ValueError:
            rows += [(metric, t, _refusal(data, metric, t, domains)) for t in own]
    return spark.createDataFrame(rows, "metric string, task string, reason string")


def _refusal(data: Dataset, metric: str, task: str, domains: list[str]) -> str | None:
    try:
        return None if METRICS[metric].plan(data, [task], domains).take(1) else "no episode is eligible"
    except ValueError as e:
        return str(e)


def cells(baselines: DataFrame, eligible: DataFrame, rules: DataFrame) -> DataFrame:
    """baseline, metric, task, reason: the rule's text, or that of the data; null where the cell runs.

    rules (baseline, metric, task, text) with null for any are a hand-written list.
    """
    every = baselines.select("baseline").join(F.broadcast(eligible))
    c, r = every.alias("c"), F.broadcast(rules).alias("r")
    meets = lambda k: F.col(f"r.{k}").isNull() | (F.col(f"r.{k}") == F.col(f"c.{k}"))
    ruled = c.join(r, meets("baseline") & meets("metric") & meets("task"), "left").groupBy(*(F.col(f"c.{k}").alias(k) for k in (*CELL, "reason"))).agg(F.min("r.text").alias("text"))
    return ruled.select(*CELL, F.coalesce("text", "reason").alias("reason"))


def jobs(planned: DataFrame, published: DataFrame | None = None, mode: str = "normal") -> DataFrame:
    """baseline, tasks, metrics: cells that run, those of equal tasks together. Mode missing leaves out published cells; tga_easy needs two tasks."""
    if mode not in ("normal", "missing", "rerun"):
        raise ValueError(f"unknown mode {mode}")
    own = planned.where("reason IS NULL").select(*CELL)
    if mode == "missing" and published is not None:
        own = own.join(published.select(*CELL).distinct(), CELL, "left_anti")
    sets = own.groupBy("baseline", "metric").agg(F.array_sort(F.collect_set("task")).alias("tasks")).where("metric <> 'tga_easy' OR size(tasks) > 1")
    return sets.groupBy("baseline", "tasks").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))
