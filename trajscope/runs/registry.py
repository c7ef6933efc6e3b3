"""What can be run: metrics (a plan and a score over DataFrames) and predictors (a class that answers queries)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..operators import metrics as mt
from ..operators import prefix
from ..plans import audits, cohorts, identify
from ..plans import queries as plans
from ..sources.dataset import Dataset
from . import results

CELL = ["domain", "task"]


@dataclass(frozen=True)
class Metric:
    """plan(dataset, tasks, domains) gives queries; score(plan with score) gives rows (domain, task, score)."""

    name: str
    op: str
    plan: Callable[[Dataset, list[str], list[str]], DataFrame]
    score: Callable[[DataFrame], DataFrame]
    domains: tuple[str, ...] = ("id", "env", "emb")
    native: bool = False
    #: Records of the scored plan, figures of the records, and episodes that the plan leaves out, with reasons.
    records: Callable[[DataFrame], DataFrame] | None = None
    figures: Callable[[DataFrame], dict] | None = None
    excluded: Callable[[Dataset, list[str], list[str]], DataFrame] | None = None


METRICS: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    if metric.name in METRICS:
        raise ValueError(f"metric {metric.name} is registered already")
    METRICS[metric.name] = metric
    return metric


def episodes(data: Dataset, metric: str, tasks: list[str], domains: list[str]) -> DataFrame:
    """Episodes of the tasks that declare the metric, in the domains, under the names of the plans."""
    own = data.tasks.where(F.col("task_id").isin(*tasks) & cohorts.declares(F.col("metrics"), metric)).select("task_id", "instruction", "counterfactuals")
    rows = data.episodes.where(F.col("domain").isin(*domains)).join(F.broadcast(own), "task_id")
    return rows.withColumnRenamed("task_id", "task").withColumnRenamed("episode_id", "episode")


def _asked(rows: DataFrame, metric: str, *parts: str) -> DataFrame:
    return rows.withColumn("metric", F.lit(metric)).withColumn("query_id", plans.query_id(F.lit(metric), F.col("task"), F.col("episode"), *map(F.col, parts)))


def _normal(rows: DataFrame) -> DataFrame:
    return rows.where(cohorts.exclusion_reason(F.col("success"), F.col("trr_group").isNotNull(), F.col("solution"), F.size("voc") > 0).isNull())


def _sa(data, tasks, domains):
    rows, gaps = cohorts.value_accuracy(episodes(data, "sa", tasks, domains))
    audits.raise_if_any(gaps, "cells without both outcomes")
    return _asked(rows.withColumn("anchor", F.explode(fr.tail_frames(F.col("num_frames")))), "sa", "anchor")


def _voc(data, tasks, domains):
    rows = _normal(episodes(data, "voc", tasks, domains))
    audits.raise_if_any(rows.where(F.size("voc") < 3).select("task", "episode"), "fewer than three annotated frames")
    return _asked(rows.withColumn("anchor", F.explode(F.array_distinct("voc"))), "voc", "anchor")


def _memory(data, tasks, domains):
    rows = episodes(data, "voc_mem", tasks, domains).where(F.col("success") & (F.size("voc_mem") > 0))
    audits.raise_if_any(audits.short_memories(rows), "memory annotations at fewer than two frames")
    return _asked(rows.withColumn("anchor", F.explode("voc_mem")), "voc_mem", "anchor")


def _cycle(data, tasks, domains):
    rows = _normal(episodes(data, "cycle_voc", tasks, domains)).withColumn("up", F.array_sort(F.array_distinct("voc")))
    audits.raise_if_any(rows.where(F.size("up") < 3).select("task", "episode"), "fewer than three annotated frames")
    rows = rows.withColumn("path", fr.mirror(F.col("up"))).drop("up")
    rows = rows.withColumn("n_path", F.size("path")).select("*", F.posexplode("path").alias("position", "anchor"))
    return _asked(rows.withColumn("playback", F.when(F.col("position") <= (F.col("n_path") - 1) / 2, "forward").otherwise("cycle")), "cycle_voc", "position")


def _sampled(data, tasks, domains):
    return _normal(episodes(data, "vs", tasks, domains)).withColumn("grid", fr.grid(F.col("num_frames"), F.col("fps"), 5.0))


def _short(data, tasks, domains):
    """domain, task, episode, reason of what the smoothness plan leaves out."""
    rows = episodes(data, "vs", tasks, domains)
    why = cohorts.exclusion_reason(F.col("success"), F.col("trr_group").isNotNull(), F.col("solution"), F.size("voc") > 0)
    short = audits.sample_exclusion(F.size(fr.grid(F.col("num_frames"), F.col("fps"), 5.0)))
    return rows.select(*CELL, "episode", F.coalesce(why, short).alias("reason")).where("reason IS NOT NULL")


def _smooth(data, tasks, domains):
    rows = _sampled(data, tasks, domains)
    rows = rows.where(audits.sample_exclusion(F.size("grid")).isNull())
    audits.raise_if_any(rows.where(F.size(F.array_except("grid", "voc")) > 0).select("task", "episode"), "grids that the annotations do not cover")
    audits.raise_if_any(audits.uneven_domains(rows), "tasks with other domains")
    return _asked(rows.withColumn("anchor", F.explode("grid")), "vs", "anchor")


def _failure(data, tasks, domains):
    rows = cohorts.failure_point(episodes(data, "fpl", tasks, domains).withColumn("onset", F.col("failure_start")))
    return _asked(rows.withColumn("anchor", F.explode(fr.grid_with_end(F.col("num_frames"), F.col("fps")))), "fpl", "anchor")


#: The stages of each role and the sign that the value should have there (0: not rising).
STAGES = {"r_plus": {"failure": -1, "recovery": 1, "recovery_success": 1}, "r_zero": {"failure": -1, "recovery": 1, "recovery_failed": -1}, "r_minus": {"failure": -1, "continue": 0}}


def _recovery(data, tasks, domains):
    rows = episodes(data, "trr", tasks, domains)
    audits.raise_if_any(audits.repeated_roles(rows), "roles that repeat in a group")
    wanted = F.create_map(*(x for role, own in STAGES.items() for x in (F.lit(role), F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(s).alias("sign")) for n, s in own.items())))))
    rows = cohorts.complete_groups(rows).withColumn("s", F.explode(F.element_at(wanted, F.col("role")))).withColumn("span", F.try_element_at("trr_spans", F.col("s.stage")))
    audits.raise_if_any(rows.where("span IS NULL").select("task", "episode", "s.stage"), "stages without a span")
    start, end = F.col("span.start_frame"), F.col("span.end_frame_exclusive")
    rows = rows.withColumn("stage", F.col("s.stage")).withColumn("sign", F.col("s.sign")).withColumn("frames", fr.top_up(fr.stage_grid(start, end, F.col("fps")), start, end))
    rows = rows.withColumn("weights", fr.time_weights(F.col("frames"), start, end))
    return _asked(rows.select("*", F.posexplode("frames").alias("place", "anchor")), "trr", "stage", "anchor")


def planned(spec: Metric, data: Dataset, tasks: list[str], domains: list[str], candidates: list[str] | None = None) -> DataFrame:
    """The plan of a metric; candidates are the tasks whose instructions a grounding metric chooses from, where they are more than the scored ones."""
    return spec.plan(data, tasks, domains, candidates) if candidates else spec.plan(data, tasks, domains)


def check_domains(plan: DataFrame, metric: str, domains: list[str]) -> DataFrame:
    """The plan, if every domain that is asked for has an episode in it; batches ask for what there is instead (`batch.eligibility`)."""
    missing = sorted(set(domains) - {r["domain"] for r in plan.select("domain").distinct().collect()})
    if missing:
        raise ValueError(f"{metric}: no episode is eligible in {', '.join(missing)}")
    return plan


def _grounding(metric: str, by_task: bool):
    def plan(data, tasks, domains, candidates=None):
        # tasks with memory annotations have instructions that one trajectory cannot tell apart
        plain = data.tasks.where(~cohorts.declares(F.col("metrics"), "voc_mem"))
        rows = cohorts.grounding(episodes(Dataset(plain, data.episodes, data.violations), metric, tasks, domains))
        scope = plain.where(cohorts.declares(F.col("metrics"), metric))
        audits.raise_if_any(scope.where(F.col("task_id").isin(*tasks) & ~F.col("task_id").isin(*(candidates or tasks))).select("task_id"), "scored tasks that are no candidates")
        known = scope.where(F.col("task_id").isin(*(candidates or tasks))).select(F.col("task_id").alias("task"), "instruction", "counterfactuals")
        if by_task:
            from pyspark.sql import Window

            listed = known.select("task", "instruction", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("task")).alias("ord"))  # the list of tasks
            candidates = plans.other_task_candidates(listed)
        else:
            from ..functions.text import counterfactual_id

            wrong = known.select("task", F.explode("counterfactuals").alias("c")).select("task", counterfactual_id(F.col("c.id")).alias("candidate"), F.col("c.description").alias("instruction"))
            candidates = known.select("task", F.lit("correct").alias("candidate"), "instruction").unionByName(wrong)
            audits.raise_if_any(candidates.groupBy("task", "candidate").count().where("count > 1"), "candidates with one id")
        return plans.pair_plan(rows.drop("instruction", "counterfactuals"), F.broadcast(candidates), metric).withColumn("metric", F.lit(metric))

    return plan


def _solutions(data, tasks, domains):
    rows = episodes(data, "csvc", tasks, domains).where("success AND solution IS NOT NULL")
    audits.raise_if_any(audits.solution_gaps(rows), "tasks without both kinds of solution")
    spans = rows.select("*", F.explode("spans").alias("s")).select("*", F.col("s.id").alias("semantic"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    audits.raise_if_any(audits.point_spans(spans).select("task", "episode", "semantic"), "spans of one frame")
    pairs = spans.select("*", F.posexplode(fr.boundary_pairs(F.col("start"), F.col("end"), F.col("fps"))).alias("i", "p")).withColumn("anchor_a", F.col("p.before")).withColumn("anchor_b", F.col("p.after"))
    return _asked(pairs, "csvc", "semantic", "i")


def _identify(data, tasks, domains):
    rows = episodes(data, "sia", tasks, domains)
    spans = rows.select("task", "episode", F.explode("spans").alias("s")).select("task", "episode", "s.*")
    return identify.plan(rows, spans).withColumn("metric", F.lit("sia"))


def _metric(name: str, op: str, plan, score=None, **more) -> None:
    """Register a metric of results.RECORDS; its score is that of its records unless another is given."""
    records, figures = results.RECORDS[name]
    register(Metric(name, op, plan, score or (lambda s: records(s).select(*CELL, "score")), records=records, figures=figures, **more))


_metric("sa", "value", _sa, mt.success_accuracy, native=True)
_metric("voc", "value", _voc)
_metric("voc_mem", "value", _memory)
_metric("cycle_voc", "value", _cycle)
_metric("vs", "value", _smooth, excluded=_short)
_metric("fpl", "value", _failure)
_metric("trr", "value", _recovery, domains=("id",))
_metric("tga_easy", "compare", _grounding("tga_easy", True), native=True)
_metric("tga_hard", "compare", _grounding("tga_hard", False), native=True)
_metric("csvc", "compare", _solutions, domains=("id",))
_metric("sia", "subtask", _identify, mt.identification)


# --- predictors ---------------------------------------------------------------


class Predictor:
    """Answers batches in their order: value and compare give scores, subtask texts.

    `fields` are the settings it takes and `required` those that it needs; methods
    named `native_<metric>` answer a metric's queries in a way of their own.
    """

    fields: tuple[str, ...] = ()
    required: tuple[str, ...] = ()

    def __init__(self, **settings):
        self.settings = settings

    def value(self, rows) -> list[float]:
        raise NotImplementedError

    def subtask(self, rows) -> list[str]:
        raise NotImplementedError

    def answer_states(self, states: DataFrame) -> DataFrame:
        """states (task, episode, anchor, instruction, playback) with a score: a predictor that can take them as a table has this in place of `value`."""
        raise NotImplementedError

    def subtask_text(self, rows: DataFrame) -> Column:
        """The answer to subtask queries of such a predictor."""
        return F.concat(F.lit("prediction for: "), F.col("instruction"))


class EchoPredictor(Predictor):
    """The share of the anchor in `scale`, and the instruction: for dry runs."""

    fields = ("scale",)

    def value(self, rows):
        return [a / float(self.settings.get("scale", 100)) for a in rows["anchor"]]

    def subtask(self, rows):
        return [f"{x}" for x in rows["instruction"]]


class PrefixPredictor(Predictor):
    """The mean of a frame feature over the playback up to the anchor.

    `features` is a table (task, episode, frame, x) that takes the place of
    decoded frames; `scale` is the x that counts as 1.
    """

    fields, required = ("features", "scale"), ("features",)

    def answer_states(self, states: DataFrame) -> DataFrame:
        features = states.sparkSession.read.parquet(self.settings["features"]).select("task", "episode", F.col("frame").cast("int").alias("frame"), "x")
        means = prefix.prefix_means(states, features).withColumn("score", F.col("score") / F.lit(float(self.settings.get("scale", 1))))
        return states.join(means, prefix.STATE)


PREDICTORS: dict[str, Callable[[], type[Predictor]]] = {"echo": lambda: EchoPredictor, "prefix": lambda: PrefixPredictor}


def predictor_class(name: str) -> type[Predictor]:
    """The class is imported when it is asked for."""
    if name not in PREDICTORS:
        raise ValueError(f"unknown predictor {name}; known are {', '.join(sorted(PREDICTORS))}")
    return PREDICTORS[name]()


def open_predictor(name: str, settings: dict) -> Predictor:
    """A predictor with exactly the settings that it knows."""
    own = predictor_class(name)
    unknown, missing = sorted(set(settings) - set(own.fields)), sorted(set(own.required) - set(settings))
    if unknown or missing:
        raise ValueError(f"settings of {name}: unknown {unknown}, missing {missing}")
    return own(**settings)


def check_mode(metric: str, mode: str, predictor: type[Predictor]) -> str | None:
    """The native method that answers the metric's queries, or None for the common ones."""
    if mode == "base":
        return None
    if mode != "native" or not METRICS[metric].native or not hasattr(predictor, f"native_{metric}"):
        raise ValueError(f"{metric} has no mode {mode} with this predictor")
    return f"native_{metric}"
