"""Subtask identification: which frames are asked about, and the bundles of answers that a judge reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..operators.intervals import points_in_spans
from .audits import raise_if_any, span_order
from .queries import query_id

KEYS = ["task", "episode"]
ITEM_FIELDS = ("query", "prediction", "target_subtask_id", "task_instruction", "candidates", "domain")
ITEM = (
    "query struct<query_id:string,op:string,task_id:string,episode_id:string,anchor_frame:int,instruction:string>, prediction struct<query_id:string,op:string,output:string>, "
    "target_subtask_id string, task_instruction string, candidates map<string,string>, domain string"
)


def cohort(episodes: DataFrame) -> DataFrame:
    """Normal and diverse solutions and those that say neither, whatever their outcome."""
    return episodes.where(F.col("solution").isNull() | F.col("solution").isin("normal", "diverse"))


def relabelled(spans: DataFrame) -> DataFrame:
    """Spans (task, episode, solution, id, start, end) with target: the id, or 001, 002, ... in order of time.

    The latter in diverse episodes whose ids are not all ordinals from 001 to
    009; there spans must not overlap.
    """
    plain = F.col("id").isin(*(f"{k:03d}" for k in range(1, 10)))
    named = spans.groupBy(*KEYS).agg(F.bool_and(plain).alias("plain"), F.max(F.col("solution") == "diverse").alias("diverse"))
    rows = span_order(spans, KEYS).join(named, KEYS).withColumn("anew", F.coalesce("diverse", F.lit(False)) & ~F.col("plain"))
    return rows.withColumn("target", F.when(F.col("anew"), F.lpad(F.col("ordinal").cast("string"), 3, "0")).otherwise(F.col("id")))


def overlapping(spans: DataFrame) -> DataFrame:
    """Episodes of `relabelled` spans that cannot be ordered."""
    return spans.where("anew AND link = 'overlaps'").select(*KEYS).distinct()


def drawn_frame(start: Column, end: Column, seed: Column) -> Column:
    """A frame of the middle 60 per cent of a span, by a hash of the seed: the same on every run and every executor."""
    window = fr.middle_window(start, end)
    draw = F.conv(F.substring(F.md5(seed.cast("string")), 1, 8), 16, 10).cast("long")
    return (window["from"] + F.pmod(draw, (window["to"] - window["from"]).cast("long"))).cast("int")


def plan(episodes: DataFrame, spans: DataFrame, seed: str = "0") -> DataFrame:
    """One subtask query per span of the cohort: query_id, domain, task, episode, instruction, target, anchor."""
    own = cohort(episodes).select(*KEYS, "domain", "solution", "instruction")
    rows = relabelled(spans.join(own, KEYS))
    raise_if_any(overlapping(rows), "spans of diverse episodes overlap")
    name = query_id(F.lit("sia"), F.col("task"), F.col("episode"), F.col("target"))
    return rows.select(name.alias("query_id"), "domain", *KEYS, "instruction", "target", drawn_frame(F.col("start"), F.col("end"), F.concat(F.lit(seed + ":"), name)).alias("anchor"))


def span_of_frame(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (task, episode, frame) with the target of the span that holds the frame and n_spans, how many do.

    Points meet spans bin by bin (`operators.intervals`), not all spans of their episode.
    """
    hits = points_in_spans(points.select(*KEYS, "frame").distinct(), spans.select(*KEYS, "target", "start", "end"), KEYS)
    found = hits.groupBy(*KEYS, "frame").agg(F.count(F.lit(1)).alias("n_spans"), F.max("target").alias("target"))
    return points.join(found, [*KEYS, "frame"], "left").withColumn("n_spans", F.coalesce("n_spans", F.lit(0))).select(*points.columns, "n_spans", "target")


def bundle(planned: DataFrame, answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items of a response bundle from a plan, its answers (query_id, output) and candidates (task, candidates)."""
    rows = planned.join(answers.select("query_id", "output"), "query_id", "left").join(candidates, "task", "left")
    bad = rows.where(F.col("output").isNull() | (F.trim("output") == "") | ~F.coalesce(F.array_contains(F.map_keys("candidates"), F.col("target")), F.lit(False)))
    raise_if_any(bad.select("query_id"), "answers without text or targets that are no candidates")
    query = F.struct("query_id", F.lit("subtask").alias("op"), F.col("task").alias("task_id"), F.col("episode").alias("episode_id"), F.col("anchor").alias("anchor_frame"), "instruction")
    said = F.struct("query_id", F.lit("subtask").alias("op"), "output")
    return rows.select(query.alias("query"), said.alias("prediction"), F.col("target").alias("target_subtask_id"), F.col("instruction").alias("task_instruction"), "candidates", "domain")


def write_bundle(items: DataFrame, path: str) -> None:
    """One JSON line per item, with the version of the format, as a folder that is there whole or not at all."""
    items.withColumn("version", F.lit(1)).write.mode("errorifexists").json(path)


def read_bundle(spark, path: str) -> DataFrame:
    """Items of a bundle; an item with other fields, blank texts or an unknown target, a repeated id and an empty bundle are errors."""
    lines = spark.read.text(path)
    rows = lines.select("value", F.from_json("value", ITEM + ", version int").alias("j"), F.array_sort(F.json_object_keys("value")).alias("keys"))
    some = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    i = F.col("j")
    ok = (F.col("keys") == F.array(*map(F.lit, sorted((*ITEM_FIELDS, "version"))))) & (i["version"] == 1) & (i["query"]["op"] == "subtask") & (i["prediction"]["op"] == "subtask")
    ok &= (i["query"]["query_id"] == i["prediction"]["query_id"]) & F.array_contains(F.map_keys(i["candidates"]), i["target_subtask_id"])
    for c in ("query.query_id", "prediction.output", "target_subtask_id", "task_instruction", "domain"):
        ok &= some(F.col(f"j.{c}"))
    ok &= F.forall(F.map_entries(i["candidates"]), lambda e: some(e["key"]) & some(e["value"]))
    raise_if_any(rows.where(~F.coalesce(ok, F.lit(False))).select(F.substring("value", 1, 200).alias("value")), f"{path}: invalid items")
    items = rows.select("j.*").drop("version")
    raise_if_any(items.groupBy("query.query_id").count().where("count > 1"), f"{path}: repeated ids")
    if not items.take(1):
        raise ValueError(f"{path}: no items")
    return items


def select_items(items: DataFrame, tasks: Sequence[str] | None = None, domains: Sequence[str] | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Items of the tasks and domains; with `relabelled` spans their targets and ids follow the present labels."""
    out = items
    if tasks is not None:
        out = out.where(F.col("query.task_id").isin(*tasks))
    if domains is not None:
        out = out.where(F.col("domain").isin(*domains))
    if spans is not None:
        points = out.select(F.col("query.task_id").alias("task"), F.col("query.episode_id").alias("episode"), F.col("query.anchor_frame").alias("frame"), F.col("query.query_id").alias("old_id"))
        now = span_of_frame(points, spans)
        raise_if_any(now.where("n_spans <> 1").select("old_id", "n_spans"), "frames in no span or several")
        name = query_id(F.lit("sia"), F.col("task"), F.col("episode"), F.col("target"))
        now = now.select("old_id", "target", name.alias("new_id"))
        out = out.join(now, F.col("query.query_id") == F.col("old_id")).withColumn("query", F.col("query").withField("query_id", F.col("new_id"))).withColumn("prediction", F.col("prediction").withField("query_id", F.col("new_id")))
        out = out.withColumn("target_subtask_id", F.col("target")).drop("old_id", "target", "new_id")
    raise_if_any(out.groupBy("query.query_id").count().where("count > 1"), "ids that several answers share")
    return out


def judged(items: DataFrame, judgements: DataFrame) -> DataFrame:
    """domain, task, episode, logprob of the targets, from judgements (query_id, logprobs map<candidate, logprob>); a missing one is an error."""
    rows = items.select("domain", F.col("query.task_id").alias("task"), F.col("query.episode_id").alias("episode"), F.col("query.query_id").alias("query_id"), F.col("target_subtask_id").alias("target")).join(judgements, "query_id", "left")
    rows = rows.withColumn("logprob", F.try_element_at("logprobs", F.col("target")))
    raise_if_any(rows.where("logprob IS NULL").select("query_id"), "targets without a log-probability")
    return rows.select("domain", "task", "episode", "logprob")
