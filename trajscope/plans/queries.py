"""Query plans: which frames of which episodes a metric asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr


def query_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def edge_plan(episodes: DataFrame, metric: str = "sa") -> DataFrame:
    """One value query per tail frame."""
    out = episodes.withColumn("anchor", F.explode(fr.tail_frames(F.col("num_frames"))))
    return out.withColumn("metric", F.lit(metric)).withColumn("op", F.lit("value")).withColumn("query_id", query_id(F.lit(metric), F.col("task"), F.col("episode"), F.col("anchor")))


def pair_plan(episodes: DataFrame, candidates: DataFrame, metric: str) -> DataFrame:
    """One compare query per candidate instruction and (head, tail) pair. Candidates join on the task."""
    n = F.col("num_frames")
    pairs = F.zip_with(fr.head_frames(n), fr.tail_frames(n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = episodes.join(candidates, "task").select("*", F.posexplode(pairs).alias("i", "pair"))
    return out.select(*episodes.columns, *[c for c in candidates.columns if c != "task"], "i", F.col("pair.a").alias("anchor_a"), F.col("pair.b").alias("anchor_b"), query_id(F.lit(metric), F.col("task"), F.col("episode"), F.col("candidate"), F.col("i")).alias("query_id"))


def other_task_candidates(tasks: DataFrame) -> DataFrame:
    """For each task its own instruction (`correct`) and every other task's distinct one, the first in task order.

    tasks (task, instruction, ord) is the benchmark's list of tasks: pairing it
    with itself is a stated query set, the candidates of each task.
    """
    own = tasks.select("task", F.lit("correct").alias("candidate"), "instruction")
    other = tasks.select(F.col("task").alias("other"), F.col("instruction").alias("text"), "ord")
    first = other.groupBy("text").agg(F.min_by("other", "ord").alias("other"))
    pairs = tasks.join(F.broadcast(first), (tasks["instruction"] != first["text"]) & (tasks["task"] != first["other"]))
    return own.unionByName(pairs.select("task", F.concat(F.lit("task-"), "other").alias("candidate"), F.col("text").alias("instruction")))


def cycle_plan(episodes: DataFrame, frames: Column) -> DataFrame:
    """Up and down again over sorted frames (the annotated ones, or `frames.strided` ones for drawing): position, anchor and playback (forward up to the peak, then cycle)."""
    path = fr.mirror(frames)
    out = episodes.select("*", F.posexplode(path).alias("position", "anchor"), F.size(path).alias("n_path"))
    return out.withColumn("playback", F.when(F.col("position") <= (F.col("n_path") - 1) / 2, "forward").otherwise("cycle"))


def grid_plan(episodes: DataFrame, fps: float, hz: float = 5.0, with_end: bool = True) -> DataFrame:
    make = fr.grid_with_end if with_end else fr.grid
    return episodes.select("*", F.explode(make(F.col("num_frames"), F.lit(fps), hz)).alias("anchor"))


STAGES = "array(named_struct('stage', 'failure', 'start', 0, 'end', num_frames div 3, 'sign', -1), named_struct('stage', if(role = 'r_minus', 'continue', 'recovery'), 'start', num_frames div 3, 'end', if(role = 'r_minus', num_frames, (2 * num_frames) div 3), 'sign', if(role = 'r_minus', 0, 1)), named_struct('stage', if(role = 'r_plus', 'recovery_success', 'recovery_failed'), 'start', (2 * num_frames) div 3, 'end', num_frames, 'sign', if(role = 'r_plus', 1, -1)))"


def stage_plan(episodes: DataFrame) -> DataFrame:
    """Stages of TRR branches from the thirds of an episode: stage, start, end, sign (0: not rising)."""
    stages = F.expr(f"filter({STAGES}, x -> role <> 'r_minus' OR x.stage IN ('failure', 'continue'))")
    out = episodes.select("*", F.explode(stages).alias("s"))
    return out.select(*episodes.columns, "s.stage", F.col("s.start").cast("int").alias("start"), F.col("s.end").cast("int").alias("end"), F.col("s.sign").alias("sign")).where("end > start")
