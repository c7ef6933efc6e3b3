"""Value queries as sets of compares: from the start, to a goal, and hop by hop in between; equal compares are asked once.

A query's hops are those of every later query of its episode too, so what goes to
the predictor is the table of different pairs of states, and answers come back by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import kernels as kn
from ..functions import sequences as sq

PAIR = ["task", "episode_a", "frame_a", "episode_b", "frame_b", "instruction"]


def _pair(part: str, place: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.struct(F.lit(part).alias("part"), place.cast("int").alias("place"), a[0].alias("episode_a"), a[1].cast("int").alias("frame_a"), b[0].alias("episode_b"), b[1].cast("int").alias("frame_b"))


def _hops(frames: Column) -> Column:
    """hop structs between neighbours of timeline frames, as source frames."""
    at = lambda p: fr.source_frame(F.col("num_frames"), p, F.col("playback"))
    own = F.col("episode")
    return F.transform(F.slice(frames, F.lit(2), F.greatest(F.size(frames) - 1, F.lit(0))), lambda right, i: _pair("hop", i, (own, at(F.get(frames, i))), (own, at(right))))


def three_way(values: DataFrame, goals: DataFrame, hz: float) -> DataFrame:
    """query_id, part (forward, backward, hop), place and PAIR, of value queries (query_id, task, episode, anchor, instruction, playback, num_frames, fps).

    goals (task, goal_episode, goal_frame) is where each task ends, a short table.
    """
    rows = values.join(F.broadcast(goals), "task").withColumn("at", fr.timeline_anchor(F.col("num_frames"), F.col("anchor"), F.col("playback")))
    own, here = F.col("episode"), F.col("anchor")
    start = fr.source_frame(F.col("num_frames"), F.lit(0), F.col("playback"))
    ends = F.array(_pair("forward", F.lit(0), (own, start), (own, here)), _pair("backward", F.lit(0), (F.col("goal_episode"), F.col("goal_frame")), (own, here)))
    pairs = F.concat(ends, _hops(kn.incremental_frames(F.col("at"), F.col("fps"), hz)))
    return rows.select("query_id", "task", "instruction", F.explode(pairs).alias("p")).select("query_id", "p.part", "p.place", "task", "p.episode_a", "p.frame_a", "p.episode_b", "p.frame_b", "instruction")


def critic_steps(values: DataFrame, sample_fps: float = 5.0) -> DataFrame:
    """The same columns for a critic that sees grid steps and a terminal one: part is `hop` for all."""
    rows = values.withColumn("at", fr.timeline_anchor(F.col("num_frames"), F.col("anchor"), F.col("playback"))).withColumn("stride", kn.sample_step(F.col("fps"), sample_fps))
    steps = rows.select("query_id", "task", "instruction", F.explode(_hops(kn.step_frames(F.col("at"), F.col("stride")))).alias("p"))
    return steps.select("query_id", "p.part", "p.place", "task", "p.episode_a", "p.frame_a", "p.episode_b", "p.frame_b", "instruction")


def asked(parts: DataFrame) -> DataFrame:
    """PAIR: the different compares; a state against itself is not asked."""
    return parts.where("NOT (episode_a = episode_b AND frame_a = frame_b)").select(*PAIR).distinct()


def answered(parts: DataFrame, scores: DataFrame) -> DataFrame:
    """query_id, forward, backward and hops (in order), of scores (PAIR, score); a state against itself is 0, a missing score an error."""
    rows = parts.join(scores, PAIR, "left")
    same = (F.col("episode_a") == F.col("episode_b")) & (F.col("frame_a") == F.col("frame_b"))
    score = F.when(same, 0.0).otherwise(F.coalesce("score", F.raise_error(F.concat_ws(" ", F.lit("no score for"), "query_id", "part", "place")).cast("double")))
    rows = rows.withColumn("score", score)
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("score")))
    hops = F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "hop", F.struct("place", "score")))), lambda x: x["score"])
    return rows.groupBy("query_id").agg(of("forward").alias("forward"), of("backward").alias("backward"), hops.alias("hops"))


def three_way_values(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", kn.three_way_value(F.col("forward"), F.col("backward"), F.col("hops")).alias("score"))


def critic_values(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", sq.signed_fold(F.col("hops")).alias("score"))
