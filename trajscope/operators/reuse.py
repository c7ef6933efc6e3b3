"""Scores of one metric from predictions that were made for another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.audits import raise_if_any

STATE = ["task", "episode", "anchor", "instruction"]


def from_states(plan: DataFrame, source: DataFrame, predictions: DataFrame) -> DataFrame:
    """query_id, op, score of plan from the predictions of source's forward queries of the same state and instruction.

    source (query_id, task, episode, anchor, instruction, playback) plays forward
    and back; on the way back a state has another value. A planned state that
    source does not ask forward is an error.
    """
    forward = source.where("playback = 'forward'").select("query_id", *STATE).withColumnRenamed("query_id", "source_id")
    found = plan.select("query_id", *STATE).join(forward, STATE, "left")
    raise_if_any(found.where("source_id IS NULL").select("query_id"), "states without a forward query")
    scored = found.join(predictions.select(F.col("query_id").alias("source_id"), "score"), "source_id", "left")
    raise_if_any(scored.where("score IS NULL").select("query_id"), "states without a prediction")
    return scored.select("query_id", F.lit("value").alias("op"), "score")


def renamed(predictions: DataFrame, old: str, new: str) -> DataFrame:
    """Predictions of metric `old`, by the first part of their ids, under the ids of metric `new`."""
    rest = F.substring("query_id", len(old) + 1, 1 << 20)
    return predictions.where(F.col("query_id").startswith(f"{old}:")).withColumn("query_id", F.concat(F.lit(new), rest))
