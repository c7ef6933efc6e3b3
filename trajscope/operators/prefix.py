"""Values of states by the mean of a frame feature over the playback up to the anchor: sums are carried along each timeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr

TIMELINE = ["task", "episode", "playback"]
STATE = ["task", "episode", "anchor", "playback"]


def _carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean so far at each query, of rows in order of timeline and position; what a batch ends with goes on in the next."""
    key, total, count = None, 0.0, 0
    for frame in frames:
        keys = frame["key"].to_numpy()
        fresh = np.flatnonzero(np.concatenate(([len(keys) > 0 and keys[0] != key], keys[1:] != keys[:-1])))
        x, one = np.nan_to_num(frame["x"].to_numpy(dtype=float)), (~frame["asked"]).to_numpy(dtype=np.int64)
        sums, counts = np.cumsum(x), np.cumsum(one)
        group = np.searchsorted(fresh, np.arange(len(keys)), side="right")
        # before the first fresh timeline of the batch stands what was carried into it
        base_x = np.concatenate(([-total], np.where(fresh > 0, sums[fresh - 1], 0.0)))[group]
        base_n = np.concatenate(([-count], np.where(fresh > 0, counts[fresh - 1], 0)))[group]
        sums, counts = sums - base_x, counts - base_n
        if len(keys):
            key, total, count = keys[-1], float(sums[-1]), int(counts[-1])
        asked = frame["asked"].to_numpy()
        yield frame.loc[asked, STATE].assign(score=sums[asked] / np.maximum(counts[asked], 1))


def prefix_means(states: DataFrame, features: DataFrame) -> DataFrame:
    """STATE and score of distinct states (task, episode, anchor, playback), from features (task, episode, frame, x).

    Features are laid out along each playback that is asked for (a cycle passes
    every frame but the last twice) and sorted together with the queries, so a
    partition is read once and nothing but a sum is kept. A state without its frame is an error.
    """
    n = features.groupBy("task", "episode").agg((F.max("frame") + 1).alias("n"))
    asked = states.select(*STATE).distinct().join(n, ["task", "episode"], "left")
    known = F.coalesce((F.col("anchor") >= 0) & (F.col("anchor") < F.col("n")), F.lit(False))
    position = F.when(known, fr.timeline_anchor(F.col("n"), F.col("anchor"), F.col("playback"))).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no frame for"), "task", "episode", "anchor")))
    queries = asked.select(*STATE, position.alias("position"), F.lit(True).alias("asked"), F.lit(None).cast("double").alias("x"))
    laid = features.join(asked.select(*TIMELINE, "n").distinct(), ["task", "episode"])
    f, last = F.col("frame"), F.col("n") - 1
    places = F.when(F.col("playback") == "forward", F.array(f)).when(F.col("playback") == "reverse", F.array(last - f)).when(f < last, F.array(f, 2 * last - f)).otherwise(F.array(f))
    laid = laid.select("task", "episode", F.lit(None).cast("int").alias("anchor"), "playback", F.explode(places).alias("position"), F.lit(False).alias("asked"), F.col("x").cast("double").alias("x"))
    key = F.concat_ws("\x1f", *TIMELINE)
    rows = laid.unionByName(queries).withColumn("key", key).repartition(*TIMELINE).sortWithinPartitions(*TIMELINE, "position", "asked")
    kept = rows.withColumn("anchor", F.coalesce("anchor", F.lit(-1)).cast("int")).select("key", *STATE, "asked", "x")
    return kept.mapInPandas(_carried, "task string, episode string, anchor int, playback string, score double")
