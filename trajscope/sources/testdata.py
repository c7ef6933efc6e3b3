"""The driver's tables as trajectories.

Events of a user within a third of the month are an episode; its frames are the
events in time order. The value of a frame is the mean of the feature (integer
cents, so that sums are exact) over the frames up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frames as fr

DOMAINS = ("id", "env", "emb")
FPS = 10.0
SCALE = 50000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per frame with its episode's columns. One shuffle, by (user_id, d); what groups by episode reuses it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.rint(F.col("value") * 100).cast("long").alias("x"))
    e = e.withColumn("d", F.least(F.floor((F.dayofmonth("ts") - 1) / 10.0), F.lit(2)).cast("int"))
    own = Window.partitionBy("user_id", "d")
    order = own.orderBy("ts", "event_id")
    e = e.withColumn("frame", (F.row_number().over(order) - 1).cast("int")).withColumn("num_frames", F.count(F.lit(1)).over(own).cast("int"))
    e = e.withColumn("total", F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    third = F.floor(F.col("user_id") / 3.0).cast("long")
    return e.select(
        "user_id", "d", F.element_at(F.array(*map(F.lit, DOMAINS)), F.col("d") + 1).alias("domain"), F.concat(F.lit("task_"), F.col("user_id") % 3).alias("task"),
        F.concat(F.lit("u"), "user_id", F.lit("_"), "d").alias("episode"), "frame", "num_frames", "x", "total",
        (F.col("total").cast("double") / (F.col("frame") + 1) / F.lit(SCALE)).alias("v"),
        (third % 2 == 0).alias("success"), F.element_at(F.array(F.lit("r_plus"), F.lit("r_zero"), F.lit("r_minus")), (third % 3 + 1).cast("int")).alias("role"),
        F.floor(F.col("user_id") / 9.0).cast("long").alias("trr_group"), F.when(third % 2 == 0, "normal").otherwise("diverse").alias("solution"),
        F.floor(F.col("num_frames") / 2.0).cast("int").alias("onset"),
    )


EPISODE = ("user_id", "d", "domain", "task", "episode", "num_frames", "success", "role", "trr_group", "solution", "onset")


def episodes(rows: DataFrame) -> DataFrame:
    return rows.where("frame = 0").select(*EPISODE)


def curves(rows: DataFrame) -> DataFrame:
    """A row per episode with its values in frame order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda x: x["v"])
    return rows.groupBy(*EPISODE).agg(values.alias("values"))


def annotated() -> Column:
    """The annotated frames of an episode: its 5 Hz grid and the last frame."""
    return fr.grid_with_end(F.col("num_frames"), F.lit(FPS))


def cycle_curves(rows: DataFrame) -> DataFrame:
    """A row per episode with at least three annotated frames: values at them on the way up, and on the way back by the mean over the timeline from its start."""
    point = F.struct("frame", "v", "total", "x")
    whole = rows.groupBy(*EPISODE).agg(F.array_sort(F.collect_list(point)).alias("points")).withColumn("at", annotated()).where(F.size("at") >= 3)
    last, n = F.element_at("points", -1), F.col("num_frames")
    up = F.transform("at", lambda f: F.get("points", f)["v"])
    value = lambda p: (2 * last["total"] - last["x"] - (p["total"] - p["x"])).cast("double") / (2 * (n - 1) - p["frame"] + 1) / F.lit(SCALE)
    down = F.transform(F.reverse("at"), lambda f: F.when(f == n - 1, last["v"]).otherwise(value(F.get("points", f))))
    return whole.withColumn("up", up).withColumn("down", down)


#: The same in DuckDB: views fr (frames), ep (episodes).
SQL = """
ev AS (SELECT event_id, user_id, ts, CAST(round_even(value * 100, 0) AS BIGINT) AS x, CAST(least(floor((day(ts) - 1) / 10.0), 2) AS INTEGER) AS d FROM events),
fr0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
  CAST(count(*) OVER (PARTITION BY user_id, d) AS INTEGER) AS num_frames,
  CAST(sum(x) OVER (PARTITION BY user_id, d ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ev),
fr AS (SELECT user_id, d, ['id', 'env', 'emb'][d + 1] AS domain, 'task_' || (user_id % 3) AS task, 'u' || user_id || '_' || d AS episode, frame, num_frames, x, total,
  CAST(total AS DOUBLE) / (frame + 1) / 50000.0 AS v, (user_id // 3) % 2 = 0 AS success, ['r_plus', 'r_zero', 'r_minus'][CAST((user_id // 3) % 3 + 1 AS INT)] AS role,
  CAST(user_id // 9 AS BIGINT) AS trr_group, CASE WHEN (user_id // 3) % 2 = 0 THEN 'normal' ELSE 'diverse' END AS solution, num_frames // 2 AS onset FROM fr0),
ep AS (SELECT user_id, d, domain, task, episode, num_frames, success, role, trr_group, solution, onset FROM fr WHERE frame = 0)
"""
