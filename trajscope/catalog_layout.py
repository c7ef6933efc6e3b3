"""Queries of predictors, layouts, judging, streams and validation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog
from .operators import charts, judging, layout, lineage, prefix, selection
from .plans import expanded
from .plans import queries as plans
from .register import MACRO, macro, query, rounded
from .runs import execute
from .sources import scratch
from .sources import testdata as td
from .streaming import rescore

PLAYBACKS = ("forward", "reverse", "cycle")


def _features(spark, sf_dir):
    """The frames' features, written for executors to read."""
    path = scratch.fresh_path(spark, "features")
    td.frames(spark, sf_dir).select("task", "episode", "frame", "x").write.parquet(path)
    return path


#: The mean over the timeline up to each frame: from the start, from the end backwards, and up and back.
_MEANS = """
, w AS (SELECT *, sum(x) OVER (PARTITION BY episode) AS whole, last_value(x) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xl FROM fr),
m AS (SELECT task, episode, frame, 'forward' AS playback, v FROM w
  UNION ALL SELECT task, episode, frame, 'reverse', CAST(whole - total + x AS DOUBLE) / (num_frames - frame) / 50000.0 FROM w
  UNION ALL SELECT task, episode, frame, 'cycle', CAST(whole + whole - xl - (total - x) AS DOUBLE) / (2 * (num_frames - 1) - frame + 1) / 50000.0 FROM w)"""


@query(_MEANS + " SELECT episode, CAST(frame AS BIGINT) AS frame, playback, round(v, 9) + 0.0 AS score FROM m")
def prefix_values(spark, sf_dir):
    rows = td.frames(spark, sf_dir)
    features = rows.select("task", "episode", "frame", "x")
    states = rows.select("task", "episode", F.col("frame").alias("anchor"), F.explode(F.array(*map(F.lit, PLAYBACKS))).alias("playback"))
    return prefix.prefix_means(states, features).select("episode", F.col("anchor").cast("long").alias("frame"), "playback", rounded(F.col("score") / F.lit(td.SCALE), "score"))


def _plan(spark, sf_dir):
    """Values at the annotated frames of cycles, and compares of the edges."""
    e = td.episodes(td.frames(spark, sf_dir)).withColumn("instruction", F.concat(F.lit("do "), "task"))
    cycle = plans.cycle_plan(e.where(F.size(td.annotated()) >= 3), td.annotated()).withColumn("query_id", plans.query_id(F.lit("cycle_voc"), F.col("task"), F.col("episode"), F.col("position")))
    pairs = plans.pair_plan(e.drop("instruction"), e.select("task").distinct().select("task", F.lit("correct").alias("candidate"), F.concat(F.lit("do "), "task").alias("instruction")), "tga_hard")
    return execute.as_asked(cycle, "value").unionByName(execute.as_asked(pairs, "compare"))


_ANSWERED = """
, up AS (SELECT *, list_sort(list_distinct(list_concat(range(0, num_frames, 2), [CAST(num_frames - 1 AS BIGINT)]))) AS u FROM ep),
pa AS (SELECT *, list_concat(u, list_reverse(u[1:len(u) - 1])) AS path FROM up WHERE len(u) >= 3),
cy AS (SELECT *, unnest(range(0, len(path))) AS position FROM pa),
ed AS (SELECT *, unnest(range(0, k)) AS i FROM (SELECT *, greatest(1, CAST(ceil(num_frames * 0.02) AS INT)) AS k FROM ep))"""


@query(_MEANS + _ANSWERED + """
SELECT 'cycle_voc:' || cy.task || ':' || cy.episode || ':' || position AS query_id, round(m.v, 9) + 0.0 AS score FROM cy JOIN m ON m.episode = cy.episode AND m.frame = path[position + 1] AND m.playback = CASE WHEN position <= (len(path) - 1) / 2 THEN 'forward' ELSE 'cycle' END
UNION ALL SELECT 'tga_hard:' || ed.task || ':' || ed.episode || ':correct:' || i, round(b.v - a.v, 9) + 0.0 FROM ed JOIN fr a ON a.episode = ed.episode AND a.frame = i JOIN fr b ON b.episode = ed.episode AND b.frame = ed.num_frames - k + i""")
def predicted_values(spark, sf_dir):
    """Values and compares answered by the prefix predictor of the registry."""
    return execute.answered(_plan(spark, sf_dir), "prefix", {"features": _features(spark, sf_dir), "scale": td.SCALE}).select("query_id", rounded("score"))


@query(_ANSWERED + """
SELECT 'cycle_voc:' || task || ':' || episode || ':' || position AS query_id, round(path[position + 1] / 50.0::DOUBLE, 9) + 0.0 AS score FROM cy
UNION ALL SELECT 'tga_hard:' || task || ':' || episode || ':correct:' || i, round((num_frames - k) / 50.0::DOUBLE, 9) + 0.0 FROM ed""")
def echoed_values(spark, sf_dir):
    """The same plan through the batch contract, in partitions of equal cost."""
    return execute.answered(_plan(spark, sf_dir), "echo", {"scale": 50}, batch_size=16).select("query_id", rounded("score"))


#: Values of every second frame, hop by hop, and from the start and to the goal: the last frame of the task's first episode.
_HOPS = """
, a AS (SELECT *, CAST(unnest([num_frames - 1, num_frames // 2]) AS INTEGER) AS anchor FROM ep),
go AS (SELECT task, arg_max(v, frame) AS goal FROM fr WHERE episode IN (SELECT min(episode) FROM ep GROUP BY task) GROUP BY task),
h AS (SELECT DISTINCT task, episode, anchor, CAST(least(f, anchor) AS INTEGER) AS frame FROM (SELECT *, unnest(range(0, anchor + 2, 2)) AS f FROM a)),
hv AS (SELECT h.*, v, row_number() OVER (PARTITION BY h.episode, anchor ORDER BY h.frame) AS k, v - lag(v) OVER (PARTITION BY h.episode, anchor ORDER BY h.frame) AS hop FROM h JOIN fr ON fr.episode = h.episode AND fr.frame = h.frame),
fo AS (SELECT episode, anchor, k, 0.0::DOUBLE AS p FROM hv WHERE k = 1 UNION ALL SELECT hv.episode, hv.anchor, hv.k, CASE WHEN hv.hop >= 0 OR hv.k = 2 THEN fo.p + (CASE WHEN hv.k = 2 THEN 1 ELSE 1 - fo.p END) * hv.hop ELSE fo.p + fo.p * hv.hop END FROM fo JOIN hv ON hv.episode = fo.episode AND hv.anchor = fo.anchor AND hv.k = fo.k + 1),
la AS (SELECT episode, anchor, arg_max(p, k) AS p FROM fo GROUP BY ALL)
SELECT a.episode || ':' || a.anchor AS query_id, round(((x.v - z.v) + (1 + x.v - goal) + p) / 3, 9) + 0.0 AS score FROM (SELECT DISTINCT * FROM a) a JOIN la ON la.episode = a.episode AND la.anchor = a.anchor JOIN go ON go.task = a.task
  JOIN fr x ON x.episode = a.episode AND x.frame = a.anchor JOIN fr z ON z.episode = a.episode AND z.frame = 0"""


@query(f"WITH RECURSIVE {td.SQL}{_HOPS}", base=False)
def three_way_values(spark, sf_dir):
    """Value queries as compares, each different one asked once, and put together again."""
    rows = td.frames(spark, sf_dir)
    e = td.episodes(rows)
    first = rows.join(F.broadcast(e.groupBy("task").agg(F.min("episode").alias("episode"))), ["task", "episode"])
    goals = first.groupBy("task").agg(F.max("episode").alias("goal_episode"), F.max("frame").alias("goal_frame"))
    n = F.col("num_frames")
    values = e.select("task", "episode", "num_frames", F.explode(F.array_distinct(F.array(n - 1, F.floor(n / 2).cast("int")))).alias("anchor"), F.concat(F.lit("do "), "task").alias("instruction"), F.lit("forward").alias("playback"), F.lit(td.FPS).alias("fps"))
    parts = expanded.three_way(values.withColumn("query_id", F.concat_ws(":", "episode", "anchor")), goals, 5.0)
    states = rows.select("task", "episode", "frame", "v")
    side = lambda s: states.select("task", F.col("episode").alias(f"episode_{s}"), F.col("frame").alias(f"frame_{s}"), F.col("v").alias(f"v_{s}"))
    scores = expanded.asked(parts).join(side("a"), ["task", "episode_a", "frame_a"]).join(side("b"), ["task", "episode_b", "frame_b"]).select(*expanded.PAIR, (F.col("v_b") - F.col("v_a")).alias("score"))
    return expanded.three_way_values(expanded.answered(parts, scores)).select("query_id", rounded("score"))


# --- charts -------------------------------------------------------------------


@query(catalog._CYCLE + """,
c AS (SELECT episode, n_path AS n, list(v ORDER BY position) AS vs, min(v) AS lo, max(v) AS hi FROM cv GROUP BY ALL),
p AS (SELECT episode, n, list_transform(range(0, n), lambda i: 12 + i * (456.0::DOUBLE / greatest(n - 1, 1))) AS xs, list_transform(vs, lambda v: 148 - coalesce((v - lo) / nullif(hi - lo, 0), 0.5) * 136.0::DOUBLE) AS ys,
  list_transform(range(0, n), lambda i: 148 - least(i, n - 1 - i) / greatest((n - 1) / 2.0::DOUBLE, 0.5) * 136) AS ts FROM c)
SELECT episode, array_to_string(list_transform(range(1, n + 1), lambda i: printf('%.1f,%.1f', floor(xs[i] * 10 + 0.5) / 10, floor(ys[i] * 10 + 0.5) / 10)), ' ') AS points,
  array_to_string(list_transform(range(1, n + 1), lambda i: printf('%.1f,%.1f', floor(xs[i] * 10 + 0.5) / 10, floor(ts[i] * 10 + 0.5) / 10)), ' ') AS ideal FROM p""")
def cycle_charts(spark, sf_dir):
    """Cycles drawn over the ideal triangle: the lines of each chart."""
    drawn = charts.cycle_charts(td.cycle_curves(catalog._normal(td.frames(spark, sf_dir))))
    lines = F.regexp_extract_all("svg", F.lit('points="([^"]*)"'), F.lit(1))
    return drawn.select("episode", F.get(lines, F.lit(1)).alias("points"), F.get(lines, F.lit(0)).alias("ideal"))


@query("""
, s AS (SELECT domain, task, episode, CAST(sum(x) AS DOUBLE) / count(*) AS score FROM fr GROUP BY ALL),
b AS (SELECT *, 'best' AS place, row_number() OVER (PARTITION BY domain, task ORDER BY score DESC, episode) AS number FROM s UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY domain, task ORDER BY score, episode) FROM s)
SELECT domain, task, place, number, episode FROM b WHERE number <= 3""")
def selected_curves(spark, sf_dir):
    """The three best and worst episodes of each cell, by their mean: what a sheet shows."""
    scores = td.frames(spark, sf_dir).groupBy("domain", "task", "episode").agg((F.sum("x").cast("double") / F.count(F.lit(1))).alias("score"))
    return charts.selected(scores, "score", 3).select("domain", "task", "place", F.col("number").cast("long").alias("number"), "episode")


# --- layout -------------------------------------------------------------------


@query(" SELECT 8 AS partitions, count(*) AS n_queries, CAST(sum(frame + 1) AS BIGINT) AS cost, true AS even FROM fr")
def balanced_partitions(spark, sf_dir):
    """All prefixes of all episodes in eight partitions; the costliest is within 1.2 of the mean."""
    laid = layout.balanced(td.frames(spark, sf_dir).select("task", "episode", "frame"), ["task", "episode"], "frame", F.col("frame") + 1, 8)
    loads = laid.groupBy(F.spark_partition_id().alias("at"), "partition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("frame") + 1).alias("c"))
    return loads.agg(F.count_distinct("at").cast("int").alias("partitions"), F.sum("n").alias("n_queries"), F.sum("c").cast("long").alias("cost"), (F.max("c") <= 1.2 * F.sum("c") / 8).alias("even"))


@query("""
SELECT episode, CAST(frame AS BIGINT) AS frame, CAST((row_number() OVER (PARTITION BY task, frame ORDER BY episode) - 1) // greatest(1, 64 // (frame + 1)) AS BIGINT) AS batch FROM fr""")
def packed_batches(spark, sf_dir):
    """Prefixes of equal length and instruction, as many to a batch as 64 frames allow."""
    rows = td.frames(spark, sf_dir).select("task", "episode", "frame", (F.col("frame") + 1).alias("n_frames"))
    return layout.packed(rows, ["task"], "n_frames", ["episode"]).select("episode", F.col("frame").cast("long").alias("frame"), "batch")


# --- judging, streams, validation ---------------------------------------------


@query("SELECT p_partkey, upper(p_type) || ' ' || length(p_type) AS answer FROM part", base=False)
def cached_answers(spark, sf_dir):
    """A judge that is asked once for each different request; the second call finds all in the cache."""
    requests = td.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("request"))
    cache = scratch.fresh_path(spark, "judged")
    judging.answers(spark, requests.where("p_partkey % 2 = 0"), lambda r: f"{r.upper()} {len(r)}", cache, delay=0.0)
    return judging.answers(spark, requests, lambda r: f"{r.upper()} {len(r)}", cache, delay=0.0).select("p_partkey", "answer")


@query(", s AS (SELECT domain, task, episode, avg(v) AS score FROM fr GROUP BY ALL)" + MACRO)
def stream_scores(spark, sf_dir):
    """Macro means from sums that three batches have merged, each a part of every episode; the last batch comes twice."""
    path = scratch.fresh_path(spark, "arrived")
    td.frames(spark, sf_dir).select("domain", "task", "episode", F.col("v").alias("score"), (F.col("frame") % 3).alias("part")).write.partitionBy("part").parquet(path)
    state = rescore.CellScores(spark, scratch.fresh_path(spark, "scores"))
    for batch in (0, 1, 2, 2):
        state.add(spark.read.parquet(f"{path}/part={batch}"), batch)
    return macro(state.episodes())


@query("""
, d AS (SELECT 0 AS place, 'plan' AS stage, count(*) FILTER (user_id % 11 = 3) AS n FROM ep UNION ALL SELECT 1, 'answers', count(*) FILTER (x % 13 = 5) FROM fr
UNION ALL SELECT 2, 'records', count(*) FILTER (user_id % 7 = 2) FROM ep)
SELECT 0 AS place, 'plan' AS stage, 'changed' AS difference, n FROM d WHERE place = 0 UNION ALL SELECT 1, 'answers', 'missing', n FROM d WHERE place = 1
UNION ALL SELECT 1, 'answers', 'extra', 1 UNION ALL SELECT 2, 'records', 'changed', n FROM d WHERE place = 2""")
def stage_differences(spark, sf_dir):
    """Saved stages against recomputed ones, with changes planted in each: other targets, lost and foreign answers, scores that are off by more than rounding."""
    rows = td.frames(spark, sf_dir)
    episodes = td.episodes(rows).withColumn("target", F.col("onset"))
    scores = rows.groupBy("user_id", "d", "episode").agg(F.avg("v").alias("score"))
    off = F.when(F.col("user_id") % 7 == 2, 1e-3).otherwise(1e-13)
    u = F.col("user_id")

    def stages(e, a, r):
        answers = lineage.stage(1, "answers", a, ["episode", "frame"], number="v")
        return lineage.stage(0, "plan", e, ["episode"], ["task", "target"]).unionByName(answers).unionByName(lineage.stage(2, "records", r, ["episode"], number="score"))

    saved = stages(episodes, rows, scores)
    foreign = spark.createDataFrame([("nobody", 0, 0.5)], "episode string, frame int, v double")
    now = stages(
        episodes.withColumn("target", F.when(u % 11 == 3, F.col("target") + 1).otherwise(F.col("target"))),
        rows.where("x % 13 <> 5").select("episode", "frame", "v").unionByName(foreign),
        scores.withColumn("score", F.col("score") + off),
    )
    return lineage.summary(lineage.differences(saved, now)).select("place", "stage", "difference", "n")


@query(" SELECT task, round(median(v), 9) + 0.0 AS median FROM fr GROUP BY ALL")
def task_medians(spark, sf_dir):
    return selection.medians(td.frames(spark, sf_dir), ["task"], "v").select("task", rounded("median"))
