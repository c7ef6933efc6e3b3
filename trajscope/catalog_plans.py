"""Queries of cohorts, audits, plans and identification, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import frames as fr
from .operators import checked, metrics, positions, reuse, statistics
from .plans import audits, cohorts, identify
from .plans import queries as plans
from .register import MACRO, macro, query, rounded
from .sources import scratch, wire
from .sources import testdata as td


def _episodes(spark, sf_dir):
    return td.episodes(td.frames(spark, sf_dir))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- cohorts ------------------------------------------------------------------

_DECLARED = {"task_0": ["SA", "VOC", "TGA"], "task_1": ["SA", "CYCLE-VOC", "CSPC", "FPL"], "task_2": ["VOC-MEM", "TRR", "SIA"]}
_ASKED = {"sa": "SA", "voc": None, "cycle_voc": None, "vs": None, "voc_mem": "VOC-MEM", "tga_easy": "TGA", "tga_hard": "TGA", "csvc": "CSPC", "fpl": "FPL", "trr": "TRR", "sia": "SIA"}


@query(f""", m AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{t}')" for m, name in _ASKED.items() for t, own in _DECLARED.items() if (name in own if name else {'VOC', 'CYCLE-VOC'} & set(own)))}) x(metric, task))
SELECT metric, task, (SELECT count(*) FROM ep WHERE ep.task = m.task) AS n FROM m WHERE EXISTS (SELECT 1 FROM ep WHERE ep.task = m.task)""")
def declared_tasks(spark, sf_dir):
    tasks = spark.createDataFrame(list(_DECLARED.items()), "task string, metrics array<string>")
    own = _episodes(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    parts = [tasks.where(cohorts.declares(F.col("metrics"), m)).select(F.lit(m).alias("metric"), "task") for m in _ASKED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(own, "task").select("metric", "task", "n")


_MADE = """, ma AS (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN NULL ELSE trr_group END AS trr_group, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN 'other' ELSE solution END AS solution) FROM ep)"""


def _made(spark, sf_dir):
    """Episodes of which some are in no group, and some have no solution or another one."""
    u = F.col("user_id")
    e = _episodes(spark, sf_dir).withColumn("trr_group", F.when(u % 2 != 0, F.col("trr_group")))
    return e.withColumn("solution", F.when(u % 5 == 0, F.lit(None)).when(u % 5 == 1, "other").otherwise(F.col("solution")))


@query(_MADE + """
SELECT 'sa' AS cohort, domain, task, count(*) AS n FROM ma GROUP BY ALL
UNION ALL SELECT 'tga', domain, task, count(*) FROM ma WHERE success AND trr_group IS NULL AND solution IS DISTINCT FROM 'diverse' GROUP BY ALL
UNION ALL SELECT 'fpl', domain, task, count(*) FROM ma WHERE onset IS NOT NULL AND role IS DISTINCT FROM 'r_zero' GROUP BY ALL
UNION ALL SELECT 'sia', domain, task, count(*) FROM ma WHERE solution IS NULL OR solution IN ('normal', 'diverse') GROUP BY ALL""")
def cohort_sizes(spark, sf_dir):
    e = _made(spark, sf_dir)
    parts = {"sa": cohorts.value_accuracy(e)[0], "tga": cohorts.grounding(e), "fpl": cohorts.failure_point(e), "sia": identify.cohort(e)}
    out = None
    for name, rows in parts.items():
        n = rows.groupBy("domain", "task").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("cohort"), "domain", "task", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(" SELECT domain, task, count(*) FILTER (success AND domain <> 'env') AS successes, count(*) FILTER (NOT (success AND domain <> 'env')) AS failures FROM ep GROUP BY ALL HAVING successes = 0 OR failures = 0")
def one_sided_cells(spark, sf_dir):
    return audits.one_sided_cells(_episodes(spark, sf_dir).withColumn("success", F.col("success") & (F.col("domain") != "env")))


@query(" SELECT domain, task, trr_group, CASE WHEN user_id % 4 = 0 THEN 'r_plus' ELSE role END AS role, count(*) AS n FROM ep GROUP BY ALL HAVING count(*) > 1")
def repeated_roles(spark, sf_dir):
    return audits.repeated_roles(_episodes(spark, sf_dir).withColumn("role", F.when(F.col("user_id") % 4 == 0, "r_plus").otherwise(F.col("role"))))


@query(" SELECT domain, task, episode, len(range(0, num_frames, 12)) AS n_points, len(range(0, num_frames, 12)) < 2 AS short FROM ep WHERE success")
def memory_cohort(spark, sf_dir):
    e = _episodes(spark, sf_dir).where("success").withColumn("voc_mem", F.sequence(F.lit(0), F.col("num_frames") - 1, F.lit(12)))
    short = audits.short_memories(e).select("domain", "task", "episode", F.lit(True).alias("found"))
    return e.join(short, ["domain", "task", "episode"], "left").select("domain", "task", "episode", F.size("voc_mem").cast("long").alias("n_points"), F.coalesce("found", F.lit(False)).alias("short"))


@query(" SELECT task, count(*) FILTER (success AND solution = 'normal') AS n_normal, count(*) FILTER (success AND solution = 'diverse') AS n_diverse FROM ep WHERE domain = 'id' GROUP BY ALL HAVING n_normal = 0 OR n_diverse = 0")
def solution_gaps(spark, sf_dir):
    return audits.solution_gaps(_episodes(spark, sf_dir))


@query(" SELECT episode, k, CAST((num_frames * k) // 12 AS BIGINT) AS start, CAST((num_frames * (k + 1)) // 12 AS BIGINT) AS \"end\" FROM (SELECT *, unnest(range(0, 12)) AS k FROM ep) WHERE (num_frames * (k + 1)) // 12 - (num_frames * k) // 12 <= 1")
def point_spans(spark, sf_dir):
    return audits.point_spans(_pieces(_episodes(spark, sf_dir), 12)).select("episode", *_long("k", "start", "end"))


def _pieces(episodes, n: int):
    e = episodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    at = lambda i: F.floor(F.col("num_frames") * (F.col("k") + i) / n).cast("int")
    return e.withColumn("start", at(0)).withColumn("end", at(1))


@query("""
, g AS (SELECT domain, task, episode, count(*) AS m FROM fr WHERE success AND solution = 'normal' AND frame % 2 = 0 GROUP BY ALL)
SELECT domain, task, coalesce(CASE WHEN m < 7 THEN 'fewer_than_seven_samples' END, 'kept') AS reason, count(*) AS n, CAST(sum(m) AS BIGINT) AS n_queries FROM g GROUP BY ALL""")
def smoothness_plan(spark, sf_dir):
    e = _episodes(spark, sf_dir).where("success AND solution = 'normal'")
    n = F.size(fr.grid(F.col("num_frames"), F.lit(td.FPS), 5.0))
    return e.groupBy("domain", "task", F.coalesce(audits.sample_exclusion(n), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).cast("long").alias("n_queries"))


@query(" SELECT episode, CAST(frame AS BIGINT) AS frame FROM fr WHERE frame % 2 = 0 AND x % 7 = 0")
def uncovered_frames(spark, sf_dir):
    rows = td.frames(spark, sf_dir)
    grid = plans.grid_plan(td.episodes(rows), td.FPS, with_end=False).select("user_id", "d", "episode", F.col("anchor").alias("frame"))
    return audits.uncovered_frames(grid, rows.where("x % 7 <> 0"), ["user_id", "d"]).select("episode", *_long("frame"))


@query(" SELECT task, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM ep WHERE NOT (task = 'task_1' AND domain = 'emb') GROUP BY ALL HAVING count(DISTINCT domain) < 3")
def uneven_domains(spark, sf_dir):
    return audits.uneven_domains(_episodes(spark, sf_dir).where("NOT (task = 'task_1' AND domain = 'emb')"))


@query("""
SELECT query_id, rule FROM (SELECT episode || ':' || (user_id % 50) AS query_id, CASE WHEN user_id % 11 = 0 THEN 'unknown_episode' WHEN user_id % 7 = 0 AND user_id % 3 <> 0 THEN 'other_task' WHEN user_id % 50 >= num_frames OR user_id % 50 - 3 < 0 OR user_id % 50 - 3 >= num_frames THEN 'outside' END AS rule FROM ep) WHERE rule IS NOT NULL""")
def bad_anchors(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    u = F.col("user_id")
    q = e.select(F.concat_ws(":", "episode", u % 50).alias("query_id"), "task", F.when(u % 11 == 0, "nowhere").otherwise(F.col("episode")).alias("episode"), (u % 50).alias("anchor"), F.when(u % 7 == 0, "task_0").otherwise(F.col("task")).alias("task_b"), (u % 50 - 3).alias("anchor_b"))
    return audits.bad_anchors(q, e)


@query("""
SELECT n_name AS baseline, m.metric, t.task FROM nation, (SELECT unnest(['sa', 'vs', 'sia', 'csvc']) AS metric) m, (SELECT unnest(['task_0', 'task_1']) AS task) t
WHERE NOT ((n_name = 'FRANCE' AND m.metric = 'vs') OR (n_name = 'CHINA' AND t.task = 'task_1') OR m.metric = 'csvc' AND t.task = 'task_0')""", base=False)
def policy_cells(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation").select(F.col("n_name").alias("baseline"))
    cells = n.select("*", F.explode(F.array(*map(F.lit, ("sa", "vs", "sia", "csvc")))).alias("metric")).select("*", F.explode(F.array(F.lit("task_0"), F.lit("task_1"))).alias("task"))
    rules = spark.createDataFrame([("FRANCE", "vs", None), ("CHINA", None, "task_1"), (None, "csvc", "task_0")], "baseline string, metric string, task string")
    return cohorts.policy_filter(cells, rules).select("baseline", "metric", "task")


# --- plans --------------------------------------------------------------------


@query("""
, ca AS (SELECT unnest(['correct', 'counterfactual-001', 'counterfactual-002']) AS candidate), ed AS (SELECT *, greatest(1, CAST(ceil(num_frames * 0.02) AS INT)) AS k FROM ep WHERE success)
SELECT 'tga_hard:' || task || ':' || episode || ':' || candidate || ':' || i AS query_id, CAST(i AS BIGINT) AS anchor_a, CAST(num_frames - k + i AS BIGINT) AS anchor_b FROM (SELECT *, unnest(range(0, k)) AS i FROM ed), ca""")
def pair_queries(spark, sf_dir):
    e = _episodes(spark, sf_dir).where("success")
    candidates = spark.createDataFrame([(f"task_{t}", c) for t in range(3) for c in ("correct", "counterfactual-001", "counterfactual-002")], "task string, candidate string")
    return plans.pair_plan(e, F.broadcast(candidates), "tga_hard").select("query_id", *_long("anchor_a", "anchor_b"))


@query("""
SELECT DISTINCT episode, fps, CAST(frame AS BIGINT) AS frame FROM (SELECT episode, num_frames, fps, round_even(i * fps / 5.0, 0) AS frame FROM (SELECT episode, num_frames, unnest([10.0, 12.0, 25.0])::DOUBLE AS fps FROM ep), (SELECT unnest(range(0, 400)) AS i)) WHERE frame < num_frames""")
def inner_grid(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    parts = [plans.grid_plan(e, fps, with_end=False).select("episode", F.lit(fps).alias("fps"), F.col("anchor").cast("long").alias("frame")) for fps in (10.0, 12.0, 25.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT episode, k, CAST(CASE WHEN a + ceil((b - a) * 0.2) < a + floor((b - a) * 0.8) THEN a + ceil((b - a) * 0.2) ELSE a END AS BIGINT) AS "from", CAST(CASE WHEN a + ceil((b - a) * 0.2) < a + floor((b - a) * 0.8) THEN a + floor((b - a) * 0.8) ELSE b END AS BIGINT) AS "to"
FROM (SELECT *, (num_frames * k) // 4 AS a, (num_frames * (k + 1)) // 4 AS b FROM (SELECT *, unnest(range(0, 4)) AS k FROM ep))""")
def middle_windows(spark, sf_dir):
    w = fr.middle_window(F.col("start"), F.col("end"))
    return _pieces(_episodes(spark, sf_dir), 4).select("episode", F.col("k").cast("long").alias("k"), w["from"].cast("long").alias("from"), w["to"].cast("long").alias("to"))


_REUSE = """, s AS (SELECT domain, task, episode, frame, v FROM fr WHERE success AND solution = 'normal' AND num_frames >= 4 AND (frame % 2 = 0 OR frame = num_frames - 1))"""


def _cycle_states(spark, sf_dir):
    rows = td.frames(spark, sf_dir).where("success AND solution = 'normal'")
    made = plans.cycle_plan(td.episodes(rows).where(F.size(td.annotated()) >= 3), td.annotated()).withColumn("instruction", F.concat(F.lit("do "), "task"))
    source = made.withColumn("query_id", plans.query_id(F.lit("cycle_voc"), F.col("task"), F.col("episode"), F.col("position")))
    values = rows.select("episode", F.col("frame").alias("anchor"), "v")
    # on the way back a state has a value of its own
    predictions = source.join(values, ["episode", "anchor"]).select("query_id", F.when(F.col("playback") == "forward", F.col("v")).otherwise(-F.col("v")).alias("score"), F.lit("value").alias("op"))
    return source, predictions


@query(_REUSE + " SELECT 'vs:' || task || ':' || episode || ':' || frame AS query_id, round(v, 9) + 0.0 AS score FROM s")
def reused_states(spark, sf_dir):
    source, predictions = _cycle_states(spark, sf_dir)
    plan = source.where("playback = 'forward'").withColumn("query_id", plans.query_id(F.lit("vs"), F.col("task"), F.col("episode"), F.col("anchor")))
    return reuse.from_states(plan, source, predictions).select("query_id", rounded("score"))


@query("""
, up AS (SELECT *, list_sort(list_distinct(list_concat(range(0, num_frames, 2), [CAST(num_frames - 1 AS BIGINT)]))) AS u FROM ep WHERE success AND solution = 'normal'), pa AS (SELECT *, list_concat(u, list_reverse(u[1:len(u) - 1])) AS path FROM up WHERE len(u) >= 3),
cy AS (SELECT *, unnest(range(0, len(path))) AS position FROM pa)
SELECT 'voc:' || cy.task || ':' || cy.episode || ':' || position AS query_id, round(CASE WHEN position <= (len(path) - 1) / 2 THEN v ELSE -v END, 9) + 0.0 AS score FROM cy JOIN fr ON fr.episode = cy.episode AND fr.frame = path[position + 1]""")
def reused_ids(spark, sf_dir):
    return reuse.renamed(_cycle_states(spark, sf_dir)[1], "cycle_voc", "voc").select("query_id", rounded("score"))


# --- identification -----------------------------------------------------------

_SPANS = """, sp AS (SELECT *, (num_frames * k) // 3 AS a, (num_frames * (k + 1)) // 3 AS b, CASE WHEN user_id % 4 = 0 THEN lpad(CAST(3 - k AS VARCHAR), 3, '0') ELSE 'step' || (3 - k) END AS id FROM (SELECT *, unnest(range(0, 3)) AS k FROM ep)),
rl AS (SELECT *, CASE WHEN solution = 'diverse' AND user_id % 4 <> 0 THEN lpad(CAST(k + 1 AS VARCHAR), 3, '0') ELSE id END AS target FROM sp)"""


def _spans(episodes):
    """Thirds, numbered against time or named."""
    name = F.when(F.col("user_id") % 4 == 0, F.lpad((3 - F.col("k")).cast("string"), 3, "0")).otherwise(F.concat(F.lit("step"), 3 - F.col("k")))
    return _pieces(episodes, 3).withColumn("id", name).select("task", "episode", "solution", "id", "start", "end")


@query(_SPANS + """
SELECT episode, id, target, k + 1 AS ordinal, CASE WHEN k = 2 THEN 'last' ELSE 'touches' END AS link FROM rl""")
def span_labels(spark, sf_dir):
    return identify.relabelled(_spans(_episodes(spark, sf_dir))).select("episode", "id", "target", *_long("ordinal"), "link")


@query("""
, sp AS (SELECT *, (num_frames * k) // 3 + CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END AS a, (num_frames * (k + 1)) // 3 + CASE WHEN user_id % 3 = 2 THEN 1 ELSE 0 END AS b FROM (SELECT *, unnest(range(0, 3)) AS k FROM ep))
SELECT episode, CASE WHEN k = 2 THEN 'last' WHEN user_id % 3 = 1 THEN 'gap' WHEN user_id % 3 = 2 THEN 'overlaps' ELSE 'touches' END AS link, count(*) AS n FROM sp GROUP BY ALL""")
def span_links(spark, sf_dir):
    e = _pieces(_episodes(spark, sf_dir), 3).withColumn("start", F.col("start") + (F.col("user_id") % 3 == 1).cast("int")).withColumn("end", F.col("end") + (F.col("user_id") % 3 == 2).cast("int")).withColumn("id", F.col("k").cast("string"))
    return audits.span_order(e, ["task", "episode"]).groupBy("episode", "link").agg(F.count(F.lit(1)).alias("n"))


@query(_SPANS + """
, pt AS (SELECT episode, CAST(frame AS BIGINT) AS frame FROM fr)
SELECT pt.episode, pt.frame, 1 AS n_spans, target FROM pt JOIN rl ON rl.episode = pt.episode AND frame >= a AND frame < b""")
def spans_of_frames(spark, sf_dir):
    rows = td.frames(spark, sf_dir)
    points = rows.select("task", "episode", "frame")
    return identify.span_of_frame(points, identify.relabelled(_spans(td.episodes(rows)))).select("episode", *_long("frame", "n_spans"), "target")


_DRAWN = _SPANS + """
, wi AS (SELECT *, 'sia:' || task || ':' || episode || ':' || target AS query_id, CASE WHEN a + ceil((b - a) * 0.2) < a + floor((b - a) * 0.8) THEN a + ceil((b - a) * 0.2) ELSE a END AS lo, CASE WHEN a + ceil((b - a) * 0.2) < a + floor((b - a) * 0.8) THEN a + floor((b - a) * 0.8) ELSE b END AS hi FROM rl),
pl AS (SELECT *, CAST(lo + CAST('0x' || substr(md5('0:' || query_id), 1, 8) AS BIGINT) % CAST(hi - lo AS BIGINT) AS BIGINT) AS anchor FROM wi)"""


def _asked(spark, sf_dir):
    e = _episodes(spark, sf_dir).withColumn("instruction", F.concat(F.lit("do "), "task"))
    return identify.plan(e, _spans(e).drop("solution"))


@query(_DRAWN + " SELECT query_id, domain, target, anchor FROM pl")
def identification_plan(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", "domain", "target", *_long("anchor"))


@query(_DRAWN + """
, s AS (SELECT domain, task, exp(avg(-(anchor % 50) / 25.0::DOUBLE)) AS score FROM pl WHERE domain <> 'emb' GROUP BY ALL)""" + MACRO)
def identification_bundle(spark, sf_dir):
    """Plan, answers, bundle on disk, strict reading, selection, judgements, score."""
    planned = _asked(spark, sf_dir)
    names = [f"{k:03d}" for k in range(1, 4)] + [f"step{k}" for k in range(1, 4)]
    candidates = spark.createDataFrame([(f"task_{t}", {n: f"part {n}" for n in names}) for t in range(3)], "task string, candidates map<string,string>")
    path = scratch.fresh_path(spark, "bundle")
    identify.write_bundle(identify.bundle(planned, planned.select("query_id", F.concat(F.lit("it is "), "target").alias("output")), F.broadcast(candidates)), path)
    items = identify.select_items(identify.read_bundle(spark, path), domains=["id", "env"])
    said = items.select(F.col("query.query_id").alias("query_id"), F.create_map("target_subtask_id", -(F.col("query.anchor_frame") % 50) / F.lit(25.0)).alias("logprobs"))
    return macro(metrics.identification(identify.judged(items, said)))


@query("""
, g AS (SELECT domain, task, trr_group FROM ep GROUP BY ALL HAVING count(DISTINCT role) = 3)
SELECT domain, task, trr_group, row_number() OVER (ORDER BY domain, task, trr_group) - 1 AS ordinal FROM g""")
def group_ordinals(spark, sf_dir):
    return audits.group_ordinals(_episodes(spark, sf_dir)).select("domain", "task", "trr_group", *_long("ordinal"))


# --- results ------------------------------------------------------------------


@query("SELECT CAST(event_id AS VARCHAR) AS query_id FROM events WHERE event_id % 17 = 3 ORDER BY 1 LIMIT 3", base=False)
def missing_samples(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("query_id"))
    return audits.missing_samples(e, e.where("cast(query_id as long) % 17 <> 3"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS ord FROM events", base=False)
def plan_order(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), "ts")
    plan = positions.numbered(e, [F.col("ts"), F.col("query_id")])
    return audits.in_plan_order(e.select("query_id"), plan).select(F.col("query_id").alias("event_id"), (F.col("ord") + 1).cast("long").alias("ord"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 = 0", base=False)
def pending_queries(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").select("event_id", "event_type")
    done = checked.union_parts([e.where("event_id % 5 = 0").select("event_id"), e.where("event_id % 5 <> 0 AND event_id % 7 <> 0").select("event_id")], "event_id")
    return checked.pending(e, done, ["event_id"])


@query(" SELECT task, round(avg(s), 9) + 0.0 AS score FROM (SELECT task, domain, avg(v) AS s FROM fr GROUP BY ALL) GROUP BY ALL")
def task_means(spark, sf_dir):
    return statistics.task_means(td.frames(spark, sf_dir), "v").select("task", rounded("score"))


@query(" SELECT domain, round(avg(v), 9) + 0.0 AS mean FROM fr GROUP BY ALL")
def checked_mean(spark, sf_dir):
    return td.frames(spark, sf_dir).groupBy("domain").agg(statistics.mean_or_raise("v", "a domain").alias("mean")).select("domain", rounded("mean"))


@query("SELECT 'value' AS op, 'q' || event_id AS query_id, CAST(event_id % 40 AS BIGINT) AS anchor FROM events", base=False)
def queries_round_trip(spark, sf_dir):
    """Written as JSONL and read back by the strict reader."""
    state = F.struct(F.lit("t").alias("task_id"), F.col("user_id").cast("string").alias("episode_id"), (F.col("event_id") % 40).cast("int").alias("anchor_frame"))
    q = td.table(spark, sf_dir, "events").select(F.concat(F.lit("q"), "event_id").alias("query_id"), F.lit("value").alias("op"), state.alias("state"), F.lit("do it").alias("instruction"))
    path = scratch.fresh_path(spark, "queries")
    wire.write_jsonl(q, path)
    return wire.read_queries(spark, path).select("op", "query_id", F.col("state.anchor_frame").cast("long").alias("anchor"))


@query("SELECT 'q' || event_id AS query_id, round((event_id % 97) / 7.0::DOUBLE, 9) + 0.0 AS score FROM events", base=False)
def results_round_trip(spark, sf_dir):
    r = td.table(spark, sf_dir, "events").select(F.concat(F.lit("q"), "event_id").alias("query_id"), F.lit("value").alias("op"), ((F.col("event_id") % 97) / F.lit(7.0)).alias("score"))
    path = scratch.fresh_path(spark, "results")
    wire.write_jsonl(r, path)
    return wire.read_results(spark, path).select("query_id", rounded("score"))
