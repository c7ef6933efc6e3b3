"""Queries of names, answers, kernels, reports and charts, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import frames as fr
from .functions import kernels as kn
from .functions import naming as nm
from .functions import sequences as sq
from .functions import text as tx
from .operators import board, charts, checked, statistics
from .plans import queries as plans
from .register import query, rounded
from .sources import dataset, lerobot
from .sources import testdata as td


def _episodes(spark, sf_dir):
    return td.episodes(td.frames(spark, sf_dir))


def _joined(frames):
    return F.array_join(F.transform(frames, lambda x: x.cast("string")), ",")


# --- names --------------------------------------------------------------------

#: Models of the parts in turn: model, what precedes the size in a checkpoint's name and follows it, backend, shot.
_MODELS = [
    ("topreward", "m/Qwen-", "B/", None, None), ("topreward", "x/MolmoAct ", "B", "molmo", None), ("robodopamine", "GRM-2.0-", "B-preview", None, None), ("robodopamine", "a/grm-", "b", None, None),
    ("rynnvalue", "rynn-", "b-x", None, None), ("vlac", "VLAC-", "b", None, "one_shot"), ("vlac", None, None, None, "zero_shot"), ("procvlm", "p", "", None, "lora"), ("procvlm", "p", "", None, None),
    ("roboreward", "RoboReward ", "", None, None), ("liv", "liv", "", None, None), (None, None, None, None, None),
]
_PICK = ", ".join("(" + ", ".join(str(k) if i == 0 else "NULL" if x is None else f"'{x}'" for i, x in enumerate((k, *row))) + ")" for k, row in enumerate(_MODELS))


@query(f"""
WITH m(k, model, pre, post, backend, shot) AS (VALUES {_PICK}),
q AS (SELECT p_partkey, m.*, pre || p_size || post AS checkpoint, p_size AS z, trim(regexp_replace(string_split(lower(rtrim(pre || p_size || post, '/')), '/')[-1], '[^a-z0-9._-]+', '-', 'g'), '-') AS safe FROM part JOIN m ON k = p_partkey % {len(_MODELS)})
SELECT p_partkey, CASE
  WHEN model = 'topreward' AND backend = 'molmo' THEN 'topreward_molmo__' || safe
  WHEN model = 'topreward' AND z = 32 THEN 'topreward_qwen32b' WHEN k = 2 AND z IN (4, 8) THEN 'robodopamine_2_0_' || z || 'b_preview' WHEN k = 3 AND z IN (3, 4, 8) THEN 'robodopamine_' || z || 'b'
  WHEN k = 4 AND z IN (4, 8) THEN 'rynnvalue_' || z || 'b' WHEN k = 5 AND z IN (2, 8) THEN 'vlac_' || z || 'b_one_shot' WHEN k = 6 THEN 'vlac__unknown_zero_shot'
  WHEN k IN (0, 2, 3, 4, 5, 9) THEN model || '__' || safe || CASE WHEN k = 5 THEN '_one_shot' ELSE '' END WHEN k = 7 THEN 'procvlm_one-shot' ELSE coalesce(model, 'unknown') END AS name FROM q""", base=False)
def baseline_names(spark, sf_dir):
    models = spark.createDataFrame([(k, *row) for k, row in enumerate(_MODELS)], "k int, model string, pre string, post string, backend string, shot string")
    p = td.table(spark, sf_dir, "part").withColumn("k", (F.col("p_partkey") % len(_MODELS)).cast("int")).join(F.broadcast(models), "k")
    return p.select("p_partkey", nm.baseline_name(F.col("model"), F.concat("pre", "p_size", "post"), F.col("backend"), F.col("shot")).alias("name"))


@query("""
SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS task, p_brand || '__sia-judge-' || regexp_replace(p_type, '[^A-Za-z0-9._-]+', '-', 'g') AS judged,
  lower(p_brand) AS metric, p_type AS target, upper(substr(sha256('{"op":"value","task":"' || p_type || '","anchor":' || p_size || '}'), 1, 12)) AS digest FROM part""", base=False)
def part_names(spark, sf_dir):
    p = td.table(spark, sf_dir, "part")
    name = F.concat_ws(":", F.lower("p_brand"), "p_brand", "p_type")
    payload = checked.digest(F.lit("value").alias("op"), F.col("p_type").alias("task"), F.col("p_size").alias("anchor"))
    return p.select("p_partkey", nm.task_name(F.col("p_name")).alias("task"), nm.judged_name(F.col("p_brand"), F.col("p_type")).alias("judged"), nm.query_metric(name).alias("metric"), nm.query_target(name).alias("target"), F.upper(F.substring(payload, 1, 12)).alias("digest"))


# --- answers ------------------------------------------------------------------

#: Forms of answers by documents in turn, with an action {p} and a percentage {n}: text, subtask of a list, progress in per cent, subtask before a verdict, verdict.
_ANSWERS = [
    (r"- {p}\n- put it down\nTherefore, the estimated progress is <progress>{n}%</progress>.", "{p}", "{n}", None, None),
    ("1.) 003: {p}  now\n2.) close it", "{p} now", None, None, None),
    ("00\n5: {p}", "{p}", None, None, None),
    ("The arm should {p}. Therefore, the estimated progress is <progress> {n}.5 %</progress>", "The arm should {p}.", "{n}.5", None, None),
    ("This task is finished because {p}", "All tasks are completed.", "100", None, None),
    (r"well \<progr\ess>100.0%\</progr\ess> {p}", "All tasks are completed.", "100", None, None),
    ("&lt;progress&gt;{n}%&lt;/progress&gt; {p}", None, "{n}", None, None),
    ("Place the &quot;{p}&quot;&nbsp;&eacute;&#233;&#x2014;&copy.", 'Place the "{p}"\u00a0\u00e9\u00e9\u2014\u00a9.', None, None, None),
    ("Subtask: {p} yes block. Yes, done", None, None, "{p} yes block.", "yes"),
    ("Subtask: {p} no", None, None, "{p}", "no"),
    ("Hold {p}. No", None, None, "Hold {p}.", "no"),
    ("nothing {p}", None, None, None, None),
]


def _form(text: str | None) -> str:
    """The SQL of a form."""
    if text is None:
        return "NULL"
    parts = [x for x in re.split(r"(\{[pn]\})", text) if x]
    return " || ".join({"{p}": "p", "{n}": "n"}.get(x) or "'" + x.replace("'", "''") + "'" for x in parts)


@query(f"""
WITH d AS (SELECT doc_id, doc_id % {len(_ANSWERS)} AS k, 'move ' || source || ' to ' || lang AS p, CAST(doc_id % 100 AS VARCHAR) AS n FROM documents)
SELECT doc_id, {', '.join(f"CASE k {' '.join(f'WHEN {k} THEN {_form(row[i])}' for k, row in enumerate(_ANSWERS))} END AS {name}" for i, name in ((1, 'listed'), (3, 'labelled'), (4, 'verdict')))},
  CAST(CASE k {' '.join(f'WHEN {k} THEN {_form(row[2])}' for k, row in enumerate(_ANSWERS))} END AS DOUBLE) / 100.0::DOUBLE AS progress FROM d""", base=False)
def answer_grammar(spark, sf_dir):
    forms = spark.createDataFrame([(k, row[0]) for k, row in enumerate(_ANSWERS)], "k int, form string")
    rows = td.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(_ANSWERS)).cast("int").alias("k"), F.concat_ws(" ", F.lit("move"), "source", F.lit("to"), "lang").alias("p"), (F.col("doc_id") % 100).cast("string").alias("n"))
    rows = rows.join(F.broadcast(forms), "k").select("doc_id", F.replace(F.replace("form", F.lit("{p}"), F.col("p")), F.lit("{n}"), F.col("n")).alias("text"))
    parts = tx.labelled_answer(F.col("text"))
    return rows.select("doc_id", tx.listed_subtask(F.col("text")).alias("listed"), tx.progress_percent(F.col("text")).alias("progress"), parts["subtask"].alias("labelled"), parts["answer"].alias("verdict"))


@query("""
SELECT r_regionkey, CAST(len(l) AS BIGINT) AS n, l[1] AS first, l[len(l)] AS last, '&lt;' || r_name || '&gt; &amp;amp; &quot;' AS escaped FROM (
  SELECT r_regionkey, r_name, list(n_name ORDER BY n_name) AS l FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)""", base=False)
def judge_prompts(spark, sf_dir):
    n, r = td.table(spark, sf_dir, "nation"), td.table(spark, sf_dir, "region")
    names = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.lower("n_name").alias("text")))).alias("c"))  # nations of a region
    rows = r.join(names, F.col("r_regionkey") == F.col("n_regionkey")).withColumn("labels", tx.candidate_labels(F.col("c")))
    prompt = tx.judge_prompt(F.lit("go"), F.col("c"), F.lit("there"))
    size = F.size("labels")
    # the prompt numbers the candidates as the labels do
    said = F.regexp_extract(prompt, r"- 1: ([^\n]*)", 1)
    return rows.select("r_regionkey", size.cast("long").alias("n"), F.upper(said).alias("first"), F.element_at("labels", size.cast("string")).alias("last"), tx.html_escape(F.concat(F.lit("<"), "r_name", F.lit('> &amp; "'))).alias("escaped"))


# --- kernels ------------------------------------------------------------------


@query("""
SELECT episode, num_frames // 2 AS anchor,
  (SELECT string_agg(f, ',' ORDER BY i) FROM (SELECT i, CASE WHEN num_frames // 2 < 8 THEN least(i, num_frames // 2) ELSE CAST(round_even(i * ((num_frames // 2) / 7.0::DOUBLE), 0) AS BIGINT) END AS f FROM (SELECT unnest(range(0, 8)) AS i))) AS spread,
  (SELECT string_agg(f, ',' ORDER BY i) FROM (SELECT i, (num_frames // 2) * i // 3 AS f FROM (SELECT unnest(range(0, 4)) AS i))) AS floored,
  array_to_string(list_sort(list_distinct(list_concat(list_filter(list_transform(range(0, 60), lambda i: (2 * i * 5 + 2) // 4), lambda f: f <= num_frames // 2), [num_frames // 2]))), ',') AS ratio,
  array_to_string(list_sort(list_distinct(list_concat(range(0, num_frames // 2 + 1, 3), [num_frames // 2]))), ',') AS hops,
  CAST(num_frames // 2 - (num_frames // 2) % 5 AS BIGINT) AS grid_end
FROM ep""")
def kernel_frames(spark, sf_dir):
    e = _episodes(spark, sf_dir).withColumn("anchor", F.floor(F.col("num_frames") / 2).cast("int"))
    a = F.col("anchor")
    return e.select(
        "episode", a.cast("long").alias("anchor"), _joined(fr.prefix_uniform(a, 8)).alias("spread"), _joined(fr.prefix_floor(a, 4)).alias("floored"), _joined(F.array_sort(kn.ratio_grid(a, F.lit(5), F.lit(2)))).alias("ratio"),
        _joined(kn.incremental_frames(a, F.lit(30.0), 10.0)).alias("hops"), kn.grid_end(a, kn.sample_step(F.lit(25.0))).cast("long").alias("grid_end"),
    )


@query("""
, a AS (SELECT episode, num_frames AS n, least(greatest(CAST(floor(num_frames / 10.0 * 4.0) AS INT), 2), 8, num_frames) AS c FROM ep)
SELECT episode, CAST(c AS BIGINT) AS n_sampled, array_to_string(list_transform(range(0, c), lambda i: CAST(round_even(i * (CAST(n - 1 AS DOUBLE) / (c - 1)), 0) AS BIGINT)), ',') AS frames,
  array_to_string(CASE WHEN n <= 9 THEN range(0, n) ELSE list_transform(range(0, 6), lambda k: (2 * k * (n - 1) + 5) // 10) END, ',') AS limited,
  array_to_string(CASE WHEN n % 3 = 0 THEN [0, 0] ELSE range(0, n % 3 + 1) END, ',') AS pair FROM a WHERE c > 1""")
def sampled_frames(spark, sf_dir):
    n = F.col("num_frames")
    c = kn.clamped_count(n, F.lit(10.0), 4.0, 2, 8)
    frames = F.sequence(F.lit(0), n - 1)
    limited = F.when(n <= 9, frames).otherwise(kn.uniform_limit(frames, 6))
    return _episodes(spark, sf_dir).where("num_frames > 1").select("episode", c.cast("long").alias("n_sampled"), _joined(kn.linspace_rint(n, c)).alias("frames"), _joined(limited).alias("limited"), _joined(kn.prefix_pair(n % 3)).alias("pair"))


@query("""
, a AS (SELECT episode, num_frames AS n, num_frames * 2 // 3 AS anchor, list_sort(list_distinct(CASE WHEN num_frames <= 12 THEN range(0, num_frames) ELSE list_transform(range(0, 12), lambda i: CAST(round_even(i * (num_frames - 1) / 11.0::DOUBLE, 0) AS BIGINT)) END)) AS u FROM ep),
h AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(u, lambda f: f <= anchor), [CAST(anchor AS BIGINT)]))) AS s FROM a)
SELECT episode, array_to_string(CASE WHEN len(s) >= 12 THEN s[len(s) - 11:] ELSE list_concat(list_transform(range(0, 12 - len(s)), lambda i: s[1]), s) END, ',') AS history,
  array_to_string(CASE WHEN anchor + 1 >= 10 THEN range(anchor - 9, anchor + 1) ELSE list_concat(list_transform(range(0, 9 - anchor), lambda i: CAST(0 AS BIGINT)), range(0, anchor + 1)) END, ',') AS last_ten FROM h""")
def history_windows(spark, sf_dir):
    n, a = F.col("num_frames"), F.floor(F.col("num_frames") * 2 / 3).cast("int")
    return _episodes(spark, sf_dir).select("episode", _joined(kn.history_window(n, a, 12, 12)).alias("history"), _joined(fr.last_frames(F.sequence(F.lit(0), a), 10)).alias("last_ten"))


_DELTAS = "(x % 1000 - 400) / 10000.0::DOUBLE"


@query(f"""WITH RECURSIVE {td.SQL},
z AS (SELECT episode, frame, num_frames, {_DELTAS} AS y FROM fr),
f AS (SELECT episode, frame, num_frames, y, CASE WHEN y >= 0 THEN y ELSE 0.0 END AS p, y AS hop FROM z WHERE frame = 0
UNION ALL SELECT z.episode, z.frame, z.num_frames, z.y, CASE WHEN z.y >= 0 THEN f.p + (1 - f.p) * z.y ELSE f.p + f.p * z.y END, CASE WHEN z.y >= 0 THEN f.hop + (1 - f.hop) * z.y ELSE f.hop + f.hop * z.y END FROM f JOIN z ON z.episode = f.episode AND z.frame = f.frame + 1)
SELECT episode, round(p, 6) + 0.0 AS signed, round(hop, 6) + 0.0 AS hops, round((0.5::DOUBLE + (1 - 0.25::DOUBLE) + hop) / 3, 6) + 0.0 AS three_way FROM f WHERE frame = num_frames - 1""", base=False)
def delta_folds(spark, sf_dir):
    rows = td.frames(spark, sf_dir).groupBy("user_id", "d", "episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda p: (p["x"] % 1000 - 400) / F.lit(10000.0)).alias("y"))
    r = lambda c, name: (F.round(c, 6) + 0.0).alias(name)
    return rows.select("episode", r(sq.signed_fold(F.col("y")), "signed"), r(kn.hop_progress(F.col("y")), "hops"), r(kn.three_way_value(F.lit(0.5), F.lit(-0.25), F.col("y")), "three_way"))


@query("""
SELECT event_id, round(b - ln(exp(a) + exp(b) + exp(c)), 9) + 0.0 AS logprob, round((a + b + c) / 3, 9) + 0.0 AS ensemble, CAST((2 * event_id + 3) // 6 AS BIGINT) AS third, event_id % 2 = 0 AS near, -a AS remaining
FROM (SELECT event_id, (event_id % 7) / 3.0::DOUBLE AS a, (event_id % 5) / 2.0::DOUBLE AS b, (event_id % 3)::DOUBLE AS c FROM events)""", base=False)
def score_kernels(spark, sf_dir):
    k = F.col("event_id")
    logits = F.array((k % 7) / F.lit(3.0), (k % 5) / F.lit(2.0), (k % 3).cast("double"))
    near = kn.is_close(k.cast("double"), k + F.when(k % 2 == 0, 0.0).otherwise(1e-3))
    return td.table(spark, sf_dir, "events").select("event_id", rounded(kn.log_softmax_at(logits, F.lit(1)), "logprob"), rounded(kn.ensemble_mean(logits), "ensemble"), kn.round_half_up(k, F.lit(3)).alias("third"), near.alias("near"), kn.remaining_value(logits[0]).alias("remaining"))


# --- reports ------------------------------------------------------------------


@query("""
, r AS (SELECT n_name AS baseline, world, metric, domain, task, CASE WHEN n_nationkey = 3 AND task = 't1' THEN 1.5 ELSE (n_nationkey + t) / 50.0::DOUBLE END AS score, n_nationkey, t
  FROM nation, (SELECT unnest(['sim', 'real']) AS world), (SELECT unnest(['sa', 'trr']) AS metric), (SELECT unnest(['id', 'env', 'emb']) AS domain), (SELECT unnest(['t0', 't1']) AS task, unnest([0, 1]) AS t) WHERE (metric = 'sa' OR domain = 'id' OR n_nationkey = 5) AND NOT (n_nationkey = 7 AND domain = 'emb'))
SELECT DISTINCT baseline, world, metric, domain, 'range' AS rule FROM r WHERE score > 1
UNION ALL SELECT DISTINCT baseline, world, metric, '*', 'coverage' FROM r WHERE (metric = 'sa' AND n_nationkey = 7) OR (metric = 'trr' AND n_nationkey = 5)
UNION ALL SELECT DISTINCT baseline, world, metric, domain, 'mean' FROM r WHERE n_nationkey = 11
UNION ALL SELECT DISTINCT baseline, world, metric, domain, 'protocol' FROM r WHERE metric = 'trr' AND n_nationkey = 13""")
def leaderboard_checks(spark, sf_dir):
    n = td.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("baseline"))
    each = lambda rows, name, values: rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    rows = each(each(each(each(n, "world", ("sim", "real")), "metric", ("sa", "trr")), "domain", ("id", "env", "emb")), "task", ("t0", "t1"))
    rows = rows.where("(metric = 'sa' OR domain = 'id' OR k = 5) AND NOT (k = 7 AND domain = 'emb')").withColumn("protocol", F.when(F.col("k") == 13, "old").otherwise("new"))
    rows = rows.withColumn("score", F.when((F.col("k") == 3) & (F.col("task") == "t1"), 1.5).otherwise((F.col("k") + F.substring("task", 2, 1).cast("int")) / F.lit(50.0)))
    means = rows.groupBy("baseline", "world", "metric", "domain").agg((F.avg("score") + F.max(F.when(F.col("k") == 11, 0.01).otherwise(0.0))).alias("mean"))
    return board.input_problems(rows.join(means, ["baseline", "world", "metric", "domain"]), {"trr": "new"})


@query(" SELECT domain, task, episode FROM ep WHERE user_id % 13 = 0 OR user_id % 17 = 0")
def score_differences(spark, sf_dir):
    e = _episodes(spark, sf_dir).withColumn("score", F.col("num_frames").cast("double"))
    saved = e.where("user_id % 17 <> 0").withColumn("score", F.when(F.col("user_id") % 13 == 0, F.col("score") + 1e-3).otherwise(F.col("score") + 1e-12))
    return checked.differences(saved, e, ["domain", "task", "episode"]).select("domain", "task", "episode")


@query("""
SELECT candidate, round(avg(m), 9) + 0.0 AS margin FROM (SELECT candidate, domain, avg(m) AS m FROM (SELECT 'c' || (user_id % 4) AS candidate, domain, task, avg(v) AS m FROM fr GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""".join([" ", ""]))
def candidate_margins(spark, sf_dir):
    rows = td.frames(spark, sf_dir).withColumn("candidate", F.concat(F.lit("c"), F.col("user_id") % 4))
    return statistics.macro_mean(rows, value="v", extra=("candidate",)).where("level = 'overall'").select("candidate", rounded("score", "margin"))


@query("""
, c AS (SELECT episode, num_frames AS n, list(v ORDER BY frame) AS vs, min(v) AS lo, max(v) AS hi FROM fr GROUP BY ALL),
p AS (SELECT episode, n, list_transform(range(0, n), lambda i: 12 + i * (456.0::DOUBLE / greatest(n - 1, 1))) AS xs, list_transform(vs, lambda v: 148 - coalesce((v - lo) / nullif(hi - lo, 0), 0.5) * 136.0::DOUBLE) AS ys,
  list_transform(range(0, n), lambda i: 148 - least(i, n - 1 - i) / greatest((n - 1) / 2.0::DOUBLE, 0.5) * 136) AS ts FROM c)
SELECT episode, n AS n_points, array_to_string(list_transform(range(1, n + 1), lambda i: printf('%.1f,%.1f', floor(xs[i] * 10 + 0.5) / 10, floor(ys[i] * 10 + 0.5) / 10)), ' ') AS points,
  array_to_string(list_transform(range(1, n + 1), lambda i: printf('%.1f,%.1f', floor(xs[i] * 10 + 0.5) / 10, floor(ts[i] * 10 + 0.5) / 10)), ' ') AS ideal FROM p""")
def value_curves(spark, sf_dir):
    c = td.curves(td.frames(spark, sf_dir))
    return c.select("episode", F.size("values").cast("long").alias("n_points"), charts.polyline(F.col("values")).alias("points"), charts.triangle(F.size("values")).alias("ideal"))


# --- episode tables -----------------------------------------------------------


@query("""
SELECT 'do ' || task AS instruction, printf('chunk-%03d/file-%03d.mp4', arg_min(d, (d, user_id)), arg_min(user_id % 1000, (d, user_id))) AS path, CAST(round_even(arg_min(num_frames, (d, user_id)) / 4.0::DOUBLE * 10.0, 0) AS BIGINT) AS start FROM ep WHERE task <> 'task_2' GROUP BY task""")
def reference_clips(spark, sf_dir):
    e = _episodes(spark, sf_dir).select(F.array(F.concat(F.lit("do "), "task"), F.lit("other")).alias("tasks"), F.col("d").alias("chunk_index"), (F.col("user_id") % 1000).cast("int").alias("file_index"), (F.col("num_frames") / F.lit(4.0)).alias("from_timestamp"), (F.col("d").cast("long") * 1_000_000_000 + F.col("user_id")).alias("episode_index"))
    named = spark.createDataFrame([("do task_0",), ("do task_1",)], "instruction string")
    return lerobot.reference_clips(e, named, 10.0).select("instruction", "path", F.col("start").cast("long").alias("start"))


@query(" SELECT episode, CASE task WHEN 'task_0' THEN 'pick it up' ELSE task END || ',same' AS tasks FROM ep")
def replaced_labels(spark, sf_dir):
    e = _episodes(spark, sf_dir).select("episode", F.array("task", F.lit("same")).alias("tasks"))
    labels = spark.createDataFrame([("task_0", "pick it up")], "old string, new string")
    return dataset.remap_labels(e, "tasks", labels).select("episode", F.array_join("tasks", ",").alias("tasks"))


@query("""
SELECT p_partkey, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ',') AS items, CAST(len(list_distinct(u)) AS BIGINT) AS n
FROM (SELECT p_partkey, list_filter(list_transform(string_split(' ' || p_brand || ', ' || p_type || ' ,, ' || p_name || ',' || p_type || ' ', ','), lambda x: trim(x)), lambda x: x <> '') AS u FROM part)""", base=False)
def comma_lists(spark, sf_dir):
    text = F.concat(F.lit(" "), "p_brand", F.lit(", "), "p_type", F.lit(" ,, "), "p_name", F.lit(","), "p_type", F.lit(" "))
    own = tx.comma_list(text)
    return td.table(spark, sf_dir, "part").select("p_partkey", F.array_join(own, ",").alias("items"), F.size(own).cast("long").alias("n"))


@query("""
SELECT 'vs' AS metric, domain, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks, CAST(sum(len(range(0, num_frames, 2))) AS BIGINT) AS n_queries FROM ep GROUP BY ALL""".join([" ", ""]))
def grid_coverage(spark, sf_dir):
    plan = plans.grid_plan(_episodes(spark, sf_dir), td.FPS, with_end=False).withColumn("metric", F.lit("vs"))
    return checked.expected_coverage(plan)
