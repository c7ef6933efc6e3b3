"""Queries over the driver's tables and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import frames as fr
from .functions import sequences as sq
from .functions import text as tx
from .operators import checked, metrics, selection, statistics
from .plans import cohorts
from .plans import queries as plans
from .register import MACRO as _MACRO
from .register import QUERIES, SQL  # noqa: F401
from .register import macro as _macro
from .register import query as _query
from .register import rounded as _r
from .sources import testdata as td

# --- episodes and plans -------------------------------------------------------


@_query(" SELECT CAST(d AS BIGINT) AS d, domain, task, episode, success, role, solution, CAST(user_id AS BIGINT) AS user_id, CAST(num_frames AS BIGINT) AS num_frames, trr_group, CAST(onset AS BIGINT) AS onset FROM ep")
def scan_trajectories(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir))
    return e.select(F.col("d").cast("long").alias("d"), "domain", "task", "episode", "success", "role", "solution", F.col("user_id").cast("long").alias("user_id"), F.col("num_frames").cast("long").alias("num_frames"), "trr_group", F.col("onset").cast("long").alias("onset"))


@_query("""
SELECT domain, task, coalesce(CASE WHEN NOT success THEN 'unsuccessful' WHEN user_id % 7 = 0 THEN 'trr_branch' WHEN user_id % 5 = 0 THEN 'diverse_solution' WHEN num_frames < 16 THEN 'no_cycle_voc_annotations' END, 'kept') AS reason, count(*) AS n FROM ep GROUP BY ALL""")
def exclusion_reasons(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir))
    reason = cohorts.exclusion_reason(F.col("success"), F.col("user_id") % 7 == 0, F.when(F.col("user_id") % 5 == 0, "diverse"), F.col("num_frames") >= 16)
    return e.groupBy("domain", "task", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT episode, 'head' AS side, CAST(unnest(range(0, greatest(1, CAST(ceil(num_frames * 0.02) AS INT)))) AS BIGINT) AS frame FROM ep
UNION ALL SELECT episode, 'tail', CAST(unnest(range(num_frames - greatest(1, CAST(ceil(num_frames * 0.02) AS INT)), num_frames)) AS BIGINT) FROM ep""")
def edge_frames(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir)).select("episode", "num_frames")
    side = lambda name, f: e.select("episode", F.lit(name).alias("side"), F.explode(f(F.col("num_frames"))).alias("frame"))
    out = side("head", fr.head_frames).unionByName(side("tail", fr.tail_frames))
    return out.withColumn("frame", F.col("frame").cast("long"))


_FPS = (10.0, 12.0, 25.0)


@_query("""
SELECT DISTINCT episode, fps, CAST(frame AS BIGINT) AS frame FROM (
  SELECT episode, num_frames, fps, round_even(i * (fps / 5.0), 0) AS frame FROM (SELECT episode, num_frames, unnest([10.0, 12.0, 25.0])::DOUBLE AS fps FROM ep), (SELECT unnest(range(0, 400)) AS i)
) WHERE frame < num_frames UNION SELECT episode, fps, num_frames - 1 FROM (SELECT episode, num_frames, unnest([10.0, 12.0, 25.0])::DOUBLE AS fps FROM ep)""")
def grid_5hz(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir)).select("episode", "num_frames", F.explode(F.array(*map(F.lit, _FPS))).alias("fps"))
    return e.select("episode", "fps", F.explode(fr.grid_with_end(F.col("num_frames"), F.col("fps"))).alias("frame")).withColumn("frame", F.col("frame").cast("long"))


@_query("""
SELECT DISTINCT episode, fps, stage, CAST(frame AS BIGINT) AS frame FROM (
  SELECT episode, fps, k AS stage, (num_frames * k) // 3 AS a, (num_frames * (k + 1)) // 3 AS b, round_even(i * fps / 10.0, 0) AS frame
  FROM (SELECT episode, num_frames, unnest([10.0, 12.0, 25.0])::DOUBLE AS fps FROM ep), (SELECT unnest(range(0, 3)) AS k), (SELECT unnest(range(0, 800)) AS i)) WHERE frame >= a AND frame < b""")
def grid_10hz(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir)).select("episode", "num_frames", F.explode(F.array(*map(F.lit, _FPS))).alias("fps"))
    e = e.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("stage"))
    start, end = (F.floor(F.col("num_frames") * (F.col("stage") + k) / 3).cast("int") for k in (0, 1))
    return e.select("episode", "fps", "stage", F.explode(fr.stage_grid(start, end, F.col("fps"))).alias("frame")).withColumn("frame", F.col("frame").cast("long"))


_PATH = """,
up AS (SELECT *, list_sort(list_distinct(list_concat(range(0, num_frames, 2), [CAST(num_frames - 1 AS BIGINT)]))) AS u FROM ep),
pa AS (SELECT *, list_concat(u, list_reverse(u[1:len(u) - 1])) AS path FROM up WHERE len(u) >= 3),
cy AS (SELECT *, unnest(range(0, len(path))) AS position, len(path) AS n_path, CASE WHEN position <= (len(path) - 1) / 2 THEN 'forward' ELSE 'cycle' END AS playback, path[position + 1] AS anchor FROM pa)
"""


@_query(_PATH + "SELECT episode, CAST(position AS BIGINT) AS position, CAST(anchor AS BIGINT) AS anchor, playback FROM cy")
def cycle_plan(spark, sf_dir):
    p = plans.cycle_plan(td.episodes(td.frames(spark, sf_dir)).where(F.size(td.annotated()) >= 3), td.annotated())
    return p.select("episode", F.col("position").cast("long").alias("position"), F.col("anchor").cast("long").alias("anchor"), "playback")


@_query("""
SELECT episode, playback, CAST(frame AS BIGINT) AS frame, CAST(CASE playback WHEN 'forward' THEN frame WHEN 'reverse' THEN num_frames - 1 - frame ELSE 2 * (num_frames - 1) - frame END AS BIGINT) AS position,
CAST(frame AS BIGINT) AS source, CAST(CASE WHEN playback = 'cycle' THEN 2 * num_frames - 1 ELSE num_frames END AS BIGINT) AS n_timeline
FROM (SELECT *, unnest(['forward', 'reverse', 'cycle']) AS playback FROM fr)""")
def playback_map(spark, sf_dir):
    rows = td.frames(spark, sf_dir).select("episode", "frame", "num_frames", F.explode(F.array(*map(F.lit, ("forward", "reverse", "cycle")))).alias("playback"))
    n, p = F.col("num_frames"), F.col("playback")
    rows = rows.withColumn("position", fr.timeline_anchor(n, F.col("frame"), p))
    out = {"frame": F.col("frame"), "position": F.col("position"), "source": fr.source_frame(n, F.col("position"), p), "n_timeline": fr.timeline_size(n, p)}
    return rows.select("episode", "playback", *(c.cast("long").alias(k) for k, c in out.items()))


# --- checked joins ------------------------------------------------------------


@_query("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN p.event_id IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN lo <> p.event_type OR hi <> p.event_type THEN 'wrong_op' ELSE 'ok' END AS status
FROM (SELECT * FROM events WHERE event_id % 19 <> 0) p FULL JOIN (SELECT event_id, count(*) AS n, min(op) AS lo, max(op) AS hi FROM (
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'other' ELSE event_type END AS op FROM events WHERE event_id % 17 <> 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 13 = 0 AND event_id % 17 <> 0) GROUP BY 1) q ON p.event_id = q.event_id) GROUP BY 1""", base=False)
def join_checked_report(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("op"))
    made = e.where("query_id % 17 <> 0")
    predicted = made.withColumn("op", F.when(F.col("query_id") % 23 == 0, "other").otherwise(F.col("op"))).unionByName(made.where("query_id % 13 = 0"))
    return checked.join_report(e.where("query_id % 19 <> 0"), predicted).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT domain, task, round(avg(v), 9) + 0.0 AS score, 'new' AS origin FROM fr WHERE domain = 'env' AND task <> 'task_2' GROUP BY ALL
UNION ALL SELECT domain, task, round(avg(x), 9) + 0.0, 'old' FROM fr WHERE NOT (domain = 'env' AND task <> 'task_2') GROUP BY ALL""")
def merge_cells(spark, sf_dir):
    rows = td.frames(spark, sf_dir)
    old = rows.groupBy("domain", "task").agg(F.avg("x").alias("score")).withColumn("origin", F.lit("old"))
    new = rows.where("domain = 'env' AND task <> 'task_2'").groupBy("domain", "task").agg(F.avg("v").alias("score")).withColumn("origin", F.lit("new"))
    return checked.merge_cells(old, new).select("domain", "task", _r("score"), "origin")


@_query(" SELECT DISTINCT domain, task FROM ep WHERE NOT EXISTS (SELECT 1 FROM ep e WHERE e.domain = ep.domain AND e.task = ep.task AND e.d = CAST(right(e.task, 1) AS INT))")
def missing_cells(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir))
    requested = e.select("domain", "task").distinct().withColumn("fingerprint", F.lit("a"))
    published = e.where("d = cast(right(task, 1) as int)").select("domain", "task").distinct().withColumn("fingerprint", F.lit("a"))
    return checked.missing_cells(requested, published).select("domain", "task")


@_query("""
SELECT 'sa' AS metric, domain, CAST(sum(greatest(1, CAST(ceil(num_frames * 0.02) AS INT))) AS BIGINT) AS n_queries, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM ep GROUP BY ALL""")
def coverage_expected(spark, sf_dir):
    return checked.expected_coverage(plans.edge_plan(td.episodes(td.frames(spark, sf_dir))))


@_query("""
SELECT CASE WHEN n > video THEN 'metadata_exceeds_video' WHEN last >= video THEN 'annotation_exceeds_video' WHEN video > n THEN 'video_longer_than_metadata' ELSE 'ok' END AS status, count(*) AS n
FROM (SELECT num_frames AS n, num_frames + user_id % 4 - 1 AS video, CASE WHEN user_id % 11 = 0 THEN num_frames + 5 ELSE num_frames - 1 END AS last FROM ep) GROUP BY 1""")
def frame_audit(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir)).withColumn("video_frames", F.col("num_frames") + F.col("user_id") % 4 - 1)
    e = e.withColumn("last_annotated", F.when(F.col("user_id") % 11 == 0, F.col("num_frames") + 5).otherwise(F.col("num_frames") - 1))
    return cohorts.frame_audit(e).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_query("""
, h AS (SELECT domain, task, sha256('{"domain":"' || domain || '","episode":"' || episode || '","num_frames":' || num_frames || ',"task":"' || task || '"}') AS h FROM ep),
b AS (SELECT domain, task, left(h, 3) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY ALL)
SELECT domain, task, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM b GROUP BY ALL""")
def fingerprints(spark, sf_dir):
    return checked.fingerprint(td.episodes(td.frames(spark, sf_dir)).select("domain", "task", "episode", "num_frames"), ["domain", "task"])


@_query(" SELECT DISTINCT task, domain, arg_max(episode, (num_frames, user_id)) AS episode FROM ep GROUP BY ALL")
def latest_per_key(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir))
    return e.groupBy("task", "domain").agg(F.max_by("episode", F.struct("num_frames", "user_id")).alias("episode"))


@_query(" SELECT task, domain, min(episode) AS episode FROM ep WHERE success GROUP BY ALL")
def first_success(spark, sf_dir):
    return td.episodes(td.frames(spark, sf_dir)).where("success").groupBy("task", "domain").agg(F.min("episode").alias("episode"))


# --- success accuracy and grounding -------------------------------------------


def _tails(spark, sf_dir):
    return td.frames(spark, sf_dir).where(F.col("frame") >= F.col("num_frames") - fr.edge_size(F.col("num_frames")))


_TAILS = """,
tl AS (SELECT domain, task, episode, success, avg(v) AS t FROM fr WHERE frame >= num_frames - greatest(1, CAST(ceil(num_frames * 0.02) AS INT)) GROUP BY ALL)"""


@_query(_TAILS + """,
s AS (SELECT a.domain, a.task, avg(CASE WHEN a.t > b.t THEN 1.0 ELSE 0.0 END) AS score FROM tl a JOIN tl b USING (domain, task) WHERE a.success AND NOT b.success GROUP BY ALL)""" + _MACRO)
def sa(spark, sf_dir):
    return _macro(metrics.success_accuracy(_tails(spark, sf_dir)))


@_query(_TAILS + """,
m AS (SELECT success, avg(s) AS s FROM (SELECT success, domain, avg(s) AS s FROM (SELECT success, domain, task, avg(t) AS s FROM tl GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
p AS (SELECT max(s) FILTER (success) AS a, max(s) FILTER (NOT success) AS b FROM m)
SELECT round(a, 9) + 0.0 AS success_mean, round(b, 9) + 0.0 AS failure_mean, round(a - b, 9) + 0.0 AS gap, round(100 * (a - b) / nullif(a, 0), 9) + 0.0 AS gap_percent FROM p""")
def sa_diagnostics(spark, sf_dir):
    return metrics.success_diagnostics(_tails(spark, sf_dir)).select(*map(_r, ("success_mean", "failure_mean", "gap", "gap_percent")))


_CANDIDATES = ("correct", "counterfactual-001", "counterfactual-002", "counterfactual-003")
_TYPES = {"counterfactual-001": "objects", "counterfactual-002": "actions", "counterfactual-003": "constraints"}


def _grounded(spark, sf_dir, easy: bool = False):
    """Scored compare pairs: the change of value over the edge pairs, fainter for wrong candidates."""
    curves = td.curves(td.frames(spark, sf_dir).where("success"))
    n = F.col("num_frames")
    changes = F.zip_with(fr.head_frames(n), fr.tail_frames(n), lambda a, b: F.get("values", b) - F.get("values", a))
    pairs = curves.select("domain", "task", "episode", "user_id", F.explode(changes).alias("dv"))
    if easy:
        tasks = td.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("t")).distinct().select(F.concat(F.lit("task_"), "t").alias("task"), F.concat(F.lit("task "), F.col("t") % 3).alias("instruction"), F.col("t").alias("ord"))
        named = plans.other_task_candidates(tasks).withColumn("c", F.when(F.col("candidate") == "correct", 0).otherwise(1 + F.right("candidate", F.lit(1)).cast("int")))
        pairs = pairs.join(F.broadcast(named.select("task", "candidate", "c")), "task")
    else:
        pairs = pairs.select("*", F.posexplode(F.array(*map(F.lit, _CANDIDATES))).alias("c", "candidate"))
    score = F.col("dv") * (1 - 0.25 * F.col("c")) + ((F.col("user_id") * 7 + F.col("c") * 3) % 5 - 2) * 0.01
    return metrics.grounding_scores(pairs.withColumn("score", score))


def _grounded_sql(candidates: str) -> str:
    return f""",
ed AS (SELECT *, greatest(1, CAST(ceil(num_frames * 0.02) AS INT)) AS k FROM fr WHERE success),
pr AS (SELECT t.*, t.v - h.v AS dv FROM (SELECT *, frame - (num_frames - k) AS i FROM ed WHERE frame >= num_frames - k) t JOIN (SELECT * FROM ed WHERE frame < k) h ON t.episode = h.episode AND h.frame = t.i),
ca AS ({candidates}),
sc AS (SELECT domain, pr.task, episode, candidate, avg(dv * (1 - 0.25::DOUBLE * c) + ((user_id * 7 + c * 3) % 5 - 2) * 0.01::DOUBLE) AS mean FROM pr JOIN ca ON ca.task = pr.task OR ca.task = '*' GROUP BY ALL),
co AS (SELECT a.*, b.mean AS correct FROM sc a JOIN sc b ON a.episode = b.episode AND b.candidate = 'correct')"""


_HARD = "SELECT '*' AS task, unnest(['correct', 'counterfactual-001', 'counterfactual-002', 'counterfactual-003']) AS candidate, unnest(range(0, 4)) AS c"
_EASY = "SELECT a.task, CASE WHEN a.task = b.task THEN 'correct' ELSE 'task-' || b.task END AS candidate, CASE WHEN a.task = b.task THEN 0 ELSE 1 + CAST(right(b.task, 1) AS INT) END AS c FROM (SELECT DISTINCT task FROM ep) a, (SELECT DISTINCT task FROM ep) b"
_TOP1 = """,
s AS (SELECT domain, task, episode, min(CASE WHEN correct > mean THEN 1.0 ELSE 0.0 END) AS score FROM co WHERE candidate <> 'correct' GROUP BY ALL)""" + _MACRO


@_query(_grounded_sql(_EASY) + _TOP1)
def tga_easy(spark, sf_dir):
    return _macro(metrics.grounding(_grounded(spark, sf_dir, easy=True)).withColumnRenamed("top1", "score"))


@_query(_grounded_sql(_HARD) + _TOP1)
def tga_hard(spark, sf_dir):
    return _macro(metrics.grounding(_grounded(spark, sf_dir)).withColumnRenamed("top1", "score"))


@_query(_grounded_sql(_HARD) + """,
s AS (SELECT domain, task, episode, avg(CASE WHEN correct > mean THEN 1.0 WHEN correct = mean THEN 0.5 ELSE 0.0 END) AS score FROM co WHERE candidate <> 'correct' GROUP BY ALL)""" + _MACRO)
def tga_pairwise(spark, sf_dir):
    return _macro(metrics.grounding(_grounded(spark, sf_dir)).withColumnRenamed("pairwise", "score"))


@_query(_grounded_sql(_HARD) + """,
ty AS (SELECT CASE right(candidate, 1) WHEN '1' THEN 'objects' WHEN '2' THEN 'actions' ELSE 'constraints' END AS type, domain, task, avg(correct - mean) AS m, avg(CASE WHEN correct > mean THEN 1.0 WHEN correct = mean THEN 0.5 ELSE 0.0 END) AS p FROM co WHERE candidate <> 'correct' GROUP BY ALL),
td AS (SELECT type, domain, avg(m) AS m, avg(p) AS p FROM ty GROUP BY ALL)
SELECT type, round(avg(m), 9) + 0.0 AS margin, round(avg(p), 9) + 0.0 AS pairwise FROM td GROUP BY ALL""")
def tga_by_type(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    wrong = _grounded(spark, sf_dir).where("candidate <> 'correct'").withColumn("type", kind[F.col("candidate")])
    of = lambda c: statistics.macro_mean(wrong, value=c, extra=("type",)).where("level = 'overall'")
    return of("margin").select("type", _r("score", "margin")).join(of("credit").select("type", _r("score", "pairwise")), "type")


@_query(_grounded_sql(_HARD) + " SELECT domain, task, candidate, round(avg(mean), 9) + 0.0 AS mean_score FROM co GROUP BY ALL")
def tga_confusion(spark, sf_dir):
    return _grounded(spark, sf_dir).groupBy("domain", "task", "candidate").agg(_r(F.avg("mean"), "mean_score"))


# --- correlations -------------------------------------------------------------


def _rho_sql(points: str) -> str:
    """Rank correlation of v and tg of the view pt by episode, 0 where constant, as view s."""
    return f""",
pt AS ({points}),
rk AS (SELECT *, rank() OVER (PARTITION BY episode ORDER BY v) + (count(*) OVER (PARTITION BY episode, v) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY episode ORDER BY tg) + (count(*) OVER (PARTITION BY episode, tg) - 1) / 2.0::DOUBLE AS b FROM pt),
s AS (SELECT domain, task, episode, coalesce((count(*) * sum(a * b) - sum(a) * sum(b)) / nullif(sqrt((count(*) * sum(a * a) - sum(a) * sum(a)) * (count(*) * sum(b * b) - sum(b) * sum(b))), 0), 0) AS score FROM rk GROUP BY ALL)"""


def _normal(rows: DataFrame) -> DataFrame:
    """The normal successful trajectories of the binding: all that no reason of `exclusion_reasons` but annotation could exclude."""
    return rows.where(cohorts.exclusion_reason(F.col("success"), F.lit(False), F.col("solution"), F.lit(True)).isNull())


def _on_grid(rows: DataFrame, with_end: bool) -> DataFrame:
    """Frames on the 5 Hz grid."""
    return rows.where(fr.on_grid(F.col("frame"), F.col("num_frames"), F.lit(td.FPS), with_end=with_end))


_NORMAL = "success AND solution = 'normal'"


@_query(_rho_sql(f"SELECT domain, task, episode, v, frame AS tg FROM fr WHERE {_NORMAL} AND (frame % 2 = 0 OR frame = num_frames - 1)") + _MACRO)
def voc(spark, sf_dir):
    curves = td.curves(_normal(td.frames(spark, sf_dir)))
    return _macro(metrics.curve_correlations(curves, score=F.transform(td.annotated(), lambda f: F.get("values", f))))


@_query(_rho_sql("SELECT domain, task, episode, v, frame / num_frames AS tg FROM fr WHERE success AND frame % 4 = 0 AND num_frames > 4") + _MACRO)
def mem_voc(spark, sf_dir):
    curves = td.curves(td.frames(spark, sf_dir).where("success AND num_frames > 4"))
    return _macro(metrics.curve_correlations(curves, score=F.filter("values", lambda v, i: i % 4 == 0)))


def _cycle(spark, sf_dir):
    """Both halves of each cycle over the annotated frames, from one array a half; the value should fall on the way back."""
    return metrics.curve_correlations(td.cycle_curves(_normal(td.frames(spark, sf_dir))), up=F.col("up"), down=F.reverse("down"))


_CYCLE = _PATH + f""",
va AS (SELECT *, max(total) OVER (PARTITION BY user_id, d) AS w, max(CASE WHEN frame = num_frames - 1 THEN x END) OVER (PARTITION BY user_id, d) AS xl FROM fr WHERE {_NORMAL}),
cv AS (SELECT va.domain, va.task, va.episode, position, n_path, CASE WHEN playback = 'forward' THEN v ELSE CAST(w + w - xl - (total - x) AS DOUBLE) / (2 * (va.num_frames - 1) - frame + 1) / 50000.0 END AS v FROM cy JOIN va ON cy.episode = va.episode AND cy.anchor = va.frame)"""


def _half_sql(sign: str, name: str) -> str:
    target = "position" if name == "up" else "-position"
    return _rho_sql(f"SELECT domain, task, episode, v, {target} AS tg FROM cv WHERE position {sign} (n_path - 1) / 2").replace("pt AS", f"pt_{name} AS").replace("FROM pt)", f"FROM pt_{name})").replace("rk AS", f"rk_{name} AS").replace("FROM rk GROUP", f"FROM rk_{name} GROUP").replace("\ns AS", f"\ns_{name} AS")


@_query(_CYCLE + _half_sql("<=", "up") + _half_sql(">=", "down") + ",\ns AS (SELECT domain, task, episode, (u.score + w.score) / 2 AS score FROM s_up u JOIN s_down w USING (domain, task, episode))" + _MACRO)
def cycle_voc(spark, sf_dir):
    return _macro(_cycle(spark, sf_dir).withColumn("score", (F.col("up") + F.col("down")) / 2))


@_query(_CYCLE + _half_sql(">=", "down") + ",\ns AS (SELECT * FROM s_down)" + _MACRO)
def vroc(spark, sf_dir):
    return _macro(_cycle(spark, sf_dir).withColumnRenamed("down", "score"))


@_query("""
SELECT conv_id, count(*) AS n, round((count(*) * sum(a * b) - sum(a) * sum(b)) / nullif(sqrt((count(*) * sum(a * a) - sum(a) * sum(a)) * (count(*) * sum(b * b) - sum(b) * sum(b))), 0), 9) + 0.0 AS rho
FROM (SELECT *, rank() OVER (PARTITION BY conv_id ORDER BY length(text) // 100) + (count(*) OVER (PARTITION BY conv_id, length(text) // 100) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY conv_id ORDER BY turn) + (count(*) OVER (PARTITION BY conv_id, turn) - 1) / 2.0::DOUBLE AS b FROM conversations) GROUP BY ALL""", base=False)
def spearman_ties(spark, sf_dir):
    c = td.table(spark, sf_dir, "conversations").withColumn("size", F.floor(F.length("text") / 100))
    return statistics.spearman(c, ["conv_id"], "size", "turn").select("conv_id", "n", _r("rho"))


@_query(""" SELECT domain, task, round(median(v), 9) + 0.0 AS median, round(quantile_cont(v, 0.025), 9) + 0.0 AS p025, round(quantile_cont(v, 0.975), 9) + 0.0 AS p975, round(quantile_disc(v, 0.9), 9) + 0.0 AS rank90, round(sqrt(avg(v * v)), 9) + 0.0 AS rms FROM fr GROUP BY ALL""")
def percentile_median(spark, sf_dir):
    rows = td.frames(spark, sf_dir).select("domain", "task", "v")
    found = selection.quantiles(rows, ["domain", "task"], "v", {"median": ("linear", 0.5), "p025": ("linear", 0.025), "p975": ("linear", 0.975), "rank90": ("nearest", 0.9)})
    rms = rows.groupBy("domain", "task").agg(_r(F.sqrt(F.avg(F.col("v") * F.col("v"))), "rms"))
    return found.select("domain", "task", *map(_r, ("median", "p025", "p975", "rank90"))).join(rms, ["domain", "task"])


@_query(""" SELECT episode, CAST(frame AS BIGINT) AS frame, round(coalesce(last_value(CASE WHEN x % 5 <> 0 AND frame % 3 <> 0 THEN v END IGNORE NULLS) OVER (PARTITION BY user_id, d ORDER BY frame ROWS UNBOUNDED PRECEDING), 0), 9) + 0.0 AS filled FROM fr""")
def asof_fill(spark, sf_dir):
    rows = td.frames(spark, sf_dir).withColumn("p", F.when((F.col("x") % 5 != 0) & (F.col("frame") % 3 != 0), F.col("v")))
    return rows.select("episode", F.col("frame").cast("long").alias("frame"), _r(metrics.forward_fill(rows, ["user_id", "d"], "frame", "p"), "filled"))


# --- smoothness, failure points, recovery -------------------------------------


def _smooth(spark, sf_dir):
    rows = _on_grid(_normal(td.frames(spark, sf_dir)), False).withColumn("time", F.col("frame") / F.lit(td.FPS))
    return metrics.smoothness(rows, keys=("user_id", "d", *metrics.EPISODE))


_SMOOTH = f""",
g0 AS (SELECT *, frame / 10.0::DOUBLE AS time, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, d) AS m FROM fr WHERE {_NORMAL} AND frame % 2 = 0 WINDOW w AS (PARTITION BY user_id, d ORDER BY frame)),
g1 AS (SELECT *, avg(CASE WHEN k <= 3 THEN v END) OVER (PARTITION BY user_id, d) AS f, avg(CASE WHEN k > m - 3 THEN v END) OVER (PARTITION BY user_id, d) AS l FROM g0 WHERE m >= 7),
g2 AS (SELECT *, CASE WHEN k <= 3 THEN f WHEN k > m - 3 THEN l ELSE v END AS z FROM g1),
g3 AS (SELECT *, abs(z - lag(z) OVER w) AS dz, time - lag(time) OVER w AS dt, CASE WHEN v <> lag(v) OVER w THEN time - lag(time) OVER w ELSE 0 END AS mv FROM g2 WINDOW w AS (PARTITION BY user_id, d ORDER BY frame)),
g4 AS (SELECT domain, task, episode, max(f) AS f, max(l) AS l, sum(dz) AS tv, sum(mv) AS mv, sum(dt) AS du, count(*) AS n_points FROM g3 GROUP BY ALL),
sm AS (SELECT *, CASE WHEN tv = 0 THEN 1.0 ELSE least(1.0, abs(l - f) / tv) END AS er, mv / du AS scale FROM g4)"""


@_query(_SMOOTH + ",\ns AS (SELECT domain, task, er * scale AS score FROM sm)" + _MACRO)
def vs(spark, sf_dir):
    return _macro(_smooth(spark, sf_dir).withColumnRenamed("vs", "score"))


@_query(_SMOOTH + " SELECT episode, n_points, round(tv, 9) + 0.0 AS tv, round(er, 9) + 0.0 AS er, round(scale, 9) + 0.0 AS scale, round(er * scale, 9) + 0.0 AS vs FROM sm")
def vs_components(spark, sf_dir):
    return _smooth(spark, sf_dir).select("episode", "n_points", *map(_r, ("tv", "er", "scale", "vs")))


def _failure_curves(spark, sf_dir):
    rows = _on_grid(cohorts.failure_point(td.frames(spark, sf_dir).where("NOT success")), True)
    curve = F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda x: F.struct(x["frame"].alias("f"), x["v"].alias("v")))
    return rows.groupBy("user_id", "d", "domain", "task", "episode", "num_frames", "onset").agg(curve.alias("curve"))


_CURVES = """,
fc0 AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY frame) AS k, max(v) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) - v AS dd FROM fr WHERE NOT success AND role <> 'r_zero' AND (frame % 2 = 0 OR frame = num_frames - 1)),
fc AS (SELECT *, max(dd) OVER (PARTITION BY episode) AS down, count(*) OVER (PARTITION BY episode) AS m FROM fc0)"""

_ZIGZAG = _CURVES + """,
zz AS (SELECT episode, k, m, down, true AS up, frame AS pf, v AS pv, CAST(NULL AS INTEGER) AS lf, CAST(NULL AS DOUBLE) AS lv, CAST(NULL AS INTEGER) AS es, CAST(NULL AS INTEGER) AS ee, CAST(NULL AS DOUBLE) AS ed FROM fc WHERE k = 1
UNION ALL SELECT z.episode, c.k, z.m, z.down,
  CASE WHEN z.up THEN c.v >= z.pv OR z.pv - c.v < 0.2::DOUBLE * z.down ELSE NOT c.v < z.lv AND c.v - z.lv >= 0.2::DOUBLE * z.down END,
  CASE WHEN z.up AND c.v >= z.pv OR NOT z.up AND NOT c.v < z.lv AND c.v - z.lv >= 0.2::DOUBLE * z.down THEN c.frame ELSE z.pf END,
  CASE WHEN z.up AND c.v >= z.pv OR NOT z.up AND NOT c.v < z.lv AND c.v - z.lv >= 0.2::DOUBLE * z.down THEN c.v ELSE z.pv END,
  CASE WHEN z.up AND c.v >= z.pv THEN NULL WHEN z.up AND (z.pv - c.v >= 0.2::DOUBLE * z.down OR z.lv IS NULL OR c.v < z.lv) THEN c.frame WHEN NOT z.up AND c.v < z.lv THEN c.frame WHEN NOT z.up AND c.v - z.lv >= 0.2::DOUBLE * z.down THEN NULL ELSE z.lf END,
  CASE WHEN z.up AND c.v >= z.pv THEN NULL WHEN z.up AND (z.pv - c.v >= 0.2::DOUBLE * z.down OR z.lv IS NULL OR c.v < z.lv) THEN c.v WHEN NOT z.up AND c.v < z.lv THEN c.v WHEN NOT z.up AND c.v - z.lv >= 0.2::DOUBLE * z.down THEN NULL ELSE z.lv END,
  CASE WHEN NOT z.up AND NOT c.v < z.lv AND c.v - z.lv >= 0.2::DOUBLE * z.down THEN z.pf END, CASE WHEN NOT z.up AND NOT c.v < z.lv AND c.v - z.lv >= 0.2::DOUBLE * z.down THEN z.lf END, CASE WHEN NOT z.up AND NOT c.v < z.lv AND c.v - z.lv >= 0.2::DOUBLE * z.down THEN z.pv - z.lv END
  FROM zz z JOIN fc c ON c.episode = z.episode AND c.k = z.k + 1),
de AS (SELECT episode, es, ee, ed FROM zz WHERE es IS NOT NULL UNION ALL SELECT episode, pf, lf, pv - lv FROM zz WHERE k = m AND lv < pv),
be AS (SELECT episode, es AS pred, ed AS depth FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ed DESC, ee - es, es) AS o FROM de) WHERE o = 1),
fp AS (SELECT domain, task, e.episode, pred, depth, (CASE WHEN pred IS NULL THEN greatest(onset, num_frames - 1 - onset) ELSE abs(pred - onset) END) / (num_frames - 1)::DOUBLE AS score, down AS drawdown
  FROM (SELECT DISTINCT domain, task, episode, onset, num_frames, down FROM fc) e LEFT JOIN be USING (episode))"""


def _recursive(sql: str) -> str:
    return f"WITH RECURSIVE {td.SQL}{sql}"


@_query(_recursive(_ZIGZAG + ",\ns AS (SELECT domain, task, score FROM fp)" + _MACRO), base=False)
def fpl(spark, sf_dir):
    return _macro(metrics.failure_points(_failure_curves(spark, sf_dir)))


@_query(_recursive(_ZIGZAG + " SELECT episode, CAST(pred AS BIGINT) AS pred, round(drawdown, 9) + 0.0 AS drawdown, round(depth, 9) + 0.0 AS depth, round(score, 9) + 0.0 AS score FROM fp"), base=False)
def fpl_curve(spark, sf_dir):
    out = metrics.failure_points(_failure_curves(spark, sf_dir))
    return out.select("episode", F.col("pred").cast("long").alias("pred"), *map(_r, ("drawdown", "depth", "score")))


@_query(" SELECT episode, round(max(m - v), 9) + 0.0 AS drawdown FROM (SELECT episode, v, max(v) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS m FROM fr) GROUP BY ALL")
def drawdown(spark, sf_dir):
    c = td.curves(td.frames(spark, sf_dir))
    return c.select("episode", _r(sq.drawdown(F.col("values")), "drawdown"))


def _stages(spark, sf_dir, fps: float = td.FPS):
    rows = td.frames(spark, sf_dir)
    whole = cohorts.complete_groups(td.curves(rows).withColumn("success", F.col("role") == "r_plus"), cohorts.complete_group_keys(td.episodes(rows)))
    p = plans.stage_plan(whole)
    start, end = F.col("start"), F.col("end")
    p = p.withColumn("frames", fr.top_up(fr.stage_grid(start, end, F.lit(fps)), start, end))
    own = F.col("values")
    return p.withColumn("weights", fr.time_weights(F.col("frames"), start, end)).withColumn("values", F.transform("frames", lambda f: F.get(own, f)))


_STAGES = """,
gr AS (SELECT domain, task, trr_group FROM ep GROUP BY ALL HAVING count(*) = 3 AND count(DISTINCT role) = 3),
st AS (SELECT ep.*, unnest(CASE WHEN role = 'r_minus' THEN [{'stage': 'failure', 'a': 0, 'b': num_frames // 3, 'sign': -1}, {'stage': 'continue', 'a': num_frames // 3, 'b': num_frames, 'sign': 0}]
  ELSE [{'stage': 'failure', 'a': 0, 'b': num_frames // 3, 'sign': -1}, {'stage': 'recovery', 'a': num_frames // 3, 'b': 2 * num_frames // 3, 'sign': 1}, {'stage': CASE WHEN role = 'r_plus' THEN 'recovery_success' ELSE 'recovery_failed' END, 'a': 2 * num_frames // 3, 'b': num_frames, 'sign': CASE WHEN role = 'r_plus' THEN 1 ELSE -1 END}] END) AS z FROM ep JOIN gr USING (domain, task, trr_group)),
sf AS (SELECT st.domain, st.task, st.trr_group, st.episode, z.stage AS stage, z.sign AS sign, frame, v, CASE WHEN frame = z.a THEN CAST(z.a AS DOUBLE) ELSE frame - 0.5 END AS lo, CASE WHEN frame = z.b - 1 THEN CAST(z.b AS DOUBLE) ELSE frame + 0.5 END AS hi FROM st JOIN fr ON fr.episode = st.episode AND frame >= z.a AND frame < z.b)"""


@_query(_STAGES + " SELECT episode, stage, count(*) AS n_frames, round(sum(CAST(hi - lo AS DOUBLE)), 9) + 0.0 AS total_weight, round(sum(CAST(hi - lo AS DOUBLE) * frame), 9) + 0.0 AS moment FROM sf GROUP BY ALL")
def trr_weights(spark, sf_dir):
    s = _stages(spark, sf_dir)
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    moment = F.aggregate(F.zip_with("weights", "frames", lambda w, f: w * f), F.lit(0.0), lambda a, x: a + x)
    return s.select("episode", "stage", F.size("frames").cast("long").alias("n_frames"), _r(total, "total_weight"), _r(moment, "moment"))


@_query(_STAGES + """,
di AS (SELECT a.domain, a.task, a.trr_group, a.episode, a.stage, a.sign, coalesce(sum(CASE WHEN a.frame < b.frame THEN (a.hi - a.lo) * (b.hi - b.lo) * (b.v - a.v) END) / nullif(sum(CASE WHEN a.frame < b.frame THEN (a.hi - a.lo) * (b.hi - b.lo) * abs(b.v - a.v) END), 0), 0) AS direction FROM sf a JOIN sf b ON a.episode = b.episode AND a.stage = b.stage GROUP BY ALL),
br AS (SELECT domain, task, trr_group, episode, min(CASE WHEN sign = 0 THEN CASE WHEN direction <= 0 THEN 1 ELSE 0 END WHEN sign * direction > 0 THEN 1 ELSE 0 END) AS ok FROM di GROUP BY ALL),
s AS (SELECT domain, task, trr_group, avg(ok) AS score FROM br GROUP BY ALL)""" + _MACRO)
def trr(spark, sf_dir):
    return _macro(metrics.recovery_groups(metrics.recovery_branches(_stages(spark, sf_dir))))


# --- consistency of solutions -------------------------------------------------


def _deltas(spark, sf_dir):
    """task, episode, solution, semantic, value: median change over the boundary pairs of each third."""
    c = td.curves(td.frames(spark, sf_dir)).where("d = 0")
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    start, end = (F.floor(F.col("num_frames") * (F.col("k") + i) / 3).cast("int") for i in (0, 1))
    shift = F.when(F.col("solution") == "diverse", F.col("user_id")).otherwise(F.lit(0))
    c = c.where(end - start >= 2)  # a plan refuses spans of one frame
    c = c.withColumn("semantic", ((F.col("k") + shift) % 3).cast("long")).withColumn("p", F.explode(fr.boundary_pairs(start, end, F.lit(td.FPS))))
    c = c.withColumn("delta", F.get("values", "p.after") - F.get("values", "p.before"))
    return c.groupBy("task", "episode", "solution", "semantic").agg(F.median("delta").alias("value"))


_DELTAS = """,
th AS (SELECT *, (num_frames * k) // 3 AS a, (num_frames * (k + 1)) // 3 AS b FROM (SELECT *, unnest(range(0, 3)) AS k FROM ep WHERE d = 0)),
bp AS (SELECT *, least(CAST(round_even(i * 10.0::DOUBLE * 0.15::DOUBLE, 0) AS BIGINT), (b - a - 2) // 2) AS o FROM (SELECT *, unnest(range(0, 4)) AS i FROM th WHERE b - a >= 2)),
dl AS (SELECT bp.task, bp.episode, bp.solution, CAST((k + CASE WHEN bp.solution = 'diverse' THEN bp.user_id ELSE 0 END) % 3 AS BIGINT) AS semantic, median(y.v - x.v) AS value FROM bp JOIN fr x ON x.episode = bp.episode AND x.frame = a + o JOIN fr y ON y.episode = bp.episode AND y.frame = b - 1 - o GROUP BY ALL),
so AS (SELECT task, semantic, 'normal' AS solution, median(value) AS value FROM dl WHERE solution = 'normal' GROUP BY ALL UNION ALL SELECT task, semantic, episode, value FROM dl WHERE solution = 'diverse')"""


@_query(_DELTAS + """,
sc AS (SELECT *, median(value) OVER (PARTITION BY task, semantic) AS c, count(*) OVER (PARTITION BY task, semantic) AS n FROM so),
se AS (SELECT task, semantic, max(c) AS c, avg((value - c) * (value - c)) AS e FROM sc WHERE n >= 2 GROUP BY ALL),
tk AS (SELECT task, count(*) AS n_semantics, sqrt(avg(c * c)) AS g, sqrt(avg(e)) AS r FROM se GROUP BY ALL)
SELECT task, n_semantics, round(g, 9) + 0.0 AS center, round(r, 9) + 0.0 AS rmse, round(coalesce((g - r) / nullif(g + r, 0), -1), 9) + 0.0 AS score, g + r > 0 AS identifiable FROM tk""")
def csvc(spark, sf_dir):
    out = metrics.solution_consistency(metrics.solution_profiles(_deltas(spark, sf_dir)))
    return out.select("task", "n_semantics", *map(_r, ("center", "rmse", "score")), "identifiable")


@_query(_DELTAS + """
SELECT task, semantic, count(*) AS n, round(min(value), 9) + 0.0 AS low, round(avg(value), 9) + 0.0 AS mean, round(max(value), 9) + 0.0 AS high FROM dl GROUP BY ALL""")
def semantic_values(spark, sf_dir):
    """Maps of an episode's semantics, turned into the values of each semantic."""
    maps = _deltas(spark, sf_dir).groupBy("task", "episode", "solution").agg(F.map_from_entries(F.collect_list(F.struct("semantic", "value"))).alias("deltas"))
    rows = metrics.of_semantics(maps).groupBy("task", "semantic").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return rows.select("task", "semantic", "n", *map(_r, ("low", "mean", "high")))


@_query(_DELTAS + """,
q1 AS (SELECT task, avg(q) AS q_repeat FROM (SELECT task, semantic, 2 * var_samp(value) AS q FROM dl WHERE solution = 'normal' GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
q2 AS (SELECT task, avg(q) AS q_cross FROM (SELECT task, semantic, 2 * var_samp(value) AS q FROM so GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
q3 AS (SELECT l.task, avg((l.value - r.value) * (l.value - r.value)) AS q_null FROM so l JOIN so r ON l.task = r.task AND l.solution < r.solution AND l.semantic <> r.semantic GROUP BY ALL)
SELECT task, round(q_repeat, 9) + 0.0 AS q_repeat, round(q_cross, 9) + 0.0 AS q_cross, round(q_null, 9) + 0.0 AS q_null FROM q1 FULL JOIN q2 USING (task) FULL JOIN q3 USING (task)""")
def csvc_q_stats(spark, sf_dir):
    deltas = _deltas(spark, sf_dir)
    return metrics.solution_spread(metrics.solution_profiles(deltas), deltas).select("task", *map(_r, ("q_repeat", "q_cross", "q_null")))


_RESAMPLES = 2000


def _drawn_sql(place: str, parts: str, n: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', 42, {parts})), 1, 8) AS BIGINT) % {n} = {place}"


@_query(_DELTAS + f""",
sw AS (SELECT *, count(*) OVER (PARTITION BY task, semantic) AS n FROM so),
pl AS (SELECT task, solution, row_number() OVER (PARTITION BY task ORDER BY solution) - 1 AS place, count(*) OVER (PARTITION BY task) AS n FROM (SELECT DISTINCT task, solution FROM so)),
dw AS (SELECT p.task, r.replicate, q.solution FROM pl p, (SELECT unnest(range(0, {_RESAMPLES})) AS replicate) r JOIN pl q ON q.task = p.task AND {_drawn_sql("q.place", "p.task, r.replicate, p.place", "p.n")}),
ce AS (SELECT dw.task, replicate, semantic, count(*) AS n, median(value) AS c, list(value) AS vs FROM dw JOIN sw ON sw.task = dw.task AND sw.solution = dw.solution AND sw.n >= 2 GROUP BY ALL HAVING count(*) >= 2),
sr AS (SELECT task, replicate, count(*) AS covered, sqrt(avg(c * c)) AS g, sqrt(avg(list_avg(list_transform(vs, lambda v: (v - c) * (v - c))))) AS r FROM ce GROUP BY ALL),
sx AS (SELECT task, (g - r) / (g + r) AS score FROM sr WHERE covered = (SELECT count(DISTINCT semantic) FROM sw WHERE sw.task = sr.task AND sw.n >= 2))
SELECT task, count(*) AS n_valid, round(quantile_cont(score, 0.025), 6) + 0.0 AS low, round(quantile_cont(score, 0.975), 6) + 0.0 AS high FROM sx GROUP BY ALL""")
def csvc_bootstrap(spark, sf_dir):
    out = metrics.consistency_intervals(metrics.solution_profiles(_deltas(spark, sf_dir)), _RESAMPLES)
    return out.select("task", "n_valid", (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"))


@_query(f"""
, sc AS (SELECT task, avg(v) AS score FROM fr GROUP BY ALL), pl AS (SELECT *, row_number() OVER (ORDER BY task) - 1 AS place, count(*) OVER () AS n FROM sc),
dw AS (SELECT replicate, avg(q.score) AS score FROM pl p, (SELECT unnest(range(0, 2000)) AS replicate) r JOIN pl q ON {_drawn_sql("q.place", "'macro', r.replicate, p.place", "p.n")} GROUP BY ALL)
SELECT (SELECT round(avg(score), 6) + 0.0 FROM sc) AS score, count(*) AS n_valid, round(quantile_cont(score, 0.025), 6) + 0.0 AS low, round(quantile_cont(score, 0.975), 6) + 0.0 AS high FROM dw""")
def macro_bootstrap(spark, sf_dir):
    out = metrics.macro_interval(td.frames(spark, sf_dir).groupBy("task").agg(F.avg("v").alias("score")))
    return out.select((F.round("score", 6) + 0.0).alias("score"), "n_valid", (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"))


@_query("""
, s AS (SELECT domain, task, exp(avg(-((user_id * 13 + k * 7 + d) % 50) / 25.0::DOUBLE)) AS score FROM (SELECT *, unnest(range(0, 3)) AS k FROM ep) GROUP BY ALL)""" + _MACRO)
def sia(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir)).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return _macro(metrics.identification(e.withColumn("logprob", -((F.col("user_id") * 13 + F.col("k") * 7 + F.col("d")) % 50) / F.lit(25.0))))


# --- leaderboard --------------------------------------------------------------

_M = ",".join(f"'{m}'" for m in metrics.METRICS)


def _board(spark, sf_dir):
    """Scores of the nations as baselines, their regions as tracks; one metric of one nation in five is missing."""
    n = td.table(spark, sf_dir, "nation")
    n = n.select("n_nationkey", F.col("n_name").alias("baseline"), F.concat(F.lit("track_"), "n_regionkey").alias("track"))
    rows = n.select("*", F.posexplode(F.array(*map(F.lit, metrics.METRICS))).alias("m", "metric")).select("*", F.posexplode(F.array(*map(F.lit, td.DOMAINS))).alias("d", "domain")).select("*", F.posexplode(F.array(F.lit("sim"), F.lit("real"))).alias("w", "world"))
    rows = rows.where("NOT (n_nationkey % 5 = 0 AND m = n_nationkey % 10)")
    return metrics.leaderboard(rows.withColumn("score", ((F.col("n_nationkey") * 37 + F.col("m") * 17 + F.col("d") * 11 + F.col("w") * 5) % 100) / F.lit(100.0)))


def _board_sql() -> str:
    raw = lambda m, d: f"50 * (max(score) FILTER (metric = '{m}' AND domain = '{d}' AND world = 'sim') + max(score) FILTER (metric = '{m}' AND domain = '{d}' AND world = 'real'))"

    def combined(m: str) -> str:
        a, b, c = (raw(m, d) for d in td.DOMAINS)
        return a if m in metrics.ID_ONLY else f"({a} + {b} + {c}) / 3" if m == "vroc" else f"{a} / 2 + {b} / 4 + {c} / 4"

    norm = lambda m: f"coalesce({f'(raw_{m} + 100) / 2' if m in metrics.SIGNED else f'100 - raw_{m}' if m == 'fpl' else f'raw_{m}'}, 0) AS norm_{m}"
    return f"""WITH b AS (SELECT n_name AS baseline, 'track_' || n_regionkey AS track, metric, domain, world, ((n_nationkey * 37 + m * 17 + d * 11 + w * 5) % 100) / 100.0::DOUBLE AS score FROM nation,
  (SELECT unnest([{_M}]) AS metric, unnest(range(0, 10)) AS m), (SELECT unnest(['id', 'env', 'emb']) AS domain, unnest(range(0, 3)) AS d), (SELECT unnest(['sim', 'real']) AS world, unnest(range(0, 2)) AS w) WHERE NOT (n_nationkey % 5 = 0 AND m = n_nationkey % 10)),
r AS (SELECT baseline, track, {', '.join(f'{combined(m)} AS raw_{m}' for m in metrics.METRICS)} FROM b GROUP BY ALL),
n AS (SELECT *, {', '.join(norm(m) for m in metrics.METRICS)}, concat_ws(',', {', '.join(f"CASE WHEN raw_{m} IS NULL THEN '{m}' END" for m in metrics.METRICS)}) AS missing FROM r),
g AS (SELECT *, (norm_sa + (norm_tga_easy + norm_tga_hard) / 2) / 2 AS tsu, (norm_voc + norm_voc_mem) / 4 + norm_vroc / 2 AS tpm, (norm_fpl + norm_trr) / 2 AS frr, (norm_vs + norm_csvc) / 2 AS vc FROM n),
o AS (SELECT *, (tsu + tpm + frr + vc) / 4 AS overall FROM g)
"""


@_query(_board_sql() + "SELECT baseline, track, missing, round(tsu, 9) + 0.0 AS tsu, round(tpm, 9) + 0.0 AS tpm, round(frr, 9) + 0.0 AS frr, round(vc, 9) + 0.0 AS vc, round(overall, 9) + 0.0 AS overall FROM o", base=False)
def leaderboard(spark, sf_dir):
    return _board(spark, sf_dir).select("baseline", "track", "missing", *map(_r, ("tsu", "tpm", "frr", "vc", "overall")))


@_query(_board_sql() + "SELECT baseline, track, row_number() OVER (PARTITION BY track ORDER BY round(overall, 9) DESC, baseline) AS rank FROM o", base=False)
def rank_tracks(spark, sf_dir):
    board = _board(spark, sf_dir).select("baseline", "track", _r("overall"))
    return metrics.ranked(board).select("baseline", "track", F.col("rank").cast("long").alias("rank"))


# --- kernels ------------------------------------------------------------------


@_query("""
SELECT a.vec_id, round(greatest(-1, least(1, list_sum(list_transform(list_zip(a.embedding, b.c), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.c, lambda x: x * x)))))), 6) + 0.0 AS cosine
FROM embeddings a, (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings WHERE vec_id = 0) b""", base=False)
def cosine_value(spark, sf_dir):
    e = td.table(spark, sf_dir, "embeddings")
    goal = F.broadcast(e.where("vec_id = 0").select(F.transform("embedding", lambda x: x.cast("double")).alias("goal")))
    return e.join(goal).select("vec_id", (F.round(sq.cosine(F.col("embedding"), F.col("goal")), 6) + 0.0).alias("cosine"))


@_query(""" SELECT episode, round(1 - product(1 - y), 6) + 0.0 AS value FROM (SELECT episode, (x % 1000) / 10000.0::DOUBLE AS y FROM fr) GROUP BY ALL""")
def progress_fold(spark, sf_dir):
    rows = td.frames(spark, sf_dir).groupBy("user_id", "d", "episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda p: (p["x"] % 1000) / F.lit(10000.0)).alias("deltas"))
    return rows.select("episode", (F.round(sq.progress_fold(F.col("deltas")), 6) + 0.0).alias("value"))


@_query("""
SELECT event_id, round((1 * exp(b) + 2 * exp(c) + 3 * exp(e) + 4 * exp(f)) / (exp(a) + exp(b) + exp(c) + exp(e) + exp(f)) / 4, 9) + 0.0 AS progress FROM (SELECT event_id, (event_id % 7) / 3.0::DOUBLE AS a, (event_id % 5) / 2.0::DOUBLE AS b, (event_id % 3)::DOUBLE AS c, (event_id % 11) / 5.0::DOUBLE AS e, (event_id % 13) / 6.0::DOUBLE AS f FROM events)""", base=False)
def softmax_progress(spark, sf_dir):
    k = F.col("event_id")
    logits = F.array((k % 7) / F.lit(3.0), (k % 5) / F.lit(2.0), (k % 3).cast("double"), (k % 11) / F.lit(5.0), (k % 13) / F.lit(6.0))
    return td.table(spark, sf_dir, "events").select("event_id", _r(sq.softmax_progress(logits), "progress"))


@_query("""
SELECT event_id, CASE WHEN event_id % 8 < 5 THEN (event_id % 8) / 4.0::DOUBLE END AS scale, CASE WHEN event_id % 250 <= 200 THEN round(((event_id % 250) - 100) / 100.0::DOUBLE, 9) + 0.0 END AS percent FROM events""", base=False)
def parse_scores(spark, sf_dir):
    k = F.col("event_id")
    e = td.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("I think. answer : "), k % 8 + 1).alias("a"), F.concat(F.lit(" <score>"), F.when(k % 250 >= 100, "+").otherwise(""), k % 250 - 100, F.lit("%</score>")).alias("b"))
    return e.select("event_id", tx.scale_answer(F.col("a")).alias("scale"), _r(tx.percent_score(F.col("b")), "percent"))


@_query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'voc_mem' WHEN 1 THEN 'voc_mem' WHEN 2 THEN 'voc_f1' WHEN 3 THEN 'csvc' ELSE trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'counterfactual-' || lpad(CAST(p_size AS VARCHAR), 3, '0') ELSE 'other_' || p_size END AS id FROM part""", base=False)
def canonical_names(spark, sf_dir):
    p = td.table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Counterfactual_"), "p_size")).otherwise(F.concat(F.lit("other_"), "p_size"))
    k = F.col("p_size") % 5
    name = F.when(k == 0, "Mem-VOC ").when(k == 1, "VOCMEM").when(k == 2, " vocF1").when(k == 3, "CSPC").otherwise(F.col("p_type"))
    return p.select("p_partkey", tx.canonical_metric(name).alias("name"), tx.counterfactual_id(raw).alias("id"))


@_query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL", base=False)
def json_props(spark, sf_dir):
    return td.table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT episode, CAST(k AS BIGINT) AS k, CAST(a + o AS BIGINT) AS before, CAST(b - 1 - o AS BIGINT) AS after FROM (
  SELECT *, least(CAST(round_even(i * 10.0::DOUBLE * 0.15::DOUBLE, 0) AS BIGINT), (b - a - 2) // 2) AS o FROM (
    SELECT *, unnest(range(0, 4)) AS i, (num_frames * k) // 3 AS a, (num_frames * (k + 1)) // 3 AS b FROM (SELECT *, unnest(range(0, 3)) AS k FROM ep)) WHERE b - a >= 2)""")
def boundary_windows(spark, sf_dir):
    e = td.episodes(td.frames(spark, sf_dir)).select("episode", "num_frames", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    start, end = (F.floor(F.col("num_frames") * (F.col("k") + i) / 3).cast("int") for i in (0, 1))
    p = e.where(end - start >= 2).withColumn("p", F.explode(fr.boundary_pairs(start, end, F.lit(td.FPS))))
    return p.select("episode", F.col("k").cast("long").alias("k"), F.col("p.before").cast("long").alias("before"), F.col("p.after").cast("long").alias("after"))
