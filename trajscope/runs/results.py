"""What a result says beyond its score: a record for each episode (or task), and the figures beside the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import public_id
from ..operators import metrics as mt
from ..operators import statistics

EPISODE = ["domain", "task", "episode"]
#: Names of the metrics' protocols, which a leaderboard compares, and the types of counterfactual instructions.
PROTOCOLS = {
    "sa": "terminal-value-tail2pct-average-sa-v5",
    "tga_easy": "trajectory-gain-edge2pct-easy-v1",
    "tga_hard": "trajectory-gain-edge2pct-hard-v1",
    "voc": "voc-cycle-forward-v2",
    "cycle_voc": "continuous-cycle-halves-v1",
    "vs": "vs_v1-cycle-forward-5hz-v2",
    "fpl": "zigzag-onset-normalized-alpha0.2-rzero-excluded-v2",
    "trr": "trr-binary-timeweighted-10hz-k10-v2",
    "csvc": "semantic-gain-symmetric-ratio-v2",
    "sia": "candidate-logprob-mean-exp-single-digit-v3",
}
COUNTERFACTUAL_TYPES = {"001": "objects", "002": "actions", "003": "placement", "004": "constraints"}


def nested(rows: list, score: str = "score") -> dict:
    """overall, domains {domain: {mean, tasks}} of collected rows of macro means."""
    out: dict = {"overall": None, "domains": {}}
    for r in rows:
        if r["level"] == "overall":
            out["overall"] = r[score]
        else:
            own = out["domains"].setdefault(r["domain"], {"mean": None, "tasks": {}})
            if r["level"] == "domain":
                own["mean"] = r[score]
            else:
                own["tasks"][r["task"]] = r[score]
    return out


def summary(scores: DataFrame, value: str = "score") -> dict:
    """Macro means of rows (domain, task, value): a row per task and domain reaches the driver."""
    return nested(statistics.macro_mean(scores, value).collect())


def summaries(scores: DataFrame, values: list[str]) -> dict[str, dict]:
    """The same of several columns, in one pass."""
    flat = scores.select("domain", "task", F.explode(F.create_map(*(x for v in values for x in (F.lit(v), F.col(v).cast("double"))))).alias("of", "score"))
    return _by_key(flat, "of", "score")


def _by_key(rows: DataFrame, key: str, value: str) -> dict[str, dict]:
    found: dict[str, list] = {}
    for r in statistics.macro_mean(rows, value, extra=(key,)).collect():
        found.setdefault(r[key], []).append(r)
    return {k: nested(found[k]) for k in sorted(found)}


# --- records ------------------------------------------------------------------


def terminal_values(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*EPISODE, "success").agg(F.avg("v").alias("score"))


def grounding_records(scored: DataFrame) -> DataFrame:
    """Per episode: the correct instruction's score, the others' by id, their margins, what they earn, and top-1 as score."""
    c = mt.grounding_scores(scored.withColumn("score", F.col("v"))).withColumn("id", public_id(F.col("candidate")))
    wrong = F.col("candidate") != "correct"
    of = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.when(wrong, F.struct("id", value)))))
    return c.groupBy(*EPISODE).agg(
        F.max("correct").alias("correct_score"), of("mean").alias("scores"), of("margin").alias("margins"), of("credit").alias("credits"),
        F.avg(F.when(wrong, F.col("credit"))).alias("pairwise"), F.min(F.when(wrong, (F.col("correct") > F.col("mean")).cast("double"))).alias("score"),
    )


def order_records(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("n_frames"))
    return mt.order_correlation(scored, "anchor").join(counts, EPISODE)


def cycle_records(scored: DataFrame) -> DataFrame:
    return mt.cycle_correlation(scored).select(*EPISODE, F.col("up").alias("forward"), F.col("down").alias("reverse"), F.col("cycle").alias("score"))


def smooth_records(scored: DataFrame) -> DataFrame:
    points = scored.withColumn("frame", F.col("anchor")).withColumn("time", F.col("anchor") / F.col("fps"))
    return mt.smoothness(points).select(*EPISODE, "n_points", "first", "last", "tv", "er", "scale", F.col("vs").alias("score"))


def failure_records(scored: DataFrame) -> DataFrame:
    curve = F.transform(F.array_sort(F.collect_list(F.struct(F.col("anchor").alias("f"), "v"))), lambda p: F.struct(p["f"].alias("f"), p["v"].alias("v")))
    curves = scored.groupBy(*EPISODE, "num_frames", "onset").agg(curve.alias("curve"))
    return mt.failure_points(curves).join(curves.select(*EPISODE, "onset"), EPISODE)


def recovery_records(scored: DataFrame) -> DataFrame:
    """Per group: the mean of its branches as score, and the direction and verdict of each stage."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"])
    stages = mt.recovery_branches(scored.groupBy(*EPISODE, "role", "trr_group", "stage", "sign", "weights").agg(values.alias("values")))
    row = F.struct("role", "episode", "stage", "sign", "direction", "ok")
    return mt.recovery_groups(stages).join(stages.groupBy("domain", "task", "trr_group").agg(F.array_sort(F.collect_list(row)).alias("stages")), ["domain", "task", "trr_group"])


def solution_records(scored: DataFrame) -> DataFrame:
    """Per task: centre, spread, score, its interval, the auxiliary spreads and how many solutions cover each semantic."""
    deltas = scored.groupBy("domain", "task", "episode", "solution", "semantic").agg(F.median("v").alias("value"))
    profiles = mt.solution_profiles(deltas)
    coverage = profiles.groupBy("task", "semantic").agg(F.count(F.lit(1)).alias("n")).groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("semantic", "n")))).alias("coverage"))
    out = coverage.join(mt.solution_consistency(profiles), "task", "left").join(mt.solution_spread(profiles, deltas), "task", "left").join(mt.consistency_intervals(profiles), "task", "left")
    return out.select(F.lit("id").alias("domain"), "task", "score", "center", "rmse", F.coalesce("identifiable", F.lit(False)).alias("identifiable"), "n_semantics", "coverage", "q_repeat", "q_cross", "q_null", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), "low", "high")


def identification_records(scored: DataFrame) -> DataFrame:
    return scored.select("query_id", *EPISODE, "target", "logprob", F.exp("logprob").alias("probability"))


# --- figures beside the mean --------------------------------------------------


def terminal_figures(records: DataFrame) -> dict:
    both = statistics.macro_mean(records, extra=("success",)).where("level = 'overall'").collect()
    mean = {r["success"]: r["score"] for r in both}
    gap = mean[True] - mean[False]
    values = {"success_macro_mean": mean[True], "failure_macro_mean": mean[False], "range": mean[True], "gap_over_range_percent": 100 * gap / mean[True] if mean[True] else None}
    return {"gap": gap, "terminal_values": values}


def grounding_figures(records: DataFrame) -> dict:
    pair = summary(records, "pairwise")
    wrong = records.select("domain", "task", F.explode("margins").alias("id", "margin"), "credits", "scores").withColumn("credit", F.col("credits")[F.col("id")])
    kinds = F.create_map(*(F.lit(x) for kv in COUNTERFACTUAL_TYPES.items() for x in kv))
    wrong = wrong.withColumn("type", F.try_element_at(kinds, F.col("id")))

    def of(key: str) -> dict:
        some = wrong.where(F.col(key).isNotNull())
        credit, margin = _by_key(some, key, "credit"), _by_key(some, key, "margin")
        return {k: {"pairwise_accuracy": credit[k], "mean_margin": margin[k]} for k in credit}

    cells = records.select("domain", "task", F.explode(F.map_concat(F.create_map(F.lit("correct"), F.col("correct_score")), "scores")).alias("id", "v"))
    matrix: dict = {}
    for r in cells.groupBy("domain", "task", "id").agg(F.avg("v").alias("v")).orderBy("domain", "task", "id").collect():  # a row per task and candidate
        matrix.setdefault(r["domain"], {}).setdefault(r["task"], {})[r["id"]] = r["v"]
    return {"pairwise_mean": pair["overall"], "pairwise_domains": pair["domains"], "counterfactual_by_id": of("id"), "counterfactual_by_type": of("type"), "confusion_matrix": matrix, "tie_credit": 0.5, "edge_fraction": 0.02}


def cycle_figures(records: DataFrame) -> dict:
    return {"components": {"protocol": PROTOCOLS["cycle_voc"], **summaries(records, ["forward", "reverse"])}}


def smooth_figures(records: DataFrame) -> dict:
    own = summaries(records, ["er", "scale"])
    return {"er": own["er"], "nonflat_time_fraction": own["scale"], "n_episodes": records.count(), "sample_hz": 5, "endpoint_samples": 3}


def failure_figures(records: DataFrame) -> dict:
    return {"zigzag_alpha": 0.2, "sample_rate_hz": 5.0, "n_episodes": records.count()}


def recovery_figures(records: DataFrame) -> dict:
    return {"n_groups": records.count()}


def solution_figures(records: DataFrame) -> dict:
    n = records.agg(F.count(F.lit(1)).alias("tasks"), F.count_if("identifiable").alias("sure")).first()
    macro = mt.macro_interval(records).first()
    interval = [macro["low"], macro["high"]] if macro and macro["n_valid"] else None
    return {"score_ci95": interval, "n_tasks": n["tasks"], "identifiable_tasks": n["sure"], "unidentifiable_task_rate": 1 - n["sure"] / n["tasks"] if n["tasks"] else None}


RECORDS = {
    "sa": (terminal_values, terminal_figures), "tga_easy": (grounding_records, grounding_figures), "tga_hard": (grounding_records, grounding_figures), "voc": (order_records, None),
    "voc_mem": (order_records, None), "cycle_voc": (cycle_records, cycle_figures), "vs": (smooth_records, smooth_figures), "fpl": (failure_records, failure_figures),
    "trr": (recovery_records, recovery_figures), "csvc": (solution_records, solution_figures), "sia": (identification_records, None),
}


def record_keys(records: DataFrame) -> list[str]:
    return [c for c in ("query_id", "domain", "task", "episode", "trr_group") if c in records.columns]


def number(records: DataFrame) -> Column:
    return F.col("logprob" if "logprob" in records.columns else "score")
