"""The metrics over scored plans; episode scores come out, macro means follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from . import statistics
from .statistics import macro_mean, pairwise_wins, spearman

CELL = ["domain", "task"]
EPISODE = [*CELL, "episode"]


def success_accuracy(scored: DataFrame) -> DataFrame:
    """domain, task, score from scored tail frames: terminal means, then wins of successes over failures."""
    terminal = scored.groupBy(*EPISODE, "success").agg(F.avg("v").alias("terminal"))
    return pairwise_wins(terminal, CELL, "terminal", "success").select(*CELL, "score")


def success_diagnostics(scored: DataFrame) -> DataFrame:
    """success and failure macro means, their gap, and the gap in per cent of the success mean (null if 0)."""
    terminal = scored.groupBy(*EPISODE, "success").agg(F.avg("v").alias("score"))
    m = macro_mean(terminal, extra=("success",)).where("level = 'overall'")
    out = m.agg(F.max(F.when(F.col("success"), F.col("score"))).alias("success_mean"), F.max(F.when(~F.col("success"), F.col("score"))).alias("failure_mean"))
    gap = F.col("success_mean") - F.col("failure_mean")
    return out.withColumn("gap", gap).withColumn("gap_percent", F.try_divide(100 * gap, F.col("success_mean")))


def grounding_scores(scored: DataFrame) -> DataFrame:
    """A row per episode and candidate: its mean score, the correct one's, and what it earns in the pair."""
    means = scored.groupBy(*EPISODE, "candidate").agg(F.avg("score").alias("mean"))
    own = Window.partitionBy(*EPISODE)
    means = means.withColumn("correct", F.max(F.when(F.col("candidate") == "correct", F.col("mean"))).over(own))
    credit = F.when(F.col("correct") > F.col("mean"), 1.0).when(F.col("correct") == F.col("mean"), 0.5).otherwise(0.0)
    return means.withColumn("credit", credit).withColumn("margin", F.col("correct") - F.col("mean"))


def grounding(candidates: DataFrame) -> DataFrame:
    """Episode rows: pairwise accuracy (ties 0.5) and strict top-1, of grounding_scores."""
    wrong = candidates.where("candidate <> 'correct'")
    return wrong.groupBy(*EPISODE).agg(F.avg("credit").alias("pairwise"), F.min(F.when(F.col("correct") > F.col("mean"), 1.0).otherwise(0.0)).alias("top1"))


def order_correlation(points: DataFrame, target: str, keys: tuple[str, ...] = tuple(EPISODE)) -> DataFrame:
    """keys, score: rank correlation of v with the target; constant values give 0."""
    return spearman(points, list(keys), "v", target).select(*keys, F.coalesce("rho", F.lit(0.0)).alias("score"))


def cycle_correlation(points: DataFrame) -> DataFrame:
    """up, down and cycle per episode from (position, n_path, v); the turn belongs to both halves."""
    turn = (F.col("n_path") - 1) / 2
    up = points.where(F.col("position") <= turn).withColumn("target", F.col("position"))
    down = points.where(F.col("position") >= turn).withColumn("target", -F.col("position"))
    both = order_correlation(up, "target").withColumnRenamed("score", "up").join(order_correlation(down, "target").withColumnRenamed("score", "down"), EPISODE)
    return both.withColumn("cycle", (F.col("up") + F.col("down")) / 2)


def curve_correlations(curves: DataFrame, **halves: Column) -> DataFrame:
    """curves with a column for each given array of values: its rank correlation with its places, 0 where it is constant. Nothing is shuffled."""
    return curves.withColumns({name: F.coalesce(sq.rank_correlation(values), F.lit(0.0)) for name, values in halves.items()})


def smoothness(points: DataFrame, least: int = 7, keys: tuple[str, ...] = tuple(EPISODE)) -> DataFrame:
    """er, scale and vs per episode from (frame, time, v) with `least` points or more; keys may name further columns by which points lie together."""
    row = F.struct("frame", F.col("time").cast("double").alias("time"), F.col("v").cast("double").alias("v"))
    return smooth_curves(points.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("points")), least)


def smooth_curves(curves: DataFrame, least: int = 7) -> DataFrame:
    """The same of curves with `points`, an array of (frame, time, v) in order: sums over neighbours, without a window."""
    n = F.size("points")
    c = curves.where(n >= least).withColumn("n_points", n.cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    value = lambda a: F.transform(a, lambda p: p["v"])
    c = c.withColumn("first", total(value(F.slice("points", F.lit(1), F.lit(3)))) / 3).withColumn("last", total(value(F.slice("points", F.lit(-3), F.lit(3)))) / 3)
    z = lambda p, i: F.when(i < 3, F.col("first")).when(i >= n - 3, F.col("last")).otherwise(p["v"])
    c = c.withColumn("z", F.transform("points", z))
    pairs = lambda a: F.arrays_zip(F.slice(a, F.lit(2), n - 1).alias("b"), F.slice(a, F.lit(1), n - 1).alias("a"))
    c = c.withColumn("tv", total(F.transform(pairs("z"), lambda x: F.abs(x["b"] - x["a"]))))
    c = c.withColumn("moved", total(F.transform(pairs("points"), lambda x: F.when(x["b"]["v"] != x["a"]["v"], x["b"]["time"] - x["a"]["time"]).otherwise(0.0))))
    c = c.withColumn("duration", total(F.transform(pairs("points"), lambda x: x["b"]["time"] - x["a"]["time"])))
    er = F.when(F.col("tv") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.abs(F.col("last") - F.col("first")), F.col("tv"))))
    c = c.withColumn("er", er).withColumn("scale", F.try_divide(F.col("moved"), F.col("duration")))
    return c.select(*(k for k in curves.columns if k != "points"), "first", "last", "tv", "moved", "duration", "n_points", "er", "scale", (F.col("er") * F.col("scale")).alias("vs"))


def failure_points(curves: DataFrame, alpha: float = 0.2) -> DataFrame:
    """pred, drawdown, depth and score (error, less is better) per episode from curve, onset and num_frames."""
    c = curves.withColumn("drawdown", sq.drawdown(F.transform("curve", lambda p: p["v"])))
    c = c.withColumn("best", sq.steepest(sq.descents(F.col("curve"), F.col("drawdown") * F.lit(alpha))))
    last = F.col("num_frames") - 1
    error = F.when(F.col("best").isNull(), F.greatest(F.col("onset"), last - F.col("onset"))).otherwise(F.abs(F.col("best.start") - F.col("onset")))
    return c.select(*EPISODE, F.col("best.start").alias("pred"), "drawdown", F.col("best.depth").alias("depth"), (error / last).alias("score"))


def recovery_branches(stages: DataFrame) -> DataFrame:
    """direction and ok per stage from frames, values, weights and sign (0: not rising)."""
    s = stages.withColumn("direction", sq.direction(F.col("values"), F.col("weights")))
    ok = F.when(F.col("sign") == 0, F.col("direction") <= 0).otherwise(F.col("sign") * F.col("direction") > 0)
    return s.withColumn("ok", ok)


def recovery_groups(branches: DataFrame) -> DataFrame:
    """score per complete group: a branch counts if all its stages do; mean of the branches."""
    b = branches.groupBy(*EPISODE, "trr_group").agg(F.min(F.col("ok").cast("int")).alias("all_ok"))
    return b.groupBy(*CELL, "trr_group").agg(F.avg("all_ok").alias("score"))


def of_semantics(episodes: DataFrame, deltas: str = "deltas") -> DataFrame:
    """Rows (the other columns, semantic, value) of episodes with a map semantic -> value: the form in which solutions are scored. Null values are left out."""
    rest = [c for c in episodes.columns if c != deltas]
    return episodes.select(*rest, F.explode(deltas).alias("semantic", "value")).where("value IS NOT NULL")


def solution_profiles(deltas: DataFrame) -> DataFrame:
    """task, semantic, solution, value: one profile of the normal episodes (their median) and each diverse episode."""
    normal = deltas.where("solution = 'normal'").groupBy("task", "semantic").agg(F.median("value").alias("value")).select("task", "semantic", F.lit("normal").alias("solution"), "value")
    diverse = deltas.where("solution = 'diverse'").select("task", "semantic", F.col("episode").alias("solution"), "value")
    return normal.unionByName(diverse)


def solution_consistency(profiles: DataFrame) -> DataFrame:
    """center, rmse, score and identifiable per task; a semantic needs two solutions, a task one such semantic."""
    own = Window.partitionBy("task", "semantic")
    p = profiles.withColumn("n", F.count(F.lit(1)).over(own)).where("n >= 2").withColumn("c", F.median("value").over(own))
    s = p.groupBy("task", "semantic").agg(F.max("c").alias("c"), F.avg((F.col("value") - F.col("c")) * (F.col("value") - F.col("c"))).alias("e"))
    t = s.groupBy("task").agg(F.count(F.lit(1)).alias("n_semantics"), F.sqrt(F.avg(F.col("c") * F.col("c"))).alias("center"), F.sqrt(F.avg("e")).alias("rmse"))
    score = F.coalesce(F.try_divide(F.col("center") - F.col("rmse"), F.col("center") + F.col("rmse")), F.lit(-1.0))
    return t.withColumn("score", score).withColumn("identifiable", F.col("center") + F.col("rmse") > 0)


def consistency_intervals(profiles: DataFrame, times: int = 2000, seed: int = 42) -> DataFrame:
    """task, n_valid, low, high of the score over resampled solutions.

    The semantics stay those of the whole: a replicate in which one of them has
    fewer than two solutions has no score.
    """
    counted = profiles.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("task", "semantic"))).where("n >= 2").drop("n")
    wanted = counted.groupBy("task").agg(F.count_distinct("semantic").alias("wanted"))
    whole = profiles.select("task", "solution").distinct().join(counted, ["task", "solution"], "left")
    centers = statistics.resampled_medians(whole, "task", "solution", "semantic", "value", times, seed)
    key = ["task", "replicate"]
    # mean squared distance from the centre, from sums
    error = F.greatest((F.col("ss") - 2 * F.col("c") * F.col("s")) / F.col("n") + F.col("c") * F.col("c"), F.lit(0.0))
    scored = centers.where("n >= 2").withColumn("e", error).groupBy(*key).agg(F.count(F.lit(1)).alias("covered"), F.sqrt(F.avg(F.col("c") * F.col("c"))).alias("g"), F.sqrt(F.avg("e")).alias("d"))
    scored = scored.join(F.broadcast(wanted), "task").where("covered = wanted")
    return statistics.interval(scored.withColumn("score", F.coalesce(F.try_divide(F.col("g") - F.col("d"), F.col("g") + F.col("d")), F.lit(-1.0))), ["task"])


def macro_interval(scores: DataFrame, times: int = 2000, seed: int = 42) -> DataFrame:
    """score, n_valid, low, high of the mean over resampled tasks; scores (task, score), null scores left out."""
    some = scores.where("score IS NOT NULL").select("task", "score").withColumn("all_", F.lit("macro"))
    means = statistics.resamples(some, ["all_"], "task", times, seed).groupBy("all_", "replicate").agg(F.avg("score").alias("score"))
    return some.groupBy("all_").agg(F.avg("score").alias("score")).join(statistics.interval(means, ["all_"]), "all_").drop("all_")


def solution_spread(profiles: DataFrame, deltas: DataFrame) -> DataFrame:
    """Mean squared differences per task: between normal repeats, between solutions, and between mismatched semantics.

    The first two are 2 n / (n - 1) times a variance, so no pairs are formed; the
    third is put together from per-solution sums: sum over pairs of solutions and
    unequal semantics = all pairs - pairs of one solution - pairs of one semantic.
    """
    spread = lambda rows, name: rows.groupBy("task", "semantic").agg((2 * F.var_samp("value")).alias("q"), F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("task").agg(F.avg("q").alias(name))
    repeat, cross = spread(deltas.where("solution = 'normal'"), "q_repeat"), spread(profiles, "q_cross")

    def pairs(keys: list[str]) -> DataFrame:
        s = profiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
        return s.groupBy("task").agg(F.sum(F.col("n") * F.col("ss") - F.col("s") * F.col("s")).alias("d"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("m"))

    whole, one, same = pairs(["task"]), pairs(["task", "solution"]), pairs(["task", "semantic"])
    null = whole.join(one.select("task", F.col("d").alias("d1"), F.col("m").alias("m1")), "task").join(same.select("task", F.col("d").alias("d2"), F.col("m").alias("m2")), "task")
    null = null.select("task", F.try_divide(F.col("d") - F.col("d1") - F.col("d2"), F.col("m") - F.col("m1") - F.col("m2")).alias("q_null"))
    return repeat.join(cross, "task", "full_outer").join(null, "task", "full_outer")


def identification(logprobs: DataFrame) -> DataFrame:
    """domain, task, score: geometric mean of the targets' probabilities. A log-probability above 0, not finite or -9999 and less is an error."""
    good = F.col("logprob").isNotNull() & (F.col("logprob") <= 0) & (F.col("logprob") > -9999)
    checked = logprobs.withColumn("logprob", F.when(good, F.col("logprob")).otherwise(F.raise_error(F.lit("invalid log-probability"))))
    return checked.groupBy(*CELL).agg(F.exp(F.avg("logprob")).alias("score"))


# --- leaderboard --------------------------------------------------------------

METRICS = ("sa", "tga_easy", "tga_hard", "voc", "voc_mem", "vroc", "fpl", "trr", "vs", "csvc")
ID_ONLY = ("trr", "csvc")
SIGNED = ("voc", "voc_mem", "vroc", "csvc")


def leaderboard(scores: DataFrame) -> DataFrame:
    """A row per baseline and track from (baseline, track, world, metric, domain, score).

    raw = 50 * (sim + real) per domain; domains are weighted 1/2, 1/4, 1/4 (some
    metrics have the first only, vroc weighs them alike); signed metrics and the
    error are brought to 0..100; a missing metric counts 0 and is listed.
    """
    key = ["baseline", "track"]

    def raw(metric: str, domain: str) -> Column:
        of = lambda world: F.max(F.when((F.col("metric") == metric) & (F.col("domain") == domain) & (F.col("world") == world), F.col("score")))
        return 50 * (of("sim") + of("real"))

    def combined(metric: str) -> Column:
        if metric in ID_ONLY:
            return raw(metric, "id")
        parts = [raw(metric, d) for d in ("id", "env", "emb")]
        if metric == "vroc":
            return (parts[0] + parts[1] + parts[2]) / 3
        return parts[0] / 2 + parts[1] / 4 + parts[2] / 4

    out = scores.groupBy(*key).agg(*(combined(m).alias(f"raw_{m}") for m in METRICS))

    def normal(metric: str) -> Column:
        x = F.col(f"raw_{metric}")
        x = (x + 100) / 2 if metric in SIGNED else 100 - x if metric == "fpl" else x
        return F.coalesce(x, F.lit(0.0))

    out = out.withColumn("missing", F.array_join(F.filter(F.array(*(F.when(F.col(f"raw_{m}").isNull(), F.lit(m)) for m in METRICS)), lambda x: x.isNotNull()), ","))
    out = out.withColumns({f"norm_{m}": normal(m) for m in METRICS})
    n = {m: F.col(f"norm_{m}") for m in METRICS}
    out = out.withColumns({
        "tsu": (n["sa"] + (n["tga_easy"] + n["tga_hard"]) / 2) / 2, "tpm": (n["voc"] + n["voc_mem"]) / 4 + n["vroc"] / 2,
        "frr": (n["fpl"] + n["trr"]) / 2, "vc": (n["vs"] + n["csvc"]) / 2,
    })
    return out.withColumn("overall", (F.col("tsu") + F.col("tpm") + F.col("frr") + F.col("vc")) / 4)


def ranked(board: DataFrame) -> DataFrame:
    """rank within a track by overall, then by name. A track lists the compared baselines, a short list."""
    return board.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("overall"), "baseline")))


def forward_fill(rows: DataFrame, keys: list[str], order: str, value: str, default: float = 0.0) -> Column:
    """The latest value at or before a row; the default before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default))


