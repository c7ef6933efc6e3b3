import pytest
from pyspark.sql import functions as F

from trajscope.functions import text as tx
from trajscope.operators import checked, metrics, statistics
from trajscope.plans import cohorts, queries


def _one(df):
    return df.first().asDict()


def _points(spark, values, times=None):
    rows = [("id", "t", "e", k, float(times[k] if times else k), float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "domain string, task string, episode string, frame int, time double, v double")


@pytest.mark.parametrize("values,vs", [([0, 1, 2, 3, 4, 5, 6], 1), ([0, 0, 0, 1, 1, 1, 1], 1 / 6), ([0, 0, 0, 1, 0, 0, 0], 0), ([1] * 7, 0), ([0, 1, 2, 1, 1, 1, 1], 1 / 2)])
def test_smoothness(spark, values, vs):
    assert _one(metrics.smoothness(_points(spark, values)))["vs"] == pytest.approx(vs)


def test_smoothness_weighs_time(spark):
    got = _one(metrics.smoothness(_points(spark, [0, 0, 0, 1, 1, 1, 1], [0, 1, 2, 5, 6, 7, 8])))
    assert got["scale"] == pytest.approx(3 / 8)
    assert metrics.smoothness(_points(spark, [0] * 6)).count() == 0


@pytest.mark.parametrize("values,up,down", [([0, 0.5, 1, 0.5, 0], 1, 1), ([0, 0.25, 0.5, 0.75, 1], 1, -1), ([1, 0.5, 0, 0.5, 1], -1, -1), ([1] * 5, 0, 0), ([0, 0, 0, 1, 0], 0, 0)])
def test_cycle(spark, values, up, down):
    p = _points(spark, values).withColumn("position", F.col("frame")).withColumn("n_path", F.lit(5))
    got = _one(metrics.cycle_correlation(p))
    assert (got["up"], got["down"], got["cycle"]) == pytest.approx((up, down, (up + down) / 2))


@pytest.mark.parametrize("values,rho", [([1, 2, 3], 1), ([3, 2, 1], -1), ([-0.0, 0.0, -0.0], 0)])
def test_order_correlation(spark, values, rho):
    assert _one(metrics.order_correlation(_points(spark, values), "frame"))["score"] == pytest.approx(rho)


def _accuracy(spark, st, frt):
    rows = [("id", "t", f"s{k}", True, v) for k, v in enumerate(st)] + [("id", "t", f"f{k}", False, v) for k, v in enumerate(frt)]
    return spark.createDataFrame(rows, "domain string, task string, episode string, success boolean, v double")


def test_success_accuracy(spark):
    rows = _accuracy(spark, [0.9, 0.4], [0.5, 0.3])
    assert _one(metrics.success_accuracy(rows))["score"] == 0.75
    d = _one(metrics.success_diagnostics(rows))
    assert (d["gap"], d["success_mean"], d["failure_mean"], d["gap_percent"]) == pytest.approx((0.25, 0.65, 0.4, 100 * 0.25 / 0.65))


def test_success_accuracy_ties_and_zero_range(spark):
    assert _one(metrics.success_accuracy(_accuracy(spark, [0.5, 0.5], [0.5, 0.5])))["score"] == 0
    assert _one(metrics.success_diagnostics(_accuracy(spark, [0.0], [-0.5])))["gap_percent"] is None


@pytest.mark.parametrize("negatives,top1,pairwise", [([0.2, 0.8], 0, 0.75), ([0.9, 0.7, 0.8, 0.2], 0, 0.625), ([0.1], 1, 1)])
def test_grounding(spark, negatives, top1, pairwise):
    rows = [("id", "t", "e", "correct", 0.8)] + [("id", "t", "e", f"c{k}", v) for k, v in enumerate(negatives)]
    df = spark.createDataFrame(rows, "domain string, task string, episode string, candidate string, score double")
    got = _one(metrics.grounding(metrics.grounding_scores(df)))
    assert (got["top1"], got["pairwise"]) == pytest.approx((top1, pairwise))


def _failure(spark, values, onset, n=100):
    curve = [(f, v) for f, v in values]
    df = spark.createDataFrame([("id", "t", "e", n, onset, curve)], "domain string, task string, episode string, num_frames int, onset int, curve array<struct<f:int,v:double>>")
    return _one(metrics.failure_points(df))


def test_failure_point_without_a_decline(spark):
    got = _failure(spark, [(f, f / 99) for f in range(0, 100, 3)], 40)
    assert got["pred"] is None and got["score"] == pytest.approx(59 / 99)


def test_failure_point(spark):
    got = _failure(spark, [(0, 0.2), (30, 1.0), (60, 0.2), (99, 0.4)], 40)
    assert got["pred"] == 30 and got["drawdown"] == pytest.approx(0.8) and got["score"] == pytest.approx(10 / 99)


def test_macro_mean_is_unweighted(spark):
    df = spark.createDataFrame([("id", "a", 0.0), ("id", "a", 0.0), ("env", "a", 1.0)], "domain string, task string, score double")
    got = {(r["level"], r["domain"]): r["score"] for r in statistics.macro_mean(df).collect()}
    assert got[("overall", "*")] == 0.5 and got[("domain", "id")] == 0


def _profiles(spark, rows):
    return spark.createDataFrame([("t", s, sem, float(v)) for s, sem, v in rows], "task string, solution string, semantic string, value double")


@pytest.mark.parametrize(
    "rows,score",
    [([("normal", "a", 1), ("d", "a", 3)], 1 / 3), ([("normal", "a", -5), ("d1", "a", 1), ("d2", "a", 1)], (1 - 12**0.5) / (1 + 12**0.5)), ([("normal", "a", 0), ("d", "a", 0)], -1)],
)
def test_consistency(spark, rows, score):
    assert _one(metrics.solution_consistency(_profiles(spark, rows)))["score"] == pytest.approx(score)


def test_consistency_without_coverage(spark):
    assert metrics.solution_consistency(_profiles(spark, [("normal", "a", 1), ("d", "b", 2)])).count() == 0
    got = _one(metrics.solution_consistency(_profiles(spark, [("normal", "a", 1), ("normal", "b", 2), ("d1", "a", 3), ("d1", "b", 4), ("d2", "a", 5)])))
    assert got["rmse"] == pytest.approx(((8 / 3 + 1) / 2) ** 0.5)


def test_identification_refuses_bad_logprobs(spark):
    df = lambda v: spark.createDataFrame([("id", "t", v)], "domain string, task string, logprob double")
    assert _one(metrics.identification(df(-0.5)))["score"] == pytest.approx(0.6065306597)
    for bad in (0.1, float("nan"), float("-inf"), -9999.0, None):
        with pytest.raises(Exception, match="log-probability"):
            metrics.identification(df(bad)).collect()


def test_leaderboard(spark):
    values = {"sa": 0.6, "tga_easy": 0.8, "tga_hard": 0.4, "voc": 0.2, "voc_mem": 0.4, "fpl": 0.3, "trr": 0.5, "vs": 0.8, "csvc": -0.2, "vroc": 0.6}
    rows = [("b", "x", w, m, d, v) for m, v in values.items() for d in ("id", "env", "emb") for w in ("sim", "real")]
    schema = "baseline string, track string, world string, metric string, domain string, score double"
    got = _one(metrics.leaderboard(spark.createDataFrame(rows, schema)))
    assert (got["tsu"], got["tpm"], got["frr"], got["vc"], got["overall"]) == pytest.approx((60, 72.5, 60, 60, 63.125))
    got = _one(metrics.leaderboard(spark.createDataFrame([r for r in rows if r[3] not in ("vs", "csvc")], schema)))
    assert got["raw_vs"] is None and got["vc"] == 0 and got["missing"] == "vs,csvc"


def test_join_checked(spark):
    plan = spark.createDataFrame([("a", "value"), ("b", "value")], "query_id string, op string")
    pred = lambda rows: spark.createDataFrame(rows, "query_id string, op string, score double")
    assert checked.join_checked(plan, pred([("a", "value", 1.0), ("b", "value", 2.0)])).count() == 2
    for rows in ([("a", "value", 1.0)], [("a", "value", 1.0), ("b", "compare", 1.0)], [("a", "value", 1.0), ("b", "value", 1.0), ("b", "value", 1.0)], [("a", "value", 1.0), ("b", "value", 1.0), ("c", "value", 1.0)]):
        with pytest.raises(ValueError, match="do not cover"):
            checked.join_checked(plan, pred(rows))
    assert checked.join_checked(plan, pred([("a", "value", 1.0), ("b", "value", 1.0), ("c", "value", 1.0)]), ignore_extra=True).count() == 2


def test_tables_by_cell(spark):
    t = lambda rows: spark.createDataFrame(rows, "domain string, task string, score double, fingerprint string")
    old, new = t([("id", "a", 1.0, "x"), ("id", "b", 2.0, "x")]), t([("id", "b", 3.0, "x")])
    assert {(r["task"], r["score"]) for r in checked.merge_cells(old, new).collect()} == {("a", 1.0), ("b", 3.0)}
    assert [r["task"] for r in checked.missing_cells(old, new).collect()] == ["a"]
    with pytest.raises(ValueError, match="other inputs"):
        checked.missing_cells(old, t([("id", "b", 3.0, "y")]))
    assert checked.differences(old, new, ["domain", "task"]).count() == 2
    with pytest.raises(ValueError, match="two parts"):
        checked.union_parts([old, old], "task")
    assert checked.fingerprint(old, ["domain"]).count() == 1


def test_cohorts(spark):
    rows = [(True, False, None, True), (False, True, None, True), (True, True, None, True), (True, False, "diverse", True), (True, False, "normal", False)]
    df = spark.createDataFrame(rows, "s boolean, g boolean, sol string, a boolean").select(cohorts.exclusion_reason(*map(F.col, ("s", "g", "sol", "a"))).alias("r"))
    assert [r["r"] for r in df.collect()] == [None, "unsuccessful", "trr_branch", "diverse_solution", "no_cycle_voc_annotations"]
    e = spark.createDataFrame([("id", "t", 1, r) for r in ("r_plus", "r_zero", "r_minus")] + [("id", "t", 2, "r_plus")], "domain string, task string, trr_group int, role string")
    assert cohorts.complete_groups(e).count() == 3
    rules = spark.createDataFrame([("b1", None, None), (None, "sa", "t2")], "baseline string, metric string, task string")
    cells = spark.createDataFrame([(b, m, t) for b in ("b1", "b2") for m in ("sa", "vs") for t in ("t1", "t2")], "baseline string, metric string, task string")
    assert cohorts.policy_filter(cells, rules).count() == 3


def test_candidates_of_other_tasks(spark):
    tasks = spark.createDataFrame([("t0", "x", 0), ("t1", "y", 1), ("t2", "x", 2)], "task string, instruction string, ord int")
    got = {(r["task"], r["candidate"]) for r in queries.other_task_candidates(tasks).collect()}
    assert got == {("t0", "correct"), ("t1", "correct"), ("t2", "correct"), ("t0", "task-t1"), ("t1", "task-t0"), ("t2", "task-t1")}


def test_pair_plan(spark):
    e = spark.createDataFrame([("t", "e", 101)], "task string, episode string, num_frames int")
    c = spark.createDataFrame([("t", k) for k in ("correct", "c1", "c2")], "task string, candidate string")
    got = queries.pair_plan(e, c, "tga_hard")
    assert got.count() == 9 and {(r["anchor_a"], r["anchor_b"]) for r in got.collect()} == {(0, 98), (1, 99), (2, 100)}


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.counterfactual_id(F.lit("counterfactual_1"))) == "counterfactual-001"
    assert one(tx.counterfactual_id(F.lit("Counterfactual-1234"))) == "counterfactual-1234"
    assert one(tx.canonical_metric(F.lit(" TGA-Easy "))) == "tga_easy" and one(tx.canonical_metric(F.lit("CSPC"))) == "csvc"
    assert one(tx.subtask_text(F.lit("Subtask: Pick up the cup. No."))) == "Pick up the cup."
    assert one(tx.percent_score(F.lit("<score>+12.5%</score>"))) == 0.125 and one(tx.percent_score(F.lit("<score>200%</score>"))) is None
    assert one(tx.scale_answer(F.lit("so ANSWER: 5"))) == 1.0 and one(tx.scale_answer(F.lit("none"))) is None
    assert one(tx.comma_list(F.lit("a, b,,a"))) == ["a", "b"] and one(tx.html_escape(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(tx.numbered_choices(F.array(F.lit("x"), F.lit("y")))) == "1. x\n2. y"


def test_wins_with_ties_and_outliers(spark):
    import random

    draw = random.Random(2)
    cells = {"ties": [(draw.choice([0.5, 0.5, 0.7]), draw.random() < 0.4) for _ in range(900)], "wide": [(draw.lognormvariate(0, 12), draw.random() < 0.5) for _ in range(700)], "two": [(1.0, True), (1.0, False)], "lost": [(1.0, False)]}
    rows = spark.createDataFrame([(k, v, w) for k, own in cells.items() for v, w in own], "k string, v double, w boolean")
    got = {r["k"]: r for r in statistics.pairwise_wins(rows, ["k"], "v", "w").collect()}
    for k, own in cells.items():
        up, down = [v for v, w in own if w], [v for v, w in own if not w]
        wins = sum(a > b for a in up for b in down)
        assert (got[k]["wins"], got[k]["n_winners"], got[k]["n_losers"]) == (wins, len(up), len(down)) and got[k]["score"] == (wins / (len(up) * len(down)) if up and down else None)


def test_resampled_medians(spark):
    """Many blocks and rows of draws, values that repeat, groups that some places lack, keys of few places."""
    n, times = 70_000, 3
    rows = spark.range(n).select(F.lit("t").alias("task"), F.format_string("s%06d", "id").alias("solution"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("semantic"), F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 7919 % 10_007) / 1e4).alias("value"))
    rows = rows.where("semantic = 0 OR substring(solution, 7, 1) < '5'").withColumn("value", F.when(F.col("semantic") == 1, -F.col("value")).otherwise(F.col("value")))
    few = spark.createDataFrame([("u", "a", 0, 1.0), ("u", "b", 0, 2.0), ("u", "c", None, None), ("u", "d", 5, -1.0)], "task string, solution string, semantic long, value double")
    rows = rows.unionByName(few)
    cell = ["task", "replicate", "semantic"]
    want = statistics.resamples(rows, ["task"], "solution", times).where("semantic IS NOT NULL").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("c"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    got = {tuple(r[c] for c in cell): r for r in statistics.resampled_medians(rows, "task", "solution", "semantic", "value", times).collect()}
    want = {tuple(r[c] for c in cell): r for r in want.collect()}
    assert got.keys() == want.keys() and len(got) > 2 * times
    for k, r in want.items():
        assert got[k]["n"] == r["n"] and (got[k]["c"], got[k]["s"], got[k]["ss"]) == pytest.approx((r["c"], r["s"], r["ss"]), rel=1e-9)
