"""Operators that hold no cell, episode or file in one task, against plain Python and on skewed input."""

import json
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscope.functions import frames as fr
from trajscope.functions import sequences as sq
from trajscope.operators import intervals, judging, layout, lineage, metrics, prefix, selection, statistics
from trajscope.sources import wire
from trajscope.streaming import rescore

# --- order statistics ---------------------------------------------------------

WANTED = {"median": ("linear", 0.5), "low": ("linear", 0.025), "top": ("linear", 1.0), "rank": ("nearest", 0.9), "first": ("nearest", 0.0)}


def plain_quantile(values, method, q):
    values = sorted(values)
    if method == "nearest":
        return values[max(0, math.ceil(q * len(values)) - 1)]
    at = q * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@pytest.mark.parametrize("accuracy", [selection.ACCURACY, 100])
def test_quantiles(spark, monkeypatch, accuracy):
    """Cells of one value, of two, of ties and of outliers; a null cell key; with a coarse sketch the brackets are narrow parts of a cell."""
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "MARGIN", 5 / accuracy)
    draw = random.Random(3)
    cells = {"one": [2.5], "two": [1.0, -4.0], "ties": [7.0] * 3000 + [1.0, 9.0], "wide": [draw.lognormvariate(0, 9) for _ in range(20_000)], None: [float(k % 97) for k in range(15_000)], "minus": [-draw.random() for _ in range(301)]}
    rows = spark.createDataFrame([(k, v) for k, own in cells.items() for v in own] + [("empty", None), ("one", None)], "k string, v double")
    got = {r["k"]: r for r in selection.quantiles(rows, ["k"], "v", WANTED).collect()}
    assert got.keys() == cells.keys()
    for k, own in cells.items():
        for name, how in WANTED.items():
            assert got[k][name] == pytest.approx(plain_quantile(own, *how), rel=1e-12, abs=1e-12), (k, name)


def test_quantiles_hold_no_cell(spark):
    """A cell of 400,000 rows: what is ordered is a thousandth of it and a row for what lies below."""
    rows = spark.range(400_000).select(F.lit("c").alias("k"), (F.col("id") * 7919 % 400_009).cast("double").alias("v"))
    found = selection.quantiles(rows, ["k"], "v", {"median": ("linear", 0.5)})
    values = np.sort(np.arange(400_000) * 7919 % 400_009)
    assert found.first()["median"] == (values[199_999] + values[200_000]) / 2
    sizes = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in sizes and "percentile(" not in sizes


# --- folds --------------------------------------------------------------------


def plain_direction(v, w):
    pairs = [(w[i] * w[j] * (v[j] - v[i]), w[i] * w[j] * abs(v[j] - v[i])) for i in range(len(v)) for j in range(i + 1, len(v))]
    up, all_ = math.fsum(p[0] for p in pairs), math.fsum(p[1] for p in pairs)
    return up / all_ if all_ else 0.0


def test_direction(spark):
    draw = random.Random(5)
    cases = [([0.0, 2.0, 1.0], [1.0, 2.0, 3.0]), ([0.3] * 9, [0.1 * k for k in range(9)]), ([5.0], [1.0]), ([1.0, 2.0, 1.0], [1.0, 1.0, 1.0]), ([0.1, 0.7, 0.7, 0.1], [0.3] * 4)]
    cases += [([draw.choice([0.1, 0.2, draw.random()]) for _ in range(n)], [draw.random() for _ in range(n)]) for n in (2, 7, 60)]
    rows = spark.createDataFrame([(k, v, w) for k, (v, w) in enumerate(cases)], "k int, v array<double>, w array<double>")
    got = {r["k"]: r["d"] for r in rows.select("k", sq.direction(F.col("v"), F.col("w")).alias("d")).collect()}
    for k, case in enumerate(cases):
        assert got[k] == pytest.approx(plain_direction(*case), abs=1e-9), case
    assert got[1] == 0 and got[3] == 0 and got[4] == 0


def test_direction_of_long_stages(spark):
    """Ten thousand frames in a stage; the time follows the frames, not their pairs."""
    import time

    def seconds(n):
        rows = spark.range(8).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(i * 0.37 + F.col("id"))).alias("v")).withColumn("w", F.transform("v", lambda x: F.lit(1.0)))
        began = time.perf_counter()
        assert rows.select(sq.direction(F.col("v"), F.col("w")).alias("d")).agg(F.count("d")).first()[0] == 8
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 6 * max(seconds(10_000), 0.3)


def test_rank_correlation(spark):
    draw = random.Random(9)
    curves = [[draw.choice([0.0, -0.0, 1.0, draw.random()]) for _ in range(n)] for n in (2, 3, 10, 50)] + [[1.0, 1.0, 1.0], [4.0], []]
    flat = spark.createDataFrame([(k, i, v) for k, c in enumerate(curves) for i, v in enumerate(c)], "k int, i int, v double")
    want = {r["k"]: r["rho"] for r in statistics.spearman(flat, ["k"], "v", "i").collect()}
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(curves)], "k int, c array<double>")
    got = {r["k"]: r["rho"] for r in rows.select("k", sq.rank_correlation(F.col("c")).alias("rho")).collect()}
    for k in want:
        assert got[k] is None if want[k] is None else got[k] == pytest.approx(want[k], abs=1e-12)
    assert got[4] is None and got[6] is None
    assert metrics.curve_correlations(rows, s=F.col("c")).where("k = 4").first()["s"] == 0


def test_on_grid(spark):
    for fps, hz in ((10.0, 5.0), (12.0, 5.0), (25.0, 5.0), (30.0, 10.0), (7.0, 5.0), (4.0, 5.0)):
        rows = spark.range(200).select(F.col("id").cast("int").alias("f"), F.lit(190).alias("n"))
        for make, end in ((fr.grid(F.col("n"), F.lit(fps), hz), False), (fr.grid_with_end(F.col("n"), F.lit(fps), hz), True)):
            odd = rows.where((F.col("f") < F.col("n")) & (F.array_contains(make, F.col("f")) != fr.on_grid(F.col("f"), F.col("n"), F.lit(fps), hz, end)))
            assert odd.count() == 0, (fps, hz, end)


# --- intervals ----------------------------------------------------------------


def test_points_in_spans(spark):
    draw = random.Random(1)
    spans = [(draw.choice("ab"), draw.randrange(0, 900), draw.randrange(1, 400), k) for k in range(60)]
    spans = [(key, s, s + n, k) for key, s, n, k in spans] + [("a", 0, 100_000, 98), ("a", 5, 5, 99), ("c", 0, 9, 97)]
    points = [(draw.choice("abd"), draw.randrange(-5, 1300)) for _ in range(500)]
    got = intervals.points_in_spans(spark.createDataFrame(points, "key string, frame int"), spark.createDataFrame(spans, "key string, start int, end int, id int"), ["key"])
    want = sorted((k, f, i) for k, f in points for key, s, e, i in spans if k == key and s <= f < e)
    assert sorted((r["key"], r["frame"], r["id"]) for r in got.collect()) == want


def test_long_episode_makes_no_product(spark):
    """A million frames and ten thousand spans of one episode: each frame meets the few spans of its bin."""
    points = spark.range(1_000_000).select(F.lit("e").alias("key"), F.col("id").cast("int").alias("frame"))
    spans = spark.range(10_000).select(F.lit("e").alias("key"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 100).alias("end"), F.col("id").alias("n"))
    assert intervals.points_in_spans(points, spans, ["key"]).where("n = frame div 100").count() == 1_000_000


# --- layout -------------------------------------------------------------------


def test_balanced_partitions(spark):
    """One episode has a third of all rows, and cost rises with the prefix."""
    sizes = [3000, *[50] * 60, *[7] * 300]
    rows = spark.createDataFrame([(f"e{k}", f) for k, n in enumerate(sizes) for f in range(n)], "episode string, anchor int")
    got = layout.balanced(rows, ["episode"], "anchor", F.col("anchor") + 1, 8).withColumn("at", F.spark_partition_id())
    loads = [r["s"] for r in got.groupBy("at", "partition").agg(F.sum(F.col("anchor") + 1).alias("s")).collect()]
    assert len(loads) == 8 and max(loads) <= 1.2 * sum(loads) / 8 and got.count() == sum(sizes)
    assert got.groupBy("episode").agg(F.count_distinct("partition").alias("n")).where("episode <> 'e0' AND n > 2").count() == 0
    assert layout.balanced(rows.limit(0), ["episode"], "anchor", F.lit(1), 4).count() == 0


def test_packed_batches(spark):
    rows = [(f"q{k}", (1, 8, 30, 70)[k % 4], ("go", "stop")[k % 3 == 0]) for k in range(400)]
    got = layout.packed(spark.createDataFrame(rows, "query_id string, n_frames int, instruction string"), ["instruction"], "n_frames", ["query_id"])
    batches = got.groupBy("instruction", "n_frames", "batch").agg(F.sum("n_frames").alias("frames"), F.count(F.lit(1)).alias("n")).collect()
    assert got.count() == 400 and all(b["frames"] <= 64 or b["n"] == 1 for b in batches)


# --- prefix means -------------------------------------------------------------


def test_prefix_means(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # timelines go on in the next batch
    frames = {("t", "a"): [float(k * k % 11) for k in range(40)], ("t", "b"): [1.0, 2.0], ("u", "a"): [3.0] * 5}
    features = spark.createDataFrame([(*key, f, x) for key, own in frames.items() for f, x in enumerate(own)], "task string, episode string, frame int, x double")
    states = [(*key, f, p) for key, own in frames.items() for f in range(0, len(own)) for p in ("forward", "reverse", "cycle") if (f + len(p)) % 3]
    got = {tuple(r)[:4]: r["score"] for r in prefix.prefix_means(spark.createDataFrame(states * 2, "task string, episode string, anchor int, playback string"), features).select("task", "episode", "anchor", "playback", "score").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == set(states)
    for task, episode, anchor, playback in states:
        own = frames[task, episode]
        line = own[: anchor + 1] if playback == "forward" else own[anchor:][::-1] if playback == "reverse" else own + own[anchor:-1][::-1]
        assert got[task, episode, anchor, playback] == pytest.approx(sum(line) / len(line)), (task, episode, anchor, playback)
    with pytest.raises(Exception, match="no frame for"):
        prefix.prefix_means(spark.createDataFrame([("t", "b", 2, "forward")], "task string, episode string, anchor int, playback string"), features).collect()


# --- judging ------------------------------------------------------------------


def test_judging_asks_once(spark, tmp_path):
    """A judge that fails at random is asked once for each request, and not at all after a restart."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def ask(request):
        import os
        import random as r
        import uuid

        if r.random() < 0.3:
            raise ConnectionError("busy")
        open(os.path.join(calls, uuid.uuid4().hex), "w").write(request)
        return request.upper()

    requests = spark.createDataFrame([(k, f"r{k % 40}") for k in range(100)], "k int, request string")
    cache = str(tmp_path / "cache")
    how = {"workers": 3, "attempts": 20, "delay": 0.001, "chunk": 10, "tasks": 2}
    got = judging.answers(spark, requests.where("k < 60"), ask, cache, **how).collect()
    assert len(got) == 60 and all(r["answer"] == r["request"].upper() for r in got)
    assert judging.answers(spark, requests, ask, cache, **how).where("answer = upper(request)").count() == 100
    said = sorted(p.read_text() for p in calls.iterdir())
    assert said == sorted({f"r{k}" for k in range(40)})


def test_judging_keeps_what_it_has(spark, tmp_path):
    def ask(request):
        if request == "bad":
            raise judging.Refused("no")
        return "yes"

    requests = spark.createDataFrame([("a",), ("bad",), ("b",)], "request string")
    with pytest.raises(RuntimeError, match="refused: no"):
        judging.answers(spark, requests, ask, str(tmp_path), attempts=2, delay=0.001)
    kept = judging.answers(spark, requests.where("request <> 'bad'"), lambda _: 1 / 0, str(tmp_path), attempts=1)
    assert {r["answer"] for r in kept.collect()} == {"yes"}
    assert judging.answers(spark, requests.limit(0), lambda _: 1 / 0, str(tmp_path / "none")).count() == 0


def test_calls_in_flight_are_bounded():
    now, most, lock = [0], [0], threading.Lock()

    def ask(_):
        import time

        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002)
        with lock:
            now[0] -= 1
        return "x"

    import pandas as pd

    frame = pd.DataFrame({"digest": [str(k) for k in range(100)], "request": "r"})
    out = list(judging._in_flight(ask, 4, 1, 0.0)(iter([frame])))
    assert most[0] <= 4 and len(out[0]) == 100 and set(out[0]["answer"]) == {"x"}


# --- streams ------------------------------------------------------------------

ROWS = "query_id string, domain string, task string, episode string, score double"


def test_stream_scores(spark, tmp_path):
    """After every batch the scores are those of all rows so far; replays and late rows count once."""
    rows = [(f"q{k}", ("id", "env")[k % 2], f"t{k % 3}", f"e{k % 7}", k / 10) for k in range(120)]
    state = rescore.CellScores(spark, str(tmp_path / "state"))
    paths = {n: str(tmp_path / n) for n in ("source", "store", "check")}

    def go():
        rescore.score_stream(spark, paths["source"], ROWS, paths["store"], paths["check"], str(tmp_path / "state")).awaitTermination()

    for k in range(4):
        part = rows[k * 30 : k * 30 + 30] + (rows[:5] if k else [])  # late copies of rows that are there
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(paths["source"])
        go()
        flat = spark.createDataFrame(rows[: k * 30 + 30], ROWS).groupBy("domain", "task", "episode").agg(F.avg("score").alias("score"))
        want = {(r["level"], r["domain"], r["task"]): r["score"] for r in statistics.macro_mean(flat).collect()}
        got = {(r["level"], r["domain"], r["task"]): r["score"] for r in state.macro().collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    before = state.log.snapshot()
    assert state.add(spark.createDataFrame(rows[:3], ROWS), before.properties["batch"]).count() == 3 and state.log.snapshot() == before
    spark.createDataFrame([("q1", "id", "t1", "e1", 99.0)], ROWS).write.mode("append").parquet(paths["source"])
    with pytest.raises(Exception, match="different rows"):
        go()
    assert state.log.snapshot() == before


# --- stages and lines ---------------------------------------------------------


def test_stage_differences(spark):
    base = [(0, "plan", f"q{k}", "x", None) for k in range(5)] + [(1, "records", f"q{k}", "", k / 3) for k in range(5)]
    saved = spark.createDataFrame(base + [(1, "records", "gone", "", 1.0), (1, "records", "q0", "", 0.0)], lineage.ROWS)
    new = [(p, s, k, "y" if (p, k) == (0, "q3") else d, v if v is None else v + (1e-12 if k != "q2" else 0.1)) for p, s, k, d, v in base] + [(1, "records", "new", "", None)]
    found = lineage.differences(saved, spark.createDataFrame(new, lineage.ROWS))
    assert {(r["stage"], r["key"], r["difference"]) for r in found.collect()} == {("plan", "q3", "changed"), ("records", "q2", "changed"), ("records", "gone", "missing"), ("records", "new", "extra"), ("records", "q0", "repeated")}
    assert lineage.summary(found).first()["stage"] == "plan"


def test_errors_name_their_line(spark, tmp_path):
    """Files of several splits: the line is counted over the splits before its own."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    lines = [json.dumps({"query_id": f"q{k}", "op": "value", "score": k / 7}) for k in range(900)]
    for name, bad in (("a", 0), ("b", 1), ("c", 777), ("d", 899)):
        own = list(lines)
        own[bad] = '{"query_id": "x", "op": "value", "score": "NaN"}'
        own.insert(5, "   ")
        (tmp_path / f"{name}.jsonl").write_text("\n".join(own) + "\n")
        with pytest.raises(ValueError, match=rf"{name}\.jsonl:{bad + 1 + (bad >= 5)}: invalid row"):
            wire.read_results(spark, str(tmp_path / f"{name}.jsonl"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_expanded_compares(spark):
    """Hops that queries share are asked once; a missing score is an error; identical states are not asked."""
    from trajscope.plans import expanded

    values = spark.createDataFrame([("a", "t", "e", 9, "go", "forward", 12, 10.0), ("b", "t", "e", 5, "go", "forward", 12, 10.0), ("c", "t", "e", 0, "go", "forward", 12, 10.0), ("d", "t", "e", 9, "go", "reverse", 12, 10.0)], "query_id string, task string, episode string, anchor int, instruction string, playback string, num_frames int, fps double")
    goals = spark.createDataFrame([("t", "e", 9)], "task string, goal_episode string, goal_frame int")
    parts = expanded.three_way(values, goals, 5.0)
    rows = {(r["query_id"], r["part"], r["place"]): (r["frame_a"], r["frame_b"]) for r in parts.collect()}
    assert [rows["a", "hop", k] for k in range(5)] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 9)] and rows["a", "forward", 0] == (0, 9) and rows["a", "backward", 0] == (9, 9)
    assert [rows["d", "hop", k] for k in range(1)] == [(11, 9)] and ("c", "hop", 0) not in rows
    asked = expanded.asked(parts)
    assert asked.count() == len({v for k, v in rows.items() if v[0] != v[1]})
    scores = asked.withColumn("score", (F.col("frame_b") - F.col("frame_a")) / F.lit(20.0))
    got = {r["query_id"]: r["score"] for r in expanded.three_way_values(expanded.answered(parts, scores)).collect()}
    fold = 0.1
    for d in (0.1, 0.1, 0.1, 0.05):
        fold += (1 - fold) * d
    assert got["a"] == pytest.approx((0.45 + 1 + fold) / 3) and got["c"] == pytest.approx((0 + (1 - 0.45) + 0) / 3)
    with pytest.raises(Exception, match="no score for"):
        expanded.answered(parts, scores.limit(2)).collect()
    steps = expanded.critic_steps(values)
    critic = expanded.critic_values(expanded.answered(steps, expanded.asked(steps).withColumn("score", F.lit(0.5))))
    assert {r["query_id"]: r["score"] for r in critic.collect()}["d"] == 0.5
