import json

import pytest
from pyspark.sql import functions as F

from trajscope import cli
from trajscope.operators import charts
from trajscope.sources import lerobot


def test_charts(spark):
    df = spark.createDataFrame([("a<b", [0.0, 1.0, 0.5]), ("c", [2.0])], "episode string, values array<double>")
    svg = {r["episode"]: r["svg"] for r in charts.charts(df).collect()}
    assert "a&lt;b" in svg["a<b"] and 'points="12.0,148.0 240.0,12.0 468.0,80.0"' in svg["a<b"] and 'points="12.0,80.0"' in svg["c"]
    target = spark.range(5).select(charts.cycle_target(F.col("id"), F.lit(5)).alias("x"))
    assert [r["x"] for r in target.collect()] == [0, 0.5, 1, 0.5, 0]


def test_points_round_as_the_sql(spark):
    # 148 - 0.61875 * 136 is the double below 63.85: ten times it is 638.5 again
    df = spark.createDataFrame([([0.0, 0.61875, 0.68125, 1.0],)], "v array<double>").select(charts.polyline(F.col("v")).alias("p"))
    assert df.first()["p"] == "12.0,148.0 164.0,63.9 316.0,55.4 468.0,12.0"


def test_lerobot(spark, tmp_path):
    root, labels = str(tmp_path / "in"), spark.createDataFrame([("old", "pick up the cup")], "old string, new string")
    spark.createDataFrame([(0, "old"), (1, "other")], "task_index int, task string").write.parquet(f"{root}/tasks.parquet")
    episodes = spark.createDataFrame([(3, ["old"], 1, 2, 0.26, 7), (1, ["old"], 0, 1, 1.5, 8)], "episode_index int, tasks array<string>, chunk_index int, file_index int, from_timestamp double, extra int")
    episodes.write.parquet(f"{root}/episodes")
    lerobot.overlay(spark, root, str(tmp_path / "out"), labels)
    assert {r["task"] for r in spark.read.parquet(str(tmp_path / "out/tasks.parquet")).collect()} == {"pick up the cup", "other"}
    out = spark.read.parquet(str(tmp_path / "out/episodes"))
    assert out.columns == episodes.columns and {r["tasks"][0] for r in out.collect()} == {"pick up the cup"}
    clip = lerobot.reference_clips(out, spark.createDataFrame([("pick up the cup",)], "instruction string"), 10.0).first()
    assert (clip["path"], clip["start"]) == ("chunk-000/file-001.mp4", 15)


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "sa" in capsys.readouterr().out.split()
    queries, results = tmp_path / "q.jsonl", tmp_path / "r.jsonl"
    state = {"task_id": "t", "episode_id": "e", "anchor_frame": 1}
    queries.write_text("".join(json.dumps({"query_id": k, "op": "value", "state": state, "instruction": "go"}) + "\n" for k in "ab"))
    results.write_text(json.dumps({"query_id": "a", "op": "value", "score": 1.0}) + "\n")
    assert cli.main(["coverage", str(queries), str(results)], spark) == 1
    assert capsys.readouterr().out.split("\n")[:2] == ["missing: 1", "ok: 1"]
    (tmp_path / "t/episodes/e").mkdir(parents=True)
    (tmp_path / "t/metadata.json").write_text("{}")
    assert cli.main(["validate", str(tmp_path)], spark) == 1
