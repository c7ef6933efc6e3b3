import json

import pytest

from trajscope.sources import dataset, wire
from trajscope.streaming.replay import merge_stream


def _build(root, **changes):
    task = {"task_id": "task_001", "instruction": "do it", "supports": {"metrics": ["VOC", "FPL"]}, "subtasks": [{"id": "a", "description": "x"}]}
    (root / "task_001/episodes/ep1").mkdir(parents=True)
    (root / "task_001/metadata.json").write_text(json.dumps(task | changes.get("task", {})))
    episode = {"episode_id": "ep1", "world_type": "real", "domain": "id", "success": False, "fps": 10, "num_frames": 100, "assets": {"videos": {"front": "a.mp4"}}}
    (root / "task_001/episodes/ep1/metadata.json").write_text(json.dumps(episode | changes.get("episode", {})))
    annotation = {"voc": [{"frame_index": 50}, {"frame_index": 0}], "fpl": {"failure_start": 40, "failure_end": 50}}
    (root / "task_001/episodes/ep1/annotation.json").write_text(json.dumps(annotation | changes.get("annotation", {})))
    return str(root)


def test_load(spark, tmp_path):
    d = dataset.load(spark, _build(tmp_path))
    e = d.episodes.first()
    assert d.tasks.first()["metrics"] == ["VOC", "FPL"]
    assert (e["task_id"], e["episode_id"], e["voc"], e["failure_start"]) == ("task_001", "ep1", [0, 50], 40)


@pytest.mark.parametrize(
    "changes,rule",
    [
        ({"task": {"odd": 1}}, "unknown_key"), ({"task": {"task_id": "other"}}, "task_id"), ({"episode": {"domain": "mars"}}, "domain"), ({"episode": {"fps": 0}}, "fps"), ({"episode": {"trr": {"group_id": "g", "role": "r_plus"}}}, "trr"),
        ({"annotation": {"voc": [{"frame_index": 100}]}}, "voc"), ({"annotation": {"fpl": {"failure_start": 50, "failure_end": 50}}}, "fpl"), ({"annotation": {"subtask_segments": [{"id": "a", "subtask_frame": 1, "start_frame": 1, "end_frame_exclusive": 2}]}}, "subtask_segments"),
    ],
)
def test_violations(spark, tmp_path, changes, rule):
    root = _build(tmp_path, **changes)
    assert [r["rule"] for r in dataset.load(spark, root, on_violation="report").violations.collect()] == [rule]
    with pytest.raises(ValueError, match=rule):
        dataset.load(spark, root)


def test_scope_of_checks(spark, tmp_path):
    root = _build(tmp_path, annotation={"fpl": {"failure_start": 50, "failure_end": 50}})
    assert dataset.load(spark, root, ["voc"]).episodes.count() == 1


def test_remap_labels(spark):
    df = spark.createDataFrame([(["a", "b"],)], "tasks array<string>")
    assert dataset.remap_labels(df, "tasks", spark.createDataFrame([("a", "A")], "old string, new string")).first()["tasks"] == ["A", "b"]


def _file(tmp_path, rows):
    path = tmp_path / "rows.jsonl"
    wire.write_single_jsonl(rows, str(path))
    return str(path)


STATE = {"task_id": "t", "episode_id": "e", "anchor_frame": 1}


def test_queries(spark, tmp_path):
    good = [{"query_id": "a", "op": "value", "state": STATE, "instruction": "go"}, {"query_id": "b", "op": "compare", "state_a": STATE, "state_b": STATE, "instruction": "go"}]
    assert {r["query_id"]: r["playback"] for r in wire.read_queries(spark, _file(tmp_path, good)).collect()} == {"a": "forward", "b": None}
    for bad in ([good[0], good[0]], [good[0] | {"odd": 1}], [good[0] | {"op": "compare"}], [], [good[1] | {"state_b": STATE | {"task_id": "u"}}]):
        with pytest.raises(ValueError):
            wire.read_queries(spark, _file(tmp_path, bad))


def test_results(spark, tmp_path):
    good = [{"query_id": "a", "op": "value", "score": 0.5}, {"query_id": "b", "op": "subtask", "output": "x"}]
    assert wire.read_results(spark, _file(tmp_path, good)).count() == 2
    for bad in ([good[0], good[0]], [{"query_id": "a", "op": "value", "output": "x"}], [{"query_id": "b", "op": "subtask", "output": " "}], [{"query_id": "a", "op": "odd", "score": 1.0}]):
        with pytest.raises(ValueError):
            wire.read_results(spark, _file(tmp_path, bad))


def test_stream_merges_once(spark, tmp_path):
    schema = "query_id string, domain string, task string, score double"
    source, store, cells = str(tmp_path / "in"), str(tmp_path / "store"), []
    for rows in ([("a", "id", "t", 1.0), ("a", "id", "t", 1.0)], [("a", "id", "t", 9.0), ("b", "env", "t", 2.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        merge_stream(spark, source, schema, store, str(tmp_path / "checkpoint"), lambda df, n: cells.append((n, df.count())), "keep").awaitTermination(60)
    got = {(r["query_id"], r["score"]) for r in spark.read.parquet(store).collect()}
    assert got == {("a", 1.0), ("b", 2.0)} and [c for _, c in cells] == [1, 1]


def test_stream_refuses_conflicts(spark, tmp_path):
    schema = "query_id string, domain string, task string, score double"
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    start = lambda: merge_stream(spark, source, schema, store, str(tmp_path / "checkpoint")).awaitTermination(60)
    spark.createDataFrame([("a", "id", "t", 1.0), ("a", "id", "t", 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    start()
    spark.createDataFrame([("a", "id", "t", 9.0)], schema).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="different rows"):
        start()
    assert spark.read.parquet(store).count() == 1
