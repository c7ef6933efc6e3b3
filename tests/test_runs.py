"""Configurations, runs with restarts, inspection, batches, publication and small files."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajscope import cli
from trajscope.functions import naming
from trajscope.operators import board, charts, judging
from trajscope.plans import audits, identify
from trajscope.runs import batch, config, execute, publish, registry
from trajscope.sources import commits, contents, dataset, documents, storage, wire

ROW = {"model": "echo", "data": "d", "output": "o", "metrics": {"sa": {"mode": "base", "domains": ["id"]}}, "tasks": ["t1"]}


def test_config(tmp_path):
    path = tmp_path / "run.yaml"
    path.write_text(json.dumps(ROW | {"metric_tasks": {"sa": ["t1"]}, "model_options": {"scale": 10}}))
    c = config.load(str(path))
    assert c.data == str(tmp_path / "d") and c.metrics == {"sa": ("base", ("id",))} and c.tasks_of("sa") == ["t1"]
    for change in (
        {"odd": 1}, {"model": "nobody"}, {"metrics": {}}, {"metrics": {"x": {}}}, {"metrics": {"sa": {"mode": "base"}}}, {"metrics": {"sa": {"mode": "odd", "domains": ["id"]}}}, {"metrics": {"csvc": {"mode": "base", "domains": ["env"]}}},
        {"tasks": ["a", "a"]}, {"metric_tasks": {"vs": ["t1"]}}, {"batch_size": 0}, {"model_options": {"other": 1}}, {"data": " "},
    ):
        with pytest.raises(config.ConfigError):
            config.parse(ROW | change)
    with pytest.raises(config.ConfigError, match="missing"):
        config.parse({k: v for k, v in ROW.items() if k != "tasks"})


def test_registry():
    with pytest.raises(ValueError, match="already"):
        registry.register(registry.METRICS["sa"])
    with pytest.raises(ValueError, match="unknown"):
        registry.open_predictor("echo", {"x": 1})

    class Native(registry.Predictor):
        def native_sa(self, rows):
            return [0.0] * len(rows)

    assert registry.check_mode("sa", "native", Native) == "native_sa" and registry.check_mode("vs", "base", Native) is None
    for metric in ("vs", "tga_easy"):
        with pytest.raises(ValueError, match="native"):
            registry.check_mode(metric, "native", Native)


METRICS = ["SA", "VOC", "CYCLE-VOC", "FPL", "TRR", "TGA", "CSPC", "SIA"]


def _dataset(root):
    """A task with successes, failures, a complete recovery group and two kinds of solution, and one with memory annotations."""
    stages = {"r_plus": ("failure", "recovery", "recovery_success"), "r_zero": ("failure", "recovery", "recovery_failed"), "r_minus": ("failure", "continue")}
    task = {"task_id": "t1", "instruction": "do it", "supports": {"metrics": METRICS}, "subtasks": [{"id": k, "description": k} for k in ("001", "002")], "tga": {"counterfactual_instructions": [{"id": "counterfactual_1", "description": "no"}]}}
    for name, own in (("t1", METRICS), ("t2", ["VOC-MEM", "TGA"])):
        (root / name).mkdir(parents=True)
        (root / name / "metadata.json").write_text(json.dumps(task | {"task_id": name, "instruction": f"do {name}", "supports": {"metrics": own}}))
    made = [("good1", True, None, "normal"), ("good2", True, None, "normal"), ("other", True, None, "diverse"), ("bad", False, None, None), ("p", True, "r_plus", None), ("z", False, "r_zero", None), ("m", False, "r_minus", None)]
    for (name, success, role, solution), task in [*((m, "t1") for m in made), (made[0], "t2")]:
        folder = root / task / "episodes" / name
        folder.mkdir(parents=True)
        meta = {"episode_id": name, "world_type": "sim", "domain": "id", "success": success, "fps": 10, "num_frames": 40, "assets": {"videos": {"front": "a.mp4"}}}
        meta |= {"trr": {"group_id": "g", "role": role}} if role else {}
        meta |= {"cspc": {"solution_type": solution}} if solution else {}
        (folder / "metadata.json").write_text(json.dumps(meta))
        notes = {"voc": [{"frame_index": f} for f in range(0, 40, 2)], "voc_mem": [{"frame_index": f} for f in (0, 10, 30)] if success else [], "subtask_segments": [{"id": "001", "start_frame": 0, "end_frame_exclusive": 20}, {"id": "002", "start_frame": 20, "end_frame_exclusive": 40}]}
        if not success:
            notes["fpl"] = {"failure_start": 20, "failure_end": 30}
        if role:
            third = 40 // len(stages[role])
            notes["trr"] = {s: {"start_frame": k * third, "end_frame_exclusive": (k + 1) * third} for k, s in enumerate(stages[role])}
        (folder / "annotation.json").write_text(json.dumps(notes))
    return str(root)


ALL = ["sa", "voc", "voc_mem", "cycle_voc", "vs", "fpl", "trr", "tga_hard", "csvc", "sia"]


def _config(data, output, metrics, **more):
    return config.parse(ROW | {"data": data, "output": output, "tasks": ["t1", "t2"], "metrics": {m: {"mode": "base", "domains": ["id"]} for m in metrics}, "model_options": {"scale": 40}, "batch_size": 7} | more)


def _judged(spark, root):
    return registry.METRICS["sia"].plan(dataset.load(spark, root), ["t1"], ["id"]).select("query_id", F.lit(-0.5).alias("logprob"))


def test_run_and_records(spark, tmp_path):
    root, out = _dataset(tmp_path / "data"), f"file://{tmp_path}/out"
    c = _config(root, out, ALL)
    with pytest.raises(ValueError, match="judgements"):
        execute.run(spark, c)
    got = execute.run(spark, c, _judged(spark, root))
    # the value is the share of the anchor: it rises, in order, and falls on the way back only as the anchors do
    assert got["voc"]["overall"] == pytest.approx(1) and got["voc_mem"]["domains"]["id"]["tasks"] == {"t2": pytest.approx(1)} and got["cycle_voc"]["overall"] == pytest.approx(1)
    assert got["sa"]["overall"] == 0 and got["sia"]["overall"] == pytest.approx(2.718281828**-0.5, abs=1e-6) and got["tga_hard"]["overall"] == 0
    assert got["trr"]["overall"] == 0 and got["fpl"]["overall"] == pytest.approx(20 / 39) and got["csvc"]["domains"]["id"]["tasks"]["t1"] == pytest.approx(1)
    assert 0.8 < got["vs"]["overall"] <= 1
    # what stands beside the means
    assert got["sa"]["gap"] == pytest.approx(0) and got["sa"]["terminal_values"]["range"] == pytest.approx(39 / 40) and got["sa"]["protocol"] == "terminal-value-tail2pct-average-sa-v5"
    assert got["tga_hard"]["pairwise_mean"] == 0.5 and list(got["tga_hard"]["counterfactual_by_type"]) == ["objects"] and got["tga_hard"]["confusion_matrix"]["id"]["t1"]["correct"] == got["tga_hard"]["confusion_matrix"]["id"]["t1"]["001"]
    assert "t2" not in got["tga_hard"]["domains"]["id"]["tasks"]  # tasks with memory annotations are left out
    assert got["cycle_voc"]["components"]["reverse"]["overall"] == pytest.approx(1) and got["vs"]["n_episodes"] == 2
    assert got["vs"]["exclusions"] == {"diverse_solution": 1, "trr_branch": 1, "unsuccessful": 3} and got["trr"]["n_groups"] == 1
    assert got["csvc"]["n_tasks"] == 1 and got["csvc"]["identifiable_tasks"] == 1 and got["csvc"]["score_ci95"] == [pytest.approx(1)] * 2
    r = {x["episode"]: x for x in execute.records_of(spark, c, "fpl").collect()}
    assert r["bad"]["onset"] == 20 and r["bad"]["pred"] is None
    assert {x["role"] for x in execute.records_of(spark, c, "trr").first()["stages"]} == {"r_plus", "r_zero", "r_minus"}
    assert execute.records_of(spark, c, "csvc").first()["coverage"] == {"001": 2, "002": 2} and execute.records_of(spark, c, "tga_hard").first()["scores"].keys() == {"001"}
    report = execute.inspect(spark, c)
    assert {m: r["state"] for m, r in report.items()} == dict.fromkeys(ALL, "valid")
    # the second run takes everything over
    before = sorted(p.name for p in (tmp_path / "out").rglob("_log/*"))
    assert execute.run(spark, c, _judged(spark, root)) == got and sorted(p.name for p in (tmp_path / "out").rglob("_log/*")) == before
    saved = json.loads((tmp_path / "out/voc/result.json").read_text())
    saved["result"]["domains"]["id"]["tasks"]["t1"] = 0.5
    (tmp_path / "out/voc/result.json").write_text(json.dumps(saved))
    row = execute.inspect(spark, _config(root, out, ["voc"]))["voc"]
    assert (row["state"], row["reason"], row["differences"]) == ("wrong", "result", [("id", "t1")])


def _rewrite(spark, log, kind, change):
    """Plant a change in what a log's folder holds."""
    path = next(p for p in log.snapshot().files if p.startswith(kind))
    rows = [r.asDict() for r in spark.read.parquet(f"{log.root}/{path}").collect()]
    spark.createDataFrame([change(r) for r in rows], spark.read.parquet(f"{log.root}/{path}").schema).write.mode("overwrite").parquet(f"{log.root}/{path}")


def test_first_stage_that_differs(spark, tmp_path):
    root, out = _dataset(tmp_path / "data"), str(tmp_path / "out")
    c = _config(root, out, ["sia", "voc"])
    execute.run(spark, c, _judged(spark, root))
    sia, voc = commits.Log(spark, f"{out}/sia"), commits.Log(spark, f"{out}/voc")
    _rewrite(spark, voc, "parts/", lambda r: r | {"score": r["score"] + (0.01 if "good1" in r["query_id"] and r["score"] < 0.1 else 0)})
    _rewrite(spark, sia, "judgements/", lambda r: r | {"logprob": -0.25 if r["query_id"].endswith("good1:002") else r["logprob"]})
    report = execute.inspect(spark, c)
    assert report["voc"]["state"] == "wrong" and report["voc"]["reason"] == "answers"
    assert report["sia"]["state"] == "wrong" and report["sia"]["reason"] == "judgements" and report["sia"]["differences"][0] == ("judgements", "changed", 1, "sia:t1:good1:002")
    _rewrite(spark, sia, "parts/", lambda r: r | {"output": r["output"] + ("!" if r["query_id"].endswith("good1:001") else "")})
    row = execute.inspect(spark, c)["sia"]
    assert row["reason"] == "answers" and [d[0] for d in row["differences"]] == ["answers", "bundle", "judgements", "records"]
    _rewrite(spark, sia, "judgements/", lambda r: r | {"query_id": r["query_id"] + "?"})
    row = execute.inspect(spark, c)["sia"]
    assert row["state"] == "wrong" and "cannot be computed" in row["reason"]


def test_stale_inputs(spark, tmp_path, monkeypatch):
    root, out, weights = _dataset(tmp_path / "data"), str(tmp_path / "out"), tmp_path / "weights"
    weights.mkdir()
    (weights / "a.bin").write_bytes(bytes(1000))
    c = _config(root, out, ["voc"], checkpoint=str(weights))
    execute.run(spark, c)
    state = lambda: (lambda r: (r["state"], r["reason"]))(execute.inspect(spark, c)["voc"])
    assert state() == ("valid", None)
    (weights / "a.bin").write_bytes(bytes(999) + b"x")
    assert state() == ("stale", "checkpoint")
    with pytest.raises(ValueError, match="checkpoint"):
        execute.run(spark, c)
    (weights / "a.bin").write_bytes(bytes(1000))
    assert state() == ("valid", None)
    note = tmp_path / "data/t1/episodes/bad/annotation.json"
    text = note.read_text()
    note.write_text(text + " ")
    assert state() == ("stale", "data")
    note.write_text(text)
    plan, score, records = registry.METRICS["voc"].plan, registry.METRICS["voc"].score, registry.METRICS["voc"].records
    monkeypatch.setitem(registry.METRICS, "voc", registry.Metric("voc", "value", plan, lambda s: score(s.withColumn("v", -F.col("v"))), records=records))
    assert state() == ("stale", "code")


def test_restart_loses_one_chunk(spark, tmp_path, monkeypatch):
    root, out = _dataset(tmp_path / "data"), str(tmp_path / "out")
    c = _config(root, out, ["sa"], chunk_rows=2)
    real, calls = execute.answered, []

    def dies(queries, *rest):
        calls.append(sorted(r["query_id"] for r in queries.collect()))
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(queries, *rest)

    monkeypatch.setattr(execute, "answered", dies)
    with pytest.raises(RuntimeError, match="killed"):
        execute.run(spark, c)
    assert execute.inspect(spark, c)["sa"]["state"] == "incomplete"
    done = {q for call in calls[:2] for q in call}
    first = dict(execute.run(spark, c))
    again = [q for call in calls[3:] for q in call]
    assert not done & set(again) and len(again) == len(set(again)) and set(calls[2]) <= set(again)
    assert execute.inspect(spark, c)["sa"]["state"] == "valid" and first["sa"]["overall"] == 0
    # a second run that writes answers at the same time is an error
    log = commits.Log(spark, f"{out}/sa")
    with pytest.raises(ValueError, match="options"):
        execute.run(spark, _config(root, out, ["sa"], model_options={"scale": 41}))
    assert execute.inspect(spark, _config(root, out, ["sa"], model_options={"scale": 41}))["sa"] | {"n_planned": 0} == {"state": "stale", "reason": "options", "n_planned": 0, "n_missing": None, "differences": []}
    assert len([p for p in log.snapshot().files if p.startswith("parts/")]) == len(calls) - 1
    stray = tmp_path / "out/sa/parts/stray"
    stray.mkdir()
    assert log.vacuum("parts") == [] and log.vacuum("parts", older_than=-1) == ["parts/stray"] and not stray.exists()


def test_status():
    row = {"sa": {"state": "valid"}}
    assert publish.status({"a": {"vs": {"state": "stale"}}, "b": row}) == {"status": "incomplete", "expected": 2, "valid": ["b"], "incomplete": [], "stale": ["a"], "wrong": []}
    assert publish.status({"b": row})["status"] == "complete"


def test_batches(spark, tmp_path):
    data = dataset.load(spark, _dataset(tmp_path))
    eligible = batch.eligibility(data, ["sa", "tga_easy", "lpd"][:2], ["t1", "t2"], ["id"])
    reasons = {(r["metric"], r["task"]): r["reason"] for r in eligible.collect()}
    assert reasons[("sa", "t1")] is None and reasons[("sa", "t2")] == "the task does not declare the metric"
    assert {(r["metric"], r["task"]): r["reason"] for r in batch.eligibility(data, ["sa"], ["t1"], ["env"]).collect()} == {("sa", "t1"): "no episode is eligible"}
    eligible = spark.createDataFrame([("sa", "t1", None), ("sa", "t2", None), ("vs", "t1", None), ("vs", "t2", "no"), ("tga_easy", "t1", None)], "metric string, task string, reason string")
    rules = spark.createDataFrame([("b", "sa", None, "b does not do sa")], "baseline string, metric string, task string, text string")
    planned = batch.cells(spark.createDataFrame([("a",), ("b",)], "baseline string"), eligible, rules)
    assert {(r["baseline"], r["metric"], r["task"]): r["reason"] for r in planned.collect()}[("b", "sa", "t2")] == "b does not do sa"
    jobs = lambda *x: sorted((r["baseline"], r["tasks"], r["metrics"]) for r in batch.jobs(planned, *x).collect())
    assert jobs() == [("a", ["t1"], ["vs"]), ("a", ["t1", "t2"], ["sa"]), ("b", ["t1"], ["vs"])]
    published = spark.createDataFrame([("a", "sa", "t1"), ("a", "vs", "t1")], "baseline string, metric string, task string")
    assert jobs(published, "missing") == [("a", ["t2"], ["sa"]), ("b", ["t1"], ["vs"])]
    assert batch.expand(["sa, vs", "sa"], ["sa", "vs"]) == ["sa", "vs"] and batch.expand(["all"], ["x"]) == ["x"]
    for bad in (lambda: batch.expand(["no"], ["sa"]), lambda: batch.jobs(planned, None, "odd")):
        with pytest.raises(ValueError):
            bad()


def _result(**tasks):
    return {"overall": None, "domains": {"id": {"mean": None, "tasks": tasks}}}


@pytest.fixture(params=["file", "viewfs"])
def place(request, spark, tmp_path):
    """A folder on the local disk, and one on a file system of another kind."""
    if request.param == "file":
        return f"file://{tmp_path}"
    conf = spark._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{tmp_path.name.replace('_', '')}.link./in", f"file://{tmp_path}")
    return f"viewfs://{tmp_path.name.replace('_', '')}/in"


def test_commits(spark, place, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT", 3)
    log, other = commits.Log(spark, f"{place}/table"), commits.Log(spark, f"{place}/table")
    assert log.snapshot() == commits.Snapshot()
    first = log.commit(log.snapshot(), add={"a": {"n": 1}}, set={"x": 1})
    with pytest.raises(commits.Conflict):
        other.commit(commits.Snapshot(), add={"b": {}})
    for k in range(7):
        other.update(lambda s, k=k: {"add": {f"f{k}": {}}, "remove": ["a"], "set": {"x": s.properties["x"] + 1}})
    assert log.snapshot().files.keys() == {f"f{k}" for k in range(7)} and log.snapshot().properties == {"x": 8} and first.version == 0
    assert any(n.endswith(".checkpoint") for n in log.storage.names(f"{place}/table/_log"))
    assert log.update(lambda s: None).version == 7 and log.update(lambda s: {"set": {"x": None}}).properties == {}
    log.storage.replace(f"{place}/t.txt", "é")
    log.storage.replace(f"{place}/t.txt", "ü")
    assert log.storage.read(f"{place}/t.txt") == "ü".encode() and not log.storage.write_new(f"{place}/t.txt", "z") and log.storage.names(f"{place}/no") == []


def test_lost_version(spark, tmp_path):
    log = commits.Log(spark, str(tmp_path))
    for k in range(3):
        log.update(lambda s, k=k: {"set": {"k": k}})
    (tmp_path / "_log" / f"{1:020d}.json").unlink()
    with pytest.raises(ValueError, match="version 1 is missing"):
        log.snapshot()


def test_many_publishers(spark, tmp_path):
    """Publishers at the same time lose no cell."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "published")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: publish.publish(spark, root, f"m{k % 2}", {"sa": _result(**{f"t{k}": k / 10})}, "now"), range(16)))
    for m in (0, 1):
        saved = documents.read_object(f"{root}/m{m}/sa/summary.json")["result"]
        assert saved["domains"]["id"]["tasks"] == {f"t{k}": k / 10 for k in range(16) if k % 2 == m}
    assert documents.read_object(f"{root}/index.json").keys() == {"m0", "m1"} and commits.Log(spark, root).snapshot().version == 15


def test_publication(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "published")
    publish.publish(spark, root, "model", {"sa": _result(t1=0.5, t2=0.1) | {"gap": 1}}, "now")
    publish.publish(spark, root, "model", {"sa": _result(t2=0.7), "vs": _result(t1=0.2)}, "later")
    saved = documents.read_object(f"{root}/model/sa/summary.json")
    assert saved["result"]["domains"]["id"]["tasks"] == {"t1": 0.5, "t2": 0.7} and saved["result"]["overall"] == pytest.approx(0.6) and "gap" not in saved["result"]
    index = documents.read_object(f"{root}/index.json")
    rows = {(r["baseline"], r["metric"]): r["sha256"] for r in documents.artifact_index(spark, root).collect()}
    assert rows == {("model", m): index["model"][m]["sha256"] for m in ("sa", "vs")}
    before = (tmp_path / "published/model/sa/summary.json").read_text()
    # an error before the commit leaves everything as it was
    monkeypatch.setattr(commits.Log, "commit", lambda *_, **__: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        publish.publish(spark, root, "model", {"sa": _result(t1=0.9), "fpl": _result(t1=0.3)})
    monkeypatch.undo()
    assert (tmp_path / "published/model/sa/summary.json").read_text() == before and "model/fpl" not in commits.Log(spark, root).snapshot().properties
    # an error at any file after it is made good by the next export
    replace, calls = storage.Storage.replace, []

    def fails(self, path, text):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk")
        replace(self, path, text)

    monkeypatch.setattr(storage.Storage, "replace", fails)
    with pytest.raises(OSError):
        publish.publish(spark, root, "model", {"sa": _result(t1=0.9), "fpl": _result(t1=0.3)})
    monkeypatch.undo()
    assert len(publish.export(commits.Log(spark, root))) == 1 and publish.export(commits.Log(spark, root)) == []
    assert documents.read_object(f"{root}/model/sa/summary.json")["result"]["domains"]["id"]["tasks"]["t1"] == 0.9 and "fpl" in documents.read_object(f"{root}/index.json")["model"]
    assert publish.sync(spark, root, str(tmp_path / "mirror")) == ["model/fpl", "model/sa", "model/vs"] and publish.sync(spark, root, str(tmp_path / "mirror")) == []
    assert documents.read_object(str(tmp_path / "mirror/index.json")) == documents.read_object(f"{root}/index.json")
    with pytest.raises(ValueError, match="protocol"):
        publish.publish(spark, root, "model", {"sa": _result(t1=0.9) | {"protocol": "other"}})
    with pytest.raises(ValueError, match="portable"):
        publish.publish(spark, root, "a/b", {"sa": _result(t1=1.0)})


def test_published_figures_follow_the_records(spark, tmp_path):
    """Two runs over different tasks: what is published of them together is what one run over both says."""
    root = str(tmp_path / "site")
    rows = [("id", t, f"e{k}", s, v) for t, own in (("t1", [(True, 0.8), (False, 0.2)]), ("t2", [(True, 0.6), (False, 0.5), (False, 0.7)])) for k, (s, v) in enumerate(own)]
    frame = lambda some: spark.createDataFrame(some, "domain string, task string, episode string, success boolean, score double")
    result = lambda **tasks: _result(**tasks) | {"protocol": "p", "gap": 99}
    publish.publish(spark, root, "m", {"sa": result(t1=1.0)}, "now", {"sa": frame(rows[:2])})
    publish.publish(spark, root, "m", {"sa": result(t2=0.5)}, "now", {"sa": frame(rows[2:])})
    saved = documents.read_object(f"{root}/m/sa/summary.json")["result"]
    assert saved["domains"]["id"]["tasks"] == {"t1": 1.0, "t2": 0.5} and saved["gap"] == pytest.approx(0.7 - 0.4) and saved["terminal_values"]["range"] == pytest.approx(0.7)
    assert publish.published_records(spark, root, "m", "sa").count() == 5 and publish.published_records(spark, root, "m", "vs") is None
    # a cell that comes again replaces its records, and only those
    publish.publish(spark, root, "m", {"sa": result(t2=1.0)}, "now", {"sa": frame([("id", "t2", "e9", True, 0.9), ("id", "t2", "e8", False, 0.1)])})
    assert {r["episode"] for r in publish.published_records(spark, root, "m", "sa").where("task = 't2'").collect()} == {"e8", "e9"}
    assert documents.read_object(f"{root}/m/sa/summary.json")["result"]["gap"] == pytest.approx(0.85 - 0.15)


def test_contents(spark, tmp_path):
    for name, size in (("a.bin", 10_000), ("d/b.bin", 0), ("d/c.json", 5)):
        (tmp_path / "tree" / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / "tree" / name).write_bytes(bytes(size))
    root = str(tmp_path / "tree")
    old = contents.digests(spark, root, block=1000)
    rows = {r["path"]: r for r in old.collect()}
    assert rows.keys() == {"a.bin", "d/c.json"} and len(rows["a.bin"]["blocks"]) == 10 and len(rows["d/c.json"]["blocks"]) == 1
    kept = spark.createDataFrame(list(rows.values()), contents.FILES)
    before = contents.tree_digest(old)
    data = bytearray(10_000)
    data[3500] = 1
    (tmp_path / "tree/a.bin").write_bytes(data)
    (tmp_path / "tree/e.bin").write_bytes(b"new")
    found = {r["path"]: (r["change"], r["blocks"]) for r in contents.changes(kept, contents.digests(spark, root, block=1000)).collect()}
    assert found == {"a.bin": ("changed", [3]), "e.bin": ("added", [0])} and contents.tree_digest(contents.digests(spark, root, block=1000)) != before
    assert {r["path"] for r in contents.stamps(spark, root, r"\.json$").collect()} == {"a.bin", "e.bin"}
    assert contents.digests(spark, f"{root}/a.bin").first()["path"] == ""
    assert contents.code_digest() == contents.code_digest() != contents.code_digest(lambda x: x)


@pytest.mark.parametrize("names", [["a/b"], [""], ["x."], ["con"], ["LPT1.txt"], ["A", "a"], ["é", "é"], [".."], ["a\tb"]])
def test_components(names):
    with pytest.raises(ValueError):
        naming.check_components(names)
    naming.check_components(["good", "also good", "c-1"])
    with pytest.raises(ValueError):
        naming.check_components(["Summary"], task_names=True)


def test_small_files(tmp_path):
    path = tmp_path / "x.jsonl"
    documents.append_lines(path, [{"a": 1}, {"a": 2}])
    with open(path, "a") as f:
        f.write('{"a": 3')
    assert documents.recover_lines(path) == [{"a": 1}, {"a": 2}] and path.read_text().endswith('{"a":2}\n')
    with open(path, "a") as f:
        f.write('{"a": 4}')
    assert documents.recover_lines(path)[-1] == {"a": 4}
    path.write_text('{"a": 1}\n\n{bad\n')
    for read in (documents.recover_lines, documents.read_lines):
        with pytest.raises(ValueError, match=":3:"):
            read(path)
    (tmp_path / "y.json").write_text('{"a":\n x}')
    with pytest.raises(ValueError, match=":2:2:"):
        documents.read_object(tmp_path / "y.json")
    (tmp_path / "y.json").write_text("[1]")
    for read in (documents.read_object, documents.read_mapping):
        with pytest.raises(ValueError, match="object"):
            read(tmp_path / "y.json")
    assert documents.recover_lines(tmp_path / "none") == []


def test_reference_clip(tmp_path):
    (tmp_path / "sweep_objects").mkdir()
    (tmp_path / "sweep_objects/front.mp4").write_text("")
    for bad in ('{"num_frames": 1}', '{"num_frames": 7, "fps": 3}'):
        (tmp_path / "sweep_objects/metadata.json").write_text(bad)
        with pytest.raises(ValueError, match="num_frames"):
            documents.reference_clip(tmp_path, "sweep_blocks")
    (tmp_path / "sweep_objects/metadata.json").write_text('{"num_frames": 7}')
    assert documents.reference_clip(tmp_path, "sweep_blocks") == (tmp_path / "sweep_objects/front.mp4", 7)
    video = tmp_path / "t/videos/observation.images.cam_left_wrist/episode_000000.mp4"
    video.parent.mkdir(parents=True)
    video.write_text("")
    (tmp_path / "t/meta").mkdir()
    (tmp_path / "t/meta/info.json").write_text('{"total_frames": 0}')
    with pytest.raises(ValueError, match="total_frames"):
        documents.reference_clip(tmp_path, "t", "wrist_left")
    with pytest.raises(FileNotFoundError):
        documents.reference_clip(tmp_path, "nothing")


def test_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sa": {"domains": {d: {"mean": 0.5, "tasks": {"t": 0.5}} for d in ("id", "env", "emb")}}}))
    (tmp_path / "m.json").write_text(json.dumps({"baselines": [{"baseline": "b", "track": "x", "worlds": {"sim": {"sa": "a.json"}}}]}))
    rows, sources = board.read_manifest(spark, str(tmp_path / "m.json"))
    assert board.domain_scores(rows).count() == 3 and sources[0]["path"] == "a.json" and len(sources[0]["sha256"]) == 64
    with pytest.raises(ValueError, match="mean"):
        board.domain_scores(rows.withColumn("mean", F.lit(0.4)))
    (tmp_path / "a.json").write_text(json.dumps({"metric": "vs", "baseline": "b", "result": {}}))
    with pytest.raises(ValueError, match="another"):
        board.read_manifest(spark, str(tmp_path / "m.json"))


def test_bundles_are_strict(spark, tmp_path):
    plan = spark.createDataFrame([("q", "id", "t", "e", "go", "a", 3)], "query_id string, domain string, task string, episode string, instruction string, target string, anchor int")
    answers = spark.createDataFrame([("q", "text")], "query_id string, output string")
    candidates = spark.createDataFrame([("t", {"a": "x", "b": "y"})], "task string, candidates map<string,string>")
    items = identify.bundle(plan, answers, candidates)
    identify.write_bundle(items, str(tmp_path / "good"))
    assert identify.read_bundle(spark, str(tmp_path / "good")).first()["target_subtask_id"] == "a"
    for name, bad in (("target", items.withColumn("target_subtask_id", F.lit("c"))), ("field", items.withColumn("odd", F.lit(1))), ("twice", items.union(items)), ("blank", items.withColumn("domain", F.lit(" "))), ("none", items.limit(0))):
        identify.write_bundle(bad, str(tmp_path / name))
        with pytest.raises(ValueError):
            identify.read_bundle(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="candidates"):
        identify.bundle(plan, answers.limit(0), candidates)
    spans = spark.createDataFrame([("t", "e", "n", 0, 10)], "task string, episode string, target string, start int, end int")
    moved = identify.select_items(identify.read_bundle(spark, str(tmp_path / "good")), tasks=["t"], spans=spans).first()
    assert moved["query"]["query_id"] == "sia:t:e:n" and moved["target_subtask_id"] == "n"
    with pytest.raises(ValueError, match="log-probability"):
        identify.judged(items, spark.createDataFrame([("q", {"b": -1.0})], "query_id string, logprobs map<string,double>"))


def test_overlaps_and_order(spark):
    spans = spark.createDataFrame([("t", "e", "diverse", "x", 0, 6), ("t", "e", "diverse", "y", 5, 9)], "task string, episode string, solution string, id string, start int, end int")
    assert identify.overlapping(identify.relabelled(spans)).count() == 1
    rows = spark.createDataFrame([("t", "e", k) for k in (5, 1, 3)], "task string, episode string, anchor int")
    assert [r["anchor"] for r in audits.shortest_first(rows, 2).collect()] == [1, 3, 5]


def test_command_line(spark, tmp_path, capsys):
    """A configuration from the first command to the leaderboard's inputs."""
    root, out = _dataset(tmp_path / "data"), str(tmp_path / "out")
    row = ROW | {"data": "data", "output": "out", "tasks": ["t1", "t2"], "metrics": {m: {"mode": "base", "domains": ["id"]} for m in ("voc", "sa")}, "model_options": {"scale": 40}}
    (tmp_path / "run.yaml").write_text(json.dumps(row))
    path = str(tmp_path / "run.yaml")

    def go(*arguments):
        code = cli.main([*arguments], spark)
        return code, capsys.readouterr()

    assert go("validate", root, "--metrics", "voc,sa")[0] == 0
    assert go("inspect", path)[0] == 1 and go("publish", str(tmp_path / "site"), "model", path)[0] == 2
    code, said = go("run", path)
    assert code == 0 and json.loads(said.out) == {"voc": pytest.approx(1), "sa": 0}
    assert go("inspect", path)[0] == 0
    code, said = go("status", path, path)
    assert code == 0 and json.loads(said.out)["status"] == "complete"
    code, said = go("batch", path, "--metrics", "sa")
    assert code == 0 and said.out.split("\n")[:2] == ["sa t1: can run", "sa t2: the task does not declare the metric"]
    assert go("publish", str(tmp_path / "site"), "model", path)[0] == 0
    assert go("sync", str(tmp_path / "site"), str(tmp_path / "mirror"))[1].out.split() == ["model/sa", "model/voc"]
    assert documents.read_object(str(tmp_path / "mirror/model/voc/summary.json"))["result"]["protocol"] == "voc-cycle-forward-v2"
    assert go("curves", path, "voc", str(tmp_path / "best.svg"), "--most", "1")[0] == 0 and (tmp_path / "best.svg").read_text().count("<polyline") == 2
    assert "sa" in go("list", "metrics")[1].out.split() and "prefix" in go("list", "predictors")[1].out.split() and "identification_plan" in go("list")[1].out.split()
    code, said = go("query", "nothing", "x", "y")
    assert code == 2 and "unknown query" in said.err
    assert execute.operations(spark, config.load(path)).groupBy("metric").count().count() == 2
    # answers to a file of queries
    state = {"task_id": "t1", "episode_id": "e", "anchor_frame": 10}
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "a", "op": "value", "state": state, "instruction": "go"}) + "\n" + json.dumps({"query_id": "b", "op": "compare", "state_a": state, "state_b": state | {"anchor_frame": 30}, "instruction": "go"}) + "\n")
    assert go("infer", str(tmp_path / "q.jsonl"), str(tmp_path / "answers"), "--model", "echo", "--options", '{"scale": 40}')[0] == 0
    assert {r["query_id"]: r["score"] for r in wire.read_results(spark, str(tmp_path / "answers")).collect()} == {"a": 0.25, "b": 0.5}
    assert go("infer", str(tmp_path / "q.jsonl"), str(tmp_path / "x"), "--model", "nobody")[0] == 2
    # lengths of videos
    lengths = [(t, e, 40) for t, names in (("t1", ("good1", "good2", "other", "bad", "p", "z", "m")), ("t2", ("good1",))) for e in names]
    spark.createDataFrame(lengths, "task_id string, episode_id string, num_frames int").write.parquet(str(tmp_path / "videos"))
    assert go("check-frames", root, str(tmp_path / "videos"))[0] == 0
    spark.createDataFrame(lengths[1:], "task_id string, episode_id string, num_frames int").write.mode("overwrite").parquet(str(tmp_path / "videos"))
    code, said = go("check-frames", root, str(tmp_path / "videos"))
    assert code == 1 and said.out.strip() == "t1/good1: 40 annotated, None in the video"


def test_candidates_beyond_the_scored_tasks(spark, tmp_path):
    """One task is scored against the instructions of others that are not."""
    root = _dataset(tmp_path / "data")
    task = json.loads((tmp_path / "data/t1/metadata.json").read_text())
    for name in ("t3", "t4"):
        (tmp_path / "data" / name / "episodes").mkdir(parents=True)
        (tmp_path / "data" / name / "metadata.json").write_text(json.dumps(task | {"task_id": name, "instruction": f"do {name}"}))
        (tmp_path / "data" / name / "episodes/x").mkdir()
        for file in ("metadata.json", "annotation.json"):
            row = json.loads((tmp_path / "data/t1/episodes/good1" / file).read_text())
            (tmp_path / "data" / name / "episodes/x" / file).write_text(json.dumps(row | ({"episode_id": "x"} if file == "metadata.json" else {})))
    data = dataset.load(spark, root)
    easy = registry.METRICS["tga_easy"]
    rows = registry.planned(easy, data, ["t1"], ["id"], ["t1", "t3", "t4"]).select("task", "candidate").distinct().collect()
    assert {tuple(r) for r in rows} == {("t1", "correct"), ("t1", "task-t3"), ("t1", "task-t4")}
    assert {r["candidate"] for r in registry.planned(easy, data, ["t1", "t3"], ["id"]).where("task = 't1'").collect()} == {"correct", "task-t3"}
    with pytest.raises(ValueError, match="no candidates"):
        registry.planned(easy, data, ["t1", "t3"], ["id"], ["t3", "t4"])
    c = _config(root, str(tmp_path / "out"), ["tga_easy"], tasks=["t1"], candidate_tasks={"tga_easy": ["t1", "t3"]})
    assert list(execute.run(spark, c)["tga_easy"]["counterfactual_by_id"]) == ["task-t3"]
    row = ROW | {"data": root, "output": str(tmp_path / "more"), "metrics": {"sa": {"mode": "base", "domains": ["id", "env"]}}}
    with pytest.raises(ValueError, match="sa: no episode is eligible in env"):
        execute.run(spark, config.parse(row))


def test_judged_run(spark, tmp_path):
    """Subtask answers judged through the cache, by a judge that finds the candidate at once."""
    root, out = _dataset(tmp_path / "data"), str(tmp_path / "out")
    c = _config(root, out, ["sia"])

    def ask(prompt):
        import json as j

        return j.dumps({"1": -0.1, "2": -0.2}) if "- 1: 001" in prompt else "{}"

    judge = judging.candidate_judge(spark, ask, str(tmp_path / "judged"), "fake", delay=0.0)
    got = execute.run(spark, c, judge=judge)
    assert got["sia"]["overall"] == pytest.approx(2.718281828**-0.15, abs=1e-6) and execute.inspect(spark, c)["sia"]["state"] == "valid"
    items = identify.bundle(registry.METRICS["sia"].plan(dataset.load(spark, root), ["t1"], ["id"]), execute.operations(spark, c), spark.createDataFrame([("t1", {"001": "x", "002": "y"})], "task string, candidates map<string,string>"))
    bad = judging.candidate_judge(spark, lambda _: '{"7": -1.0}', str(tmp_path / "other"), "fake", delay=0.0)
    with pytest.raises(Exception, match="unfit judgement"):
        bad(items).collect()


def test_prefix_predictor(spark, tmp_path):
    """A run whose values come from a table of features."""
    root, out = _dataset(tmp_path / "data"), str(tmp_path / "out")
    features = [(t, e, f, float(f)) for t, names in (("t1", ("good1", "good2", "other", "bad", "p", "z", "m")), ("t2", ("good1",))) for e in names for f in range(40)]
    spark.createDataFrame(features, "task string, episode string, frame int, x double").write.parquet(str(tmp_path / "features"))
    c = _config(root, out, ["sa", "tga_hard", "cycle_voc", "sia"], model="prefix", model_options={"features": str(tmp_path / "features"), "scale": 40})
    got = execute.run(spark, c, _judged(spark, root))
    assert got["sa"]["terminal_values"]["range"] == pytest.approx(39 / 2 / 40) and got["tga_hard"]["confusion_matrix"]["id"]["t1"]["correct"] == pytest.approx(39 / 2 / 40)
    # on the way back the mean still rises until the frames fall below it
    line = [*range(40), *range(38, -1, -1)]
    back = pd.Series([sum(line[:39]) / 39, *(sum(line[: 79 - f]) / (79 - f) for f in range(36, -1, -2))]).rank()
    assert got["cycle_voc"]["components"]["forward"]["overall"] == pytest.approx(1) and got["cycle_voc"]["components"]["reverse"]["overall"] == pytest.approx(-back.corr(pd.Series(range(len(back))).astype(float)))
    assert execute.operations(spark, c).where("metric = 'sia'").first()["output"] == "prediction for: do t1"
    with pytest.raises(config.ConfigError, match="missing"):
        _config(root, out, ["sa"], model="prefix", model_options={})


def test_sheet(spark):
    svg = charts.sheet(spark.createDataFrame([(f"e{k}", [0.0, 1.0]) for k in range(4)], "episode string, values array<double>"))
    assert svg.count("<svg ") == 5 and 'viewBox="0 0 1440 320"' in svg
    cycle = charts.cycle_charts(spark.createDataFrame([("<e>", [0.0, 0.5, 1.0], [1.0, 0.5, 0.0]), ("flat", [1.0], [1.0])], "episode string, up array<double>, down array<double>")).orderBy("episode").collect()
    assert cycle[0]["svg"].count("12.0,148.0 126.0,80.0 240.0,12.0 354.0,80.0 468.0,148.0") == 2 and 'x1="240.0"' in cycle[0]["svg"] and "&lt;e&gt;" in cycle[0]["svg"]
    rows = charts.selected(spark.createDataFrame([("id", "t", f"e{k}", float(k % 5)) for k in range(10)], "domain string, task string, episode string, score double"), "score", 2).collect()
    assert {(r["place"], r["number"], r["episode"]) for r in rows} == {("best", 1, "e4"), ("best", 2, "e9"), ("worst", 1, "e0"), ("worst", 2, "e5")}
