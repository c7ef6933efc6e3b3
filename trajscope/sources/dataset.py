"""Dataset directories ROOT/<task>/metadata.json and ROOT/<task>/episodes/<ep>/{metadata,annotation}.json.

Files are read whole and parsed by Spark. Schemas are closed: unknown keys are
violations. Which blocks are checked depends on the metrics asked for; None
audits all. Violations are rows (path, rule), raised or reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start_frame:int,end_frame_exclusive:int>"
TASK = "task_id string, instruction string, supports struct<metrics:array<string>>, subtasks array<struct<id:string,description:string>>, tga struct<counterfactual_instructions:array<struct<id:string,description:string>>>"
EPISODE = "episode_id string, world_type string, domain string, success boolean, fps double, num_frames int, assets struct<videos:map<string,string>,robot_data:string>, trr struct<group_id:string,role:string>, cspc struct<solution_type:string>"
ANNOTATION = f"subtask_segments array<struct<id:string,subtask_frame:int,start_frame:int,end_frame_exclusive:int>>, voc array<struct<frame_index:int>>, voc_mem array<struct<frame_index:int>>, fpl struct<failure_span:{SPAN},failure_start:int,failure_end:int>, lpd array<struct<id:string,frameA:int,frameB:int,type:string>>, trr map<string,{SPAN}>"
#: The keys a file may have, and the metrics for which a block is checked.
KEYS = {
    "task": ("task_id", "instruction", "supports", "subtasks", "tga"),
    "episode": ("episode_id", "world_type", "domain", "success", "fps", "num_frames", "assets", "trr", "cspc"),
    "annotation": ("subtask_segments", "voc", "voc_mem", "fpl", "lpd", "trr"),
}
SCOPES = {
    "subtasks": ("sia", "cspc"), "tga": ("tga_easy", "tga_hard"), "trr_role": ("vs", "fpl", "trr", "cycle_voc", "tga_easy", "tga_hard"), "cspc": ("vs", "cspc", "sia", "cycle_voc", "tga_easy", "tga_hard"),
    "annotation": ("voc", "cycle_voc", "voc_mem", "sia", "cspc", "fpl", "lpd", "trr"), "subtask_segments": ("sia", "cspc"), "voc": ("voc", "cycle_voc"), "voc_mem": ("voc_mem",), "fpl": ("fpl",), "lpd": ("lpd",), "trr": ("trr",),
}


@dataclass(frozen=True)
class Dataset:
    tasks: DataFrame
    episodes: DataFrame
    violations: DataFrame


def scope(metrics: list[str] | None) -> set[str] | None:
    if metrics is None:
        return None
    out = {{"csvc": "cspc"}.get(m, m) for m in metrics}
    return out | {"cycle_voc"} if out & {"voc", "vs"} else out


def _wanted(asked: set[str] | None, block: str) -> bool:
    return asked is None or bool(asked & set(SCOPES[block]))


def json_files(spark: SparkSession, root: str, name: str, of_episode: bool, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """path, the parsed fields of schema, and the rules each file breaks as an object (array `broken`)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.where(F.col("path").rlike(f"/episodes/[^/]+/{name}$") == of_episode)
    parsed = files.withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    found = F.json_object_keys("value")
    broken = F.array_compact(F.array(F.when(found.isNull(), "not_an_object"), F.when(F.size(F.array_except(found, F.array(*map(F.lit, keys)))) > 0, "unknown_key")))
    return parsed.select("path", "j.*", broken.alias("broken"))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.length(F.trim(c)) == 0)


def _broken(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.concat("broken", F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in rules)))) if rules else F.col("broken")


def _repeats(c: Column) -> Column:
    return F.size(c) != F.size(F.array_distinct(c))


def _ids(c: str) -> Column:
    return F.transform(c, lambda x: x["id"])


def load(spark: SparkSession, root: str, metrics: list[str] | None = None, on_violation: str = "raise") -> Dataset:
    """tasks and episodes (with their annotations) under root; on_violation is raise or report."""
    asked = scope(metrics)
    t = json_files(spark, root, "metadata.json", False, TASK, KEYS["task"]).withColumn("key", F.regexp_extract("path", r"([^/]+)/metadata\.json$", 1))
    rules = [(_blank("task_id") | (F.col("task_id") != F.col("key")), "task_id"), (_blank("instruction"), "instruction"), (F.col("supports.metrics").isNull() | (F.size("supports.metrics") == 0), "supports")]
    if _wanted(asked, "subtasks"):
        rules.append((_repeats(_ids("subtasks")), "subtasks"))
    if _wanted(asked, "tga"):
        rules.append((_repeats(_ids("tga.counterfactual_instructions")), "tga"))
    t = t.withColumn("broken", _broken(rules))

    e = json_files(spark, root, "metadata.json", True, EPISODE, KEYS["episode"])
    e = e.withColumn("task_key", F.regexp_extract("path", r"([^/]+)/episodes/[^/]+/metadata\.json$", 1)).withColumn("key", F.regexp_extract("path", r"([^/]+)/metadata\.json$", 1))
    bad_fps = F.col("fps").isNull() | F.isnan("fps") | (F.col("fps") <= 0) | (F.col("fps") == float("inf"))
    rules = [
        (_blank("episode_id") | (F.col("episode_id") != F.col("key")), "episode_id"), (~F.coalesce(F.col("world_type").isin("real", "sim"), F.lit(False)), "world_type"), (~F.coalesce(F.col("domain").isin("id", "env", "emb"), F.lit(False)), "domain"),
        (F.col("success").isNull(), "success"), (bad_fps, "fps"), (F.coalesce(F.col("num_frames") <= 0, F.lit(True)), "num_frames"), (F.coalesce(F.size("assets.videos") <= 0, F.lit(True)), "videos"),
    ]
    if _wanted(asked, "trr_role"):
        known = F.coalesce(F.col("trr.role").isin("r_plus", "r_minus", "r_zero"), F.lit(False))
        rules.append((F.col("trr").isNotNull() & (~known | F.col("trr.group_id").isNull() | (F.col("success") != (F.col("trr.role") == "r_plus"))), "trr"))
    if _wanted(asked, "cspc"):
        rules.append((F.col("cspc").isNotNull() & ~F.coalesce(F.col("cspc.solution_type").isin("normal", "diverse"), F.lit(False)), "cspc"))
    e = e.withColumn("broken", _broken(rules))
    parts = [t.select("path", "broken"), e.select("path", "broken")]
    e = e.select(F.col("task_key").alias("task_id"), F.col("key").alias("episode_id"), "world_type", "domain", "success", "fps", "num_frames", F.col("trr.group_id").alias("trr_group"), F.col("trr.role").alias("role"), F.col("cspc.solution_type").alias("solution"), "assets")

    if _wanted(asked, "annotation"):
        a = json_files(spark, root, "annotation.json", True, ANNOTATION, KEYS["annotation"])
        a = a.withColumn("task_id", F.regexp_extract("path", r"([^/]+)/episodes/[^/]+/annotation\.json$", 1)).withColumn("episode_id", F.regexp_extract("path", r"([^/]+)/annotation\.json$", 1))
        a = a.join(e.select("task_id", "episode_id", F.col("num_frames").alias("n")), ["task_id", "episode_id"], "left")
        frames = lambda c: F.transform(c, lambda x: x["frame_index"])
        rules = [((_repeats(frames(c)) | F.exists(frames(c), lambda f: f.isNull() | (f < 0) | (f >= F.col("n")))), c) for c in ("voc", "voc_mem") if _wanted(asked, c)]
        start, end = F.coalesce("fpl.failure_span.start_frame", "fpl.failure_start"), F.coalesce("fpl.failure_span.end_frame_exclusive", "fpl.failure_end")
        if _wanted(asked, "fpl"):
            rules.append((F.col("fpl").isNotNull() & ~F.coalesce((start >= 0) & (start < end) & (end <= F.col("n")), F.lit(False)), "fpl"))
        if _wanted(asked, "subtask_segments"):
            point = lambda x: x["subtask_frame"].isNotNull()
            whole = lambda x: x["start_frame"].isNotNull() & x["end_frame_exclusive"].isNotNull()
            rules.append((_repeats(_ids("subtask_segments")) | F.exists("subtask_segments", lambda x: point(x) == whole(x)), "subtask_segments"))
        if _wanted(asked, "trr"):
            rules.append((F.exists(F.map_values("trr"), lambda s: ~F.coalesce((s["start_frame"] >= 0) & (s["start_frame"] < s["end_frame_exclusive"]) & (s["end_frame_exclusive"] <= F.col("n")), F.lit(False))), "trr"))
        if _wanted(asked, "lpd"):
            rules.append((F.exists("lpd", lambda x: ~F.coalesce(x["type"].isin("forward", "stagnation", "backward"), F.lit(False))), "lpd"))
        a = a.withColumn("broken", _broken(rules))
        parts.append(a.select("path", "broken"))
        spans = F.transform("subtask_segments", lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["subtask_frame"], x["start_frame"]).alias("start"), F.coalesce(x["subtask_frame"] + 1, x["end_frame_exclusive"]).alias("end")))
        a = a.select("task_id", "episode_id", spans.alias("spans"), F.array_sort(frames("voc")).alias("voc"), F.array_sort(frames("voc_mem")).alias("voc_mem"), start.alias("failure_start"), end.alias("failure_end"), F.col("trr").alias("trr_spans"))
        e = e.join(a, ["task_id", "episode_id"], "left")
    tasks = t.select(F.col("key").alias("task_id"), "instruction", F.col("supports.metrics").alias("metrics"), "subtasks", F.col("tga.counterfactual_instructions").alias("counterfactuals"))
    empty = tasks.join(e, "task_id", "left_anti").select(F.col("task_id").alias("path"), F.array(F.lit("no_episodes")).alias("broken"))
    violations = empty
    for p in parts:
        violations = violations.unionByName(p)
    violations = violations.select("path", F.explode("broken").alias("rule"))
    data = Dataset(tasks, e, violations)
    if on_violation == "raise":
        raise_violations(data)
    return data


def raise_violations(data: Dataset) -> None:
    first = data.violations.orderBy("path", "rule").limit(3).collect()
    if first or data.tasks.limit(1).count() == 0:
        raise ValueError("invalid dataset: " + ("; ".join(f"{r['path']}: {r['rule']}" for r in first) or "no tasks"))


def remap_labels(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Replace elements of an array column by labels (old, new), a hand-written list; others stay."""
    pairs = F.broadcast(labels.agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("labels_")))
    return rows.join(pairs).withColumn(column, F.transform(column, lambda x: F.coalesce(F.try_element_at("labels_", x), x))).drop("labels_")
