"""JSONL rows of queries and results: strict readers, and sinks."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "struct<task_id:string,episode_id:string,anchor_frame:int>"
QUERY = f"query_id string, op string, instruction string, playback string, state {STATE}, state_a {STATE}, state_b {STATE}"
RESULT = "query_id string, op string, score double, output string"
#: The fields of each kind of row.
FIELDS = {"value": ("query_id", "op", "state", "instruction", "playback"), "compare": ("query_id", "op", "state_a", "state_b", "instruction"), "subtask": ("query_id", "op", "state", "instruction")}


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """value, j, keys, and where a line stands: its file, the split's start in it and a number that rises with the lines of a split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where(F.length(F.trim("value")) > 0)
    return lines.select("value", F.from_json("value", schema).alias("j"), F.json_object_keys("value").alias("keys"), "file", "split", "at")


def line_number(spark: SparkSession, file: str, split: int, at: int) -> int:
    """The number of a line that `_lines` found: lines of the splits before its own, and of its own up to it.

    The file is counted again, split by split, only when there is an error to report.
    """
    lines = spark.read.text(file).select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n")).where(F.col("split") < split).agg(F.sum("n")).first()[0] or 0
    return counts + at + 1


def _refuse(rows: DataFrame, bad, path: str) -> None:
    """An error names the first bad line of the first file that has one."""
    spark = rows.sparkSession
    wrong = rows.where(F.coalesce(bad, F.lit(True))).select("value", "file", "split", "at")
    first = wrong.agg(F.min(F.struct("file", "split", "at", F.substring("value", 1, 200).alias("value"))).alias("x")).first()["x"]
    if first:
        number = line_number(spark, first["file"], first["split"], _within_split(spark, path, first))
        raise ValueError(f"{first['file']}:{number}: invalid row {first['value']}")


def _within_split(spark: SparkSession, path: str, line) -> int:
    """Lines of a split before the given one; a partition may hold several splits, each with its lines in a row."""
    same = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return same.where((F.col("file") == line["file"]) & (F.col("split") == line["split"]) & (F.col("at") < line["at"])).count()


def _no_repeats(rows: DataFrame, path: str) -> DataFrame:
    found = rows.groupBy("query_id").count().agg(F.count(F.lit(1)).alias("n"), F.min_by("query_id", -F.col("count")).alias("id"), F.max("count").alias("most")).first()
    if not found["n"]:
        raise ValueError(f"{path}: no rows")
    if found["most"] > 1:
        raise ValueError(f"{path}: {found['id']} occurs {found['most']} times")
    return rows


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries with exactly the fields of their op; ids are unique, and there is one at least."""
    rows = _lines(spark, path, QUERY)
    op = F.col("j.op")
    ok = F.lit(False)
    for name, fields in FIELDS.items():
        required = F.array(*(F.lit(f) for f in fields if f != "playback"))
        fits = (F.size(F.array_except("keys", F.array(*map(F.lit, fields)))) == 0) & (F.size(F.array_except(required, F.col("keys"))) == 0)
        ok = ok | ((op == name) & fits)
    ok = ok & (F.length(F.trim("j.query_id")) > 0) & (F.length(F.trim("j.instruction")) > 0) & F.coalesce(F.col("j.playback"), F.lit("forward")).isin("forward", "reverse", "cycle")
    ok = ok & ((op != "compare") | (F.col("j.state_a.task_id") == F.col("j.state_b.task_id")))
    _refuse(rows, ~ok, path)
    out = rows.select("j.*").withColumn("playback", F.when(F.col("op") == "value", F.coalesce("playback", F.lit("forward"))))
    return _no_repeats(out, path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results with a finite score (value, compare) or a non-blank output (subtask), and nothing else."""
    rows = _lines(spark, path, RESULT)
    s = F.col("j.score")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    text = F.col("j.op") == "subtask"
    keys = lambda *k: F.array_sort("keys") == F.array(*map(F.lit, sorted(k)))
    ok = F.when(text, keys("query_id", "op", "output") & (F.length(F.trim("j.output")) > 0)).when(F.col("j.op").isin("value", "compare"), keys("query_id", "op", "score") & finite)
    _refuse(rows, ~ok, path)
    return _no_repeats(rows.select("j.*"), path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", True).json(path)


def write_single_jsonl(rows: Iterable[dict], path: str) -> None:
    """One small file on the driver, replaced in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8", newline="\n") as f:
        for row in rows:
            f.write(json.dumps(row, ensure_ascii=False, separators=(",", ":"), allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
