"""Small files on the driver: JSON and YAML objects, atomic writes, artifact trees, reference clips."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ModuleNotFoundError:  # YAML takes in JSON, so JSON documents still load
    yaml = None


def _object(value: object, path: str | os.PathLike) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not an object")
    return value


def read_object(path: str | os.PathLike) -> dict:
    """One JSON object; an error names the path, the line and the column."""
    with open(path, encoding="utf-8") as f:
        try:
            return _object(json.load(f), path)
        except json.JSONDecodeError as e:
            raise ValueError(f"{path}:{e.lineno}:{e.colno}: {e.msg}") from None


def read_mapping(path: str | os.PathLike) -> dict:
    """One YAML (or JSON) mapping."""
    if yaml is None:
        return read_object(path)
    with open(path, encoding="utf-8") as f:
        try:
            return _object(yaml.safe_load(f), path)
        except yaml.YAMLError as e:
            raise ValueError(f"{path}: {' '.join(str(e).split())}") from None


def read_lines(path: str | os.PathLike) -> list[dict]:
    """JSONL objects of a small file; blank lines are skipped, an error names its line."""
    out = []
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            if line.strip():
                try:
                    out.append(_object(json.loads(line), f"{path}:{number}"))
                except json.JSONDecodeError as e:
                    raise ValueError(f"{path}:{number}: {e.msg}") from None
    return out


def write_atomic(path: str | os.PathLike, text: str) -> None:
    """A file that is replaced in one step, or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8", newline="\n") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def write_object(path: str | os.PathLike, value: dict) -> None:
    write_atomic(path, json.dumps(value, ensure_ascii=False, allow_nan=False, indent=1, sort_keys=True) + "\n")


def artifact_index(spark: SparkSession, root: str, name: str = "summary.json") -> DataFrame:
    """baseline, metric, path, sha256, length of ROOT/<baseline>/<metric>/<name>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", k)
    return files.select(part(1).alias("baseline"), part(2).alias("metric"), "path", F.sha2("content", 256).alias("sha256"), "length")


#: Folder names of the views in recorded episode sets, and older names of tasks.
VIEWS = {"front": "observation.images.cam_high", "wrist_left": "observation.images.cam_left_wrist", "wrist_right": "observation.images.cam_right_wrist"}
OLDER_NAMES = {"sweep_blocks": "sweep_objects", "store_laptop_and_headphone": "store_laptop_and_headphones"}


def reference_clip(root: str | os.PathLike, task: str, view: str = "front") -> tuple[Path, int]:
    """Video and number of frames of a task's reference: <task>/<view>.mp4 with metadata.json, or a recorded set with meta/info.json."""
    tried = []
    for name in filter(None, (OLDER_NAMES.get(task), task)):
        base = Path(root, name)
        for video, info, field in ((base / f"{view}.mp4", base / "metadata.json", "num_frames"), (base / "videos" / VIEWS.get(view, view) / "episode_000000.mp4", base / "meta/info.json", "total_frames")):
            tried.append(str(video))
            if video.is_file():
                row = read_object(info)
                n = row.get(field)
                if field == "num_frames" and set(row) != {field}:
                    raise ValueError(f"{info}: {field} and nothing else is wanted")
                if isinstance(n, bool) or not isinstance(n, int) or n < 2:
                    raise ValueError(f"{info}: {field} must be a whole number from 2 on")
                return video, n
    raise FileNotFoundError(f"no reference of {task}: tried {', '.join(tried)}")


def recover_lines(path: str | os.PathLike) -> list[dict]:
    """Rows of an append-only file; a last line that was cut off in writing is removed, any other damage is an error."""
    if not os.path.exists(path):
        return []
    data = Path(path).read_bytes()
    if data and not data.endswith(b"\n"):
        whole, _, tail = data.rpartition(b"\n")
        try:
            _object(json.loads(tail), path)
            data += b"\n"
        except (ValueError, UnicodeDecodeError):
            data = whole + b"\n" if whole else b""
        write_atomic(path, data.decode("utf-8"))
    return read_lines(path)


def append_lines(path: str | os.PathLike, rows: Iterable[dict]) -> None:
    """Rows at the end of a file, on disk when this returns."""
    with open(path, "a", encoding="utf-8", newline="\n") as f:
        for row in rows:
            f.write(json.dumps(row, ensure_ascii=False, separators=(",", ":"), allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
