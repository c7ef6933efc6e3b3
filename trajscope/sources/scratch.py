"""A folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session may go without that setting, and gets a folder that goes when it ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="trajscope-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        shared = "file://" + _OWN[0]
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
