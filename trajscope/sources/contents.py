"""What files hold, as digests: of blocks, of files, of trees of files. Executors read; the driver gets one digest.

A file's digest is that of its blocks' digests, a tree's that of its files',
gathered by the first digits of their paths' digests and so in lists of bounded
length. Kept, the files' rows tell which block of which file has changed.
"""

from __future__ import annotations

import hashlib
import inspect
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checked

BLOCK = 4 << 20
FILES = "path string, length long, blocks array<string>, digest string"


def _listed(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        files = files.option("pathGlobFilter", pattern)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    where = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    # a file's own path is its name below the root, or nothing if the root is the file
    below = F.regexp_replace(F.col("path"), r"^[a-zA-Z0-9+.-]+:(//[^/]*)?", "")
    return files.load(root).withColumn("path", F.substring(below, len(where) + 2, 1 << 30))


def digests(spark: SparkSession, root: str, pattern: str | None = None, block: int = BLOCK) -> DataFrame:
    """FILES of a file, or of all files below a folder, by content. One file is one row of the scan, and so at most 2 GB; scans pass over empty files."""
    places = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / block))
    blocks = F.transform(places, lambda k: F.sha2(F.substring(F.col("content"), (k * block + 1).cast("int"), F.lit(block)), 256))
    return _listed(spark, root, pattern).select("path", "length", blocks.alias("blocks")).withColumn("digest", _joined(F.col("blocks"), F.col("length")))


def _joined(blocks: Column, length: Column) -> Column:
    return F.sha2(F.concat_ws("\n", length.cast("string"), F.array_join(blocks, "\n")), 256)


def stamps(spark: SparkSession, root: str, other_than: str) -> DataFrame:
    """FILES of the files whose paths do not match, by length and time of change: for assets too large to be read for each run."""
    files = _listed(spark, root, None).where(~F.col("path").rlike(other_than))
    stamp = F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    return files.select("path", "length", F.array(stamp).alias("blocks")).withColumn("digest", _joined(F.col("blocks"), F.col("length")))


def tree_digest(files: DataFrame) -> str:
    found = checked.fingerprint(files.select("path", "digest").withColumn("all_", F.lit(0)), ["all_"]).first()
    return found["fingerprint"] if found else hashlib.sha256(b"").hexdigest()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed or changed) and the numbers of the blocks that differ."""
    side = lambda df, name: df.select("path", F.col("digest").alias(f"{name}_digest"), F.col("blocks").alias(f"{name}_blocks"))
    both = side(old, "old").join(side(new, "new"), "path", "full_outer").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").otherwise("changed")
    pairs = F.arrays_zip(F.coalesce("old_blocks", F.array()).alias("o"), F.coalesce("new_blocks", F.array()).alias("n"))
    differ = F.filter(F.transform(pairs, lambda x, k: F.when(~x["o"].eqNullSafe(x["n"]), k)), lambda k: k.isNotNull())
    return both.select("path", change.alias("change"), differ.alias("blocks"))


def dataset_files(spark: SparkSession, root: str) -> DataFrame:
    """FILES of a dataset: its JSON by content, its videos and recordings by length and time of change."""
    return digests(spark, root, "*.json").unionByName(stamps(spark, root, r"\.json$"))


def code_digest(*own: object) -> str:
    """Of this package's code, and of the source of functions and classes from elsewhere (a registered metric or predictor)."""
    package = Path(__file__).resolve().parents[1]
    out = hashlib.sha256()
    for path in sorted(package.rglob("*.py")):
        if "llm" not in path.relative_to(package).parts:
            out.update(f"{path.relative_to(package).as_posix()}\n".encode() + path.read_bytes())
    for thing in own:
        try:
            text = inspect.getsource(thing).encode()
        except (OSError, TypeError):  # typed in, or built at run time
            text = getattr(getattr(thing, "__code__", None), "co_code", repr(thing).encode())
        out.update(text)
    return out.hexdigest()


