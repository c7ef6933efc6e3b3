"""Shared pieces: tables, the shared folder, and vectorised byte hashing.

Hashes are 64-bit: polynomials over a prime field in two lanes of 31 bits, mixed
with the length. Two different strings of n bytes have equal hashes for at most
(n / 2**31)**2 of all pairs of bases; n distinct words, shingles or windows have
about n**2 / 2**63 pairs that collide by chance.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_TABLES: dict[int, tuple[DataFrame, str]] = {}
#: Largest side of a join that is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


#: Rows that go to a Python worker at a time. Spark's 10,000 rows of long texts are more than the workers of one executor should hold.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, if they are larger. It is for the session, as plans read it when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session without a cluster may go without; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="trajscope-"))
    return _OWN_DIR[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; `discard` removes it."""
    small_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = out, path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `materialize` that nothing reads any more; the rest is the cluster's to clean."""
    for df in tables:
        _, path = _TABLES.pop(id(df), (None, None))
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


# --- hashing over bytes -------------------------------------------------------

#: Two lanes of polynomials over the field of _P elements. A polynomial modulo 2**64 would
#: give some pairs of strings (the Thue-Morse word and its complement) equal hashes for any base.
_P = np.uint64((1 << 31) - 1)
_SHIFT = np.uint64(31)
_BASES = (1_180_591_621, 742_938_285)
_POWERS: list[list[np.ndarray]] = []
MIX = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo _P for x below 2**62."""
    x = (x & _P) + (x >> _SHIFT)
    x = (x & _P) + (x >> _SHIFT)
    return np.where(x >= _P, x - _P, x)


def _powers(n: int) -> list[list[np.ndarray]]:
    """For each lane the first n powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        lanes = []
        for base in _BASES:
            rows = []
            for b in (base, pow(base, -1, int(_P))):
                row = np.ones(1, dtype=np.uint64)
                while len(row) < size:
                    row = np.concatenate((row, _fold(row * np.uint64(pow(b, len(row), int(_P))))))
                rows.append(row.astype(np.uint32))
            lanes.append(rows)
        _POWERS[:] = lanes
    return _POWERS


def scramble(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _summed(parts: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros((2, n + 1), dtype=np.uint64)
    for lane, part in enumerate(parts):
        # below 2**31 each, so 2**31 of them stay below 2**62
        np.cumsum(part, out=out[lane, 1:])
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """For each lane S with S[j] - S[i] proportional to the polynomial hash of data[i:j]."""
    n = len(data)
    parts = []
    for up, _ in _powers(n + 1):
        part = (data.astype(np.uint64) + np.uint64(1)) * up[:n]
        parts.append(part if n < 1 << 22 else _fold(part))
    return _summed(parts, n)


def sequence_sums(words: np.ndarray) -> np.ndarray:
    """The same sums over word hashes in place of bytes."""
    n, mixed = len(words), scramble(words)
    lanes = _powers(n + 1)
    return _summed([_fold(((mixed >> np.uint64(31 * k + 1)) & _P) * lanes[k][0][:n]) for k in (0, 1)], n)


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    high, low = (_fold(_fold(sums[k][end] - sums[k][start]) * down[start]) for k, (_, down) in enumerate(_powers(sums.shape[1])))
    return scramble(((high << np.uint64(31)) | low) + (end - start).astype(np.uint64) * MIX[0])


#: White space of the contracts: \x20 and \x09 to \x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: All but ASCII letters and digits and the bytes of longer characters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[0x80:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_a:_b] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each followed by a line feed, and the n + 1 offsets where they start."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8), offsets


def spans_of_words(data: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators; data ends with a separator."""
    gap = np.concatenate(([True], separators[data]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(texts: list[str | None], separators: np.ndarray = SPACES, lower: bool = False):
    """(hash of every word, n + 1 offsets of the texts' words)."""
    data, offsets = joined(texts)
    if lower:
        data = LOWER[data]
    start, end = spans_of_words(data, separators)
    return span_hashes(prefix_sums(data), start, end), np.searchsorted(start, offsets)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for each i with n words from it on (windows may cross texts)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * MIX[k]
        out = scramble(out) if k % 4 == 3 else out
    return scramble(out)


def chunk_ranges(texts: list[str | None], most: int = 1 << 18):
    """Row ranges (begin, end) that hold about `most` characters each, one row at least."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_chunks(frame, column: str = "text"):
    """Parts of a pandas frame by chunk_ranges."""
    for begin, end in chunk_ranges(frame[column].tolist()):
        yield frame.iloc[begin:end]
    release()


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values take at most `most` bytes; else df, for a shuffled join."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            size += F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif f.dataType.typeName() == "array":
            size += F.coalesce(8 * F.size(F.col(f.name)), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df
