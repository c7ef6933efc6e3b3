"""WARC archives: a writer with revisit records and a salvage reader.

Writer: one gzip member per record, laid one after another with a NUL between
them (padding that gzip readers skip), in archives of about ARCHIVE_BYTES (one
record at least). Of pages with equal payloads the largest page_id is written as
`response`, the others as `revisit` that refer to it.

Reader: every member is checked (gzip CRC, WARC version line, Content-Length,
payload digest). After a failed check it searches for the next gzip magic or
`WARC/1.` line from which a record can be read, goes on there, and reports the
bytes skipped as a quarantined gap. Members are inflated piece by piece and each
search goes on where the last one ended, so time grows with the archive's size.
An archive is one row of the scan, and so at most 2 GB.

Defined cases: null or empty html is an empty payload; a null or dirty url is
left out or percent-escaped; a page without an id revisits the page with the
largest id of the same payload, and is a response if none has an id; rows that
repeat the largest id are all responses; repeated rows are each written; very
long texts are one record each; an empty table gives an empty archive; columns
beyond page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

ARCHIVE_BYTES = 64 << 20
INFLATE_BYTES = 1 << 16
#: A gzip header (its name and comment have no length of their own) that goes on beyond this is taken as damage.
HEADER_BYTES = 1 << 17
RECORD_ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string, gap_bytes long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writer -------------------------------------------------------------------


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to (null for a response).

    The group's largest id is found with a partial aggregate, and only groups of
    two or more come back, so a payload that a third of the pages share is no
    hot task; the join back is a sort-merge join that Spark may split.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    groups = own.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "last")
    out = own.join(groups, "payload_digest", "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, refers_to) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{RECORD_ID}{page_id}>")
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(most: int):
    """The members, and the archive that each belongs to: a new one after every `most` bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, archive, size = TaskContext.get().partitionId(), 0, 0
        for frame in frames:
            out, held = [], 0
            for p, u, h, r in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"], strict=True):
                data = member(record_bytes(None if pd.isna(p) else int(p), u, h.encode("utf-8", "surrogatepass"), None if pd.isna(r) else int(r)))
                if size and size + len(data) > most:
                    archive, size = archive + 1, 0
                size, held = size + len(data), held + len(data)
                out.append((f"{part:06d}-{archive:06d}", data))
                if held > 1 << 24:
                    yield pd.DataFrame(out, columns=["archive", "record"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["archive", "record"])

    return run


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write planned records as archives of at most archive_bytes, or one record, each.

    The text sink copies a string's bytes as they are, so binary members pass
    through it; that makes the write work on any file system that Spark knows.
    """
    members = records.mapInPandas(_members(archive_bytes), "archive string, record binary")
    members.select("archive", F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").partitionBy("archive").text(path)


# --- salvage reader -----------------------------------------------------------

MAGIC, LINE, HEAD_END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.\d\r\n")


class Archive:
    """The bytes of an archive, with searches that go on where they ended."""

    def __init__(self, data: bytes):
        self.data, self.view, self.found = data, memoryview(data), {}

    def find(self, what: bytes, at: int) -> int:
        """Where `what` stands next from at on, or the archive's size; at must not go back."""
        if self.found.get(what, -1) < at:
            place = self.data.find(what, at)
            self.found[what] = place if place >= 0 else len(self.data)
        return self.found[what]

    def inflate(self, at: int) -> tuple[bytes, int]:
        """What the gzip member at `at` holds, and its size."""
        z, out, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(self.data):
                raise ValueError("truncated gzip member")
            piece = self.view[end : end + INFLATE_BYTES]
            out.append(z.decompress(piece))
            end += len(piece)
            if end - at > HEADER_BYTES and not any(out):
                raise ValueError("gzip header without an end")
        return b"".join(out), end - len(z.unused_data) - at


def _parse(archive: Archive, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and size of the record at `at`."""
    raw = archive.data
    cut = archive.find(HEAD_END, at)
    if not VERSION.match(raw, at) or cut == len(raw):
        raise ValueError("no version line or header end")
    head = {}
    for line in raw[at:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = int(head.get("content-length", "-1"))
    end = cut + 4 + length
    if length < 0 or raw[end : end + 4] != HEAD_END:
        raise ValueError("Content-Length does not fit")
    return head, raw[cut + 4 : end], end + 4 - at


def _row(path: str, at: int, head: dict, block: bytes) -> dict:
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("block has no HTTP header")
    sizes = [int(x.partition(b":")[2]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, payload = head.get("warc-type", ""), block[cut + 4 :]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (digest32(payload) != digest or sizes and sizes[0] != len(payload)):
        raise ValueError("payload digest or length does not fit")
    ident = lambda x: int(x.strip("<>").removeprefix(RECORD_ID)) if x.strip("<>").startswith(RECORD_ID) else None
    return {"path": path, "offset": at, "record_type": kind, "page_id": ident(head.get("warc-record-id", "")), "url": head.get("warc-target-uri"), "payload_bytes": sizes[0] if sizes else len(payload), "payload_digest": digest, "refers_to": ident(head.get("warc-refers-to", "")), "payload": payload if kind == "response" else None}


def salvage(path: str, data: bytes) -> Iterator[dict]:
    """Records of one archive, gzip members or plain, and a row with error and gap_bytes for each gap."""
    archive, at, gap, why = Archive(data), 0, None, ""
    while at < len(data):
        if data[at] == 0 and gap is None:
            at += 1
            continue
        try:
            if data.startswith(MAGIC, at):
                raw, used = archive.inflate(at)
                head, block, size = _parse(Archive(raw))
                if size != len(raw):
                    raise ValueError("bytes after the record in its member")
            elif data.startswith(LINE, at):
                head, block, used = _parse(archive, at)
            else:
                raise ValueError("neither a gzip member nor a version line")
            row = _row(path, at, head, block)
        except (ValueError, zlib.error) as e:
            if gap is None:
                gap, why = at, str(e)
            at = min(archive.find(MAGIC, at + 1), archive.find(LINE, at + 1))
            continue
        if gap is not None:
            yield {"path": path, "offset": gap, "error": why, "gap_bytes": at - gap}
            gap = None
        yield row
        at += used
    if gap is not None:
        yield {"path": path, "offset": gap, "error": why, "gap_bytes": len(data) - gap}


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in RECORDS.split(", "))])


def _salvaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            rows, size = [], 0
            for row in salvage(batch["path"][k].as_py(), batch["content"][k].as_py()):
                rows.append(row)
                size += len(row.get("payload") or b"")
                if size > 1 << 22 or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records and gaps under path (columns RECORDS)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_salvaged, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    rows = read_archives(spark, path).where(F.col("error").isNull())
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(h, CAST(k // 4 AS INT) * 5 + 1, 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p JOIN g USING (h)
"""
