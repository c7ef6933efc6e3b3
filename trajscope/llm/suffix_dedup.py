"""Suffix-array dedup: cut bytes covered by LENGTH-byte strings that occur twice.

A full suffix array of the corpus is not needed. Of the ANCHOR-grams in each
LENGTH-byte window the one with the smallest hash is its anchor; equal windows
have equal anchors at equal offsets, so it is enough to sort the suffixes that
start at anchors (about one byte in 85).

Sort: suffixes are range-partitioned by their leading tokens, the bytes of the
anchor gram as TOKENS big-endian numbers, by sampled splitters whose number grows
with the suffixes; ties go on to the next key (the whole stretch of windows with
that anchor) and then to a salt, so one very common suffix fills many buckets.
Buckets are sorted locally by multikey quicksort, token by token, neighbours are
compared, and the first and last runs of the buckets (two rows a bucket, a table
of their own) are compared across boundaries.

What follows the tokens counts as equal if its 64-bit hash is, in suffixes whose
leading bytes are equal: with so many suffixes all their bytes would not fit the
disk. See `common` for what that excludes.

The first sort finds stretches of windows that occur twice as a whole. Where one
anchor has different stretches, one of each kind is cut into blocks of windows,
of the sizes BLOCKS in turn down to single windows, and these are sorted by what
all windows of the block share (if that is unique, none of them occurs twice)
and by what they cover together (if that occurs twice, all of them do).

Texts are worked on in pieces of PIECE windows, which overlap by LENGTH - 1
bytes, so memory does not grow with a text. A stretch that a piece's end cuts
differs from its like elsewhere, and is then found by its blocks.

Defined cases: null text is empty; texts shorter than LENGTH keep all bytes;
repeated rows are occurrences of their own; an empty table gives an empty
result; null ids are documents of their own; ties need no order, as all equal
strings are cut; very long texts count whole; columns beyond doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, discard, joined, materialize, prefix_sums, scramble, sized, span_hashes, table, text_chunks

LENGTH = 200
ANCHOR = 32
PIECE = 1 << 18
BUCKET_ROWS = 300_000
BLOCKS = (16, 4, 1)
#: Leading tokens of a suffix: eight bytes each, all of the anchor gram.
TOKENS = ANCHOR // 8
LEAD = [f"l{k}" for k in range(TOKENS)]
SUFFIX = ", ".join(f"{c} long" for c in LEAD) + ", rest long, doc_id long, t long, at int, more int, anchor int"
_POSITION = np.uint64(2 * PIECE - 1)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i:i + width] for each i, by doubling."""
    out, size = v, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(v) - width + 1], out[width - size :])


def tokens(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on as TOKENS numbers that sort as the bytes do; what is missing counts as 0."""
    out = np.zeros((len(at), 8 * TOKENS), dtype=np.uint8)
    out[:, :n] = data[at[:, None] + np.arange(n)]
    return (out.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _suffix_rows(lead: np.ndarray, rest: np.ndarray, doc_id, t, at: np.ndarray, more: np.ndarray, anchor: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({**{c: lead[:, k] for k, c in enumerate(LEAD)}, "rest": rest, "doc_id": doc_id, "t": t, "at": at.astype("int32"), "more": more.astype("int32"), "anchor": anchor.astype("int32")})


def _piece(data: np.ndarray, base: int, offsets: np.ndarray, length: int, anchor: int):
    """stretches() of the windows that start in data, the bytes from `base` on; positions are those of all texts."""
    sums = prefix_sums(data)
    grams = np.arange(len(data) - anchor + 1)
    hashes = span_hashes(sums, grams, grams + anchor)
    first = (sliding_min((hashes & ~_POSITION) | grams.astype(np.uint64), length - anchor + 1) & _POSITION).astype(np.int64)
    starts = np.arange(len(first))
    text = np.searchsorted(offsets, starts + base, side="right") - 1
    fits = starts + base + length <= offsets[text + 1] - 1
    starts, text, first = starts[fits], text[fits], first[fits]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    more = np.diff(np.append(head, len(starts))) - 1
    at, text, first = starts[head], text[head], first[head]
    rest = scramble(span_hashes(sums, at, at + more + length) + (first - at).astype(np.uint64) * MIX[2] + more.astype(np.uint64) * MIX[3])
    return tokens(data, first, anchor), rest.view(np.int64), text, at + base - offsets[text], more, first + base - offsets[text]


def stretches(texts: list[str | None], length: int = LENGTH, anchor: int = ANCHOR):
    """(lead, rest, text, at, more, anchor) for each stretch of windows with one anchor, PIECE windows at a time.

    The windows start at at, ..., at + more; all in bytes from the start of the text.
    """
    data, offsets = joined(texts)
    for base in range(0, len(data) - length + 1, PIECE):
        yield _piece(data[base : base + PIECE + length - 1], base, offsets, length, anchor)


def _first_suffixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in text_chunks(frame):
            ids, keys = part["doc_id"].to_numpy(), part["t"].to_numpy()
            for lead, rest, text, at, more, anchor in stretches(part["text"].tolist()):
                yield _suffix_rows(lead, rest, ids[text], keys[text], at, more, anchor)


def blocks(data: np.ndarray, at: np.ndarray, more: np.ndarray, anchor: np.ndarray, size: int):
    """(lead, rest, at, more, anchor) of the blocks of `size` windows in stretches of one text, PIECE positions at a time.

    Blocks are counted from the anchor, so equal windows lie in equal blocks.
    """
    order = np.argsort(at, kind="stable")
    at, more, anchor = at[order], more[order], anchor[order]
    edges = np.flatnonzero(np.diff(at // PIECE)) + 1
    for own in np.split(np.arange(len(at)), edges):
        if len(own):
            base = at[own[0]]
            stop = (at[own] + more[own]).max() + LENGTH
            lead, rest, begin, wide, mark = _blocks(data[base:stop], at[own] - base, more[own], anchor[own] - base, size)
            yield lead, rest, begin + base, wide, mark + base


def _blocks(data: np.ndarray, at: np.ndarray, more: np.ndarray, anchor: np.ndarray, size: int):
    low, high = (anchor - at - more) // size, (anchor - at) // size
    n = high - low + 1
    of = np.repeat(np.arange(len(at)), n)
    block = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    at, more, anchor = at[of], more[of], anchor[of]
    begin, end = np.maximum(at, anchor - (block + 1) * size + 1), np.minimum(at + more, anchor - block * size)
    sums = prefix_sums(data)
    # the leading bytes of what all windows share, then a hash of all of it and of the block's place
    start, width = anchor - block * size, min(8 * (TOKENS - 1), LENGTH - size + 1)
    lead = tokens(data, start, width)
    lead[:, -1] = scramble(span_hashes(sums, start, start - size + 1 + LENGTH) + block.astype(np.uint64) * MIX[6]).view(np.int64)
    rest = scramble(span_hashes(sums, begin, end + LENGTH) + (anchor - begin).astype(np.uint64) * MIX[2] + (end - begin).astype(np.uint64) * MIX[3])
    return lead, rest.view(np.int64), begin, end - begin, anchor


def _block_suffixes(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, n = [], 0
            for text, doc_id, t, *lists in zip(*(frame[c] for c in ("text", "doc_id", "t", "ats", "mores", "anchors")), strict=True):
                for lead, rest, at, more, anchor in blocks(joined([text])[0], *(np.asarray(x, dtype=np.int64) for x in lists), size):
                    out.append(_suffix_rows(lead, rest, doc_id, t, at, more, anchor))
                    n += len(lead)
                    if n > 100_000:
                        yield pd.concat(out)
                        out, n = [], 0
            if out:
                yield pd.concat(out)

    return run


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order by the first column; only ties are sorted by the next, and so on."""
    order = np.argsort(columns[0], kind="quicksort")
    ranks = columns[0][order]
    group = np.zeros(len(order), dtype=np.int64)
    for column in columns[1:]:
        if len(order) < 2:
            break
        group = np.concatenate(([0], np.cumsum((ranks[1:] != ranks[:-1]) | (np.diff(group) != 0))))
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        inner = np.lexsort((column[order[where]], group[where]))
        order[where] = order[where[inner]]
        ranks = column[order]
    return order


SORTED = "kind int, bucket int, " + ", ".join(f"{c} long" for c in LEAD) + ", rest long, doc_id long, t long, at int, more int, anchor int, twice boolean, mixed boolean"


def sort_bucket(frame: pd.DataFrame, bucket: int) -> pd.DataFrame:
    """Rows of one bucket that occur twice, or stand for their run where a lead has several; and the outer runs (kind 1 first, 2 last)."""
    frame = frame.iloc[multikey_quicksort([frame[c].to_numpy() for c in (*LEAD, "rest")])]
    lead, rest = frame[LEAD].to_numpy(), frame["rest"].to_numpy()
    new_lead, new_run = np.ones(len(lead), dtype=bool), np.ones(len(lead), dtype=bool)
    new_lead[1:] = (lead[1:] != lead[:-1]).any(1)
    new_run[1:] = new_lead[1:] | (rest[1:] != rest[:-1])
    run, group = np.cumsum(new_run) - 1, np.cumsum(new_lead) - 1
    twice = np.bincount(run)[run] > 1
    mixed = np.bincount(group[new_run])[group] > 1
    out = frame.assign(kind=0, bucket=bucket, twice=twice, mixed=mixed & new_run)
    heads = np.flatnonzero(new_run)
    ends = out.iloc[[heads[0], heads[-1]]].assign(kind=[1, 2], mixed=mixed[[heads[0], heads[-1]]])
    return pd.concat([out[twice | out["mixed"].to_numpy()], ends])[[x.split()[0] for x in SORTED.split(", ")]]


def _sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sort_bucket of the partition, which the splitters hold at about BUCKET_ROWS rows."""
    rows = [f for f in frames if len(f)]
    if rows:
        yield sort_bucket(pd.concat(rows), TaskContext.get().partitionId())


def across_boundaries(rows: DataFrame) -> DataFrame:
    """The outer runs that meet their like, or another run of their lead, in another bucket."""
    ends = rows.where("kind > 0").drop("twice")
    # a run, or a lead, that lies in several buckets is the outer one of each
    runs = ends.groupBy(*LEAD, "rest").agg((F.min("bucket") < F.max("bucket")).alias("twice"))
    leads = ends.groupBy(*LEAD).agg((F.min("bucket") < F.max("bucket")).alias("wide"), ((F.min("rest") < F.max("rest")) | F.max("mixed")).alias("several")).where("wide")
    out = ends.join(leads, LEAD).join(runs, [*LEAD, "rest"])
    return out.where("twice OR several").select("doc_id", "t", "at", "more", "anchor", "twice", F.col("several").alias("mixed"))


def repeated_suffixes(suffixes: DataFrame, total: int) -> DataFrame:
    """doc_id, t, at, more, anchor, twice, mixed of suffixes that occur twice or stand for a run of a mixed lead."""
    n = max(1, -(-total // BUCKET_ROWS))
    bucketed = suffixes.repartitionByRange(n, *LEAD, "rest", F.xxhash64("t", "doc_id", "at"))
    rows = materialize(bucketed.mapInPandas(_sorted, SORTED), "sorted")
    return rows.where("kind = 0").select("doc_id", "t", "at", "more", "anchor", "twice", "mixed").unionByName(across_boundaries(rows))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        spans = []
        for ats, mores in zip(frame["ats"], frame["mores"], strict=True):
            a = np.asarray(ats, dtype=np.int64)
            order = np.argsort(a, kind="stable")
            a, e = a[order], np.maximum.accumulate((a + np.asarray(mores, dtype=np.int64) + LENGTH)[order])
            new = np.ones(len(a), dtype=bool)
            new[1:] = a[1:] > e[:-1]
            last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
            spans.append(np.stack([a[new], e[last]], 1).astype("<i8").tobytes())
        yield pd.DataFrame({"doc_id": frame["doc_id"], "t": frame["t"], "spans": spans})


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text, spans in zip(frame["doc_id"], frame["text"], frame["spans"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            found = np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist()
            kept, at, removed = hashlib.sha256(), 0, 0
            for a, e in found:
                kept.update(data[at:a])
                at, removed = e, removed + e - a
            kept.update(data[at:])
            rows.append((doc_id, len(data), removed, len(found), kept.hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(own: DataFrame) -> DataFrame:
    """doc_id, t, spans (little-endian pairs of start and end, merged) of the rows of own (doc_id, text, t) that lose bytes."""
    suffixes = materialize(own.mapInPandas(_first_suffixes, SUFFIX), "suffixes")
    found = materialize(repeated_suffixes(suffixes, suffixes.count()), "found")
    discard(suffixes)
    twice = found.where("twice").select("doc_id", "t", "at", "more")
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))
    for size in BLOCKS:
        lists = F.collect_set(F.struct("at", "more", "anchor")).alias("x")
        # what occurs twice as a whole needs no closer look; it stands for its kind among the others
        mixed = found.where("mixed").groupBy("doc_id", "t").agg(lists)
        mixed = mixed.select(F.col("doc_id").alias("id_"), F.col("t").alias("t_"), F.col("x.at").alias("ats"), F.col("x.more").alias("mores"), F.col("x.anchor").alias("anchors"))
        mixed = materialize(mixed, "mixed")
        rows = own.join(sized(mixed), same).select("doc_id", "t", "text", "ats", "mores", "anchors").mapInPandas(_block_suffixes(size), SUFFIX)
        suffixes = materialize(rows, "suffixes")
        found = materialize(repeated_suffixes(suffixes, suffixes.count()), "found")
        discard(suffixes, mixed)
        twice = twice.unionByName(found.where("twice").select("doc_id", "t", "at", "more"))
    spans = twice.groupBy("doc_id", "t").agg(F.collect_set(F.struct("at", "more")).alias("x"))
    return materialize(spans.select("doc_id", "t", F.col("x.at").alias("ats"), F.col("x.more").alias("mores")).mapInPandas(_merged, "doc_id long, t long, spans binary"), "spans")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """CUT for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    spans = sized(repeated_spans(own).select(F.col("doc_id").alias("id_"), F.col("t").alias("t_"), "spans"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))
    return own.join(spans, same, "left").select("doc_id", "text", "spans").mapInPandas(_cut, CUT)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
