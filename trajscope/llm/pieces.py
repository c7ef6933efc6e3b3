"""SentencePiece encoding and decoding as a relational lattice.

Words (a text with spaces as U+2581, cut where no piece can reach across) are
exploded into substrings of bounded length and equi-joined to the piece table;
the matches, grouped by word, are its lattice. A fold with Spark's higher-order
`aggregate` finds the segmentation:

* unigram models: Viterbi over the end positions;
* BPE models: their scores are merge ranks, and the best path by their sum is not
  the encoding (it prefers several early pieces to one late one). The fold runs
  over the same lattice and applies the first applicable merge by rank, in one
  pass where no merge makes an earlier one possible.

Characters without a piece become byte pieces. Words of over MASK characters are
merged by the same rule outside the fold, with a heap.

The HOT most frequent words of the corpus are folded once; their ids, a sorted
table of hashes of at most HOT rows, travel with the code. The other words of a
text are folded beside it: they are shuffled once with the text by a row key, and
exploding, joining, grouping and folding stay within that partitioning. Nothing
depends on HOT but speed.

Defined cases: null or empty text has no ids; a text that holds U+2581 itself
decodes to a space there, and its round_trip is false; repeated rows each get a
row, null ids as well; an empty table gives an empty result; very long texts and
words are encoded whole; equal ranks are decided from the left; columns beyond
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, discard, joined, materialize, prefix_sums, scramble, small_batches, span_hashes, table, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MASK = 60
HOT = 500_000
#: Words that a task counts before it passes them on.
COUNTED = 300_000
PARTITION_CHARS = 4_000_000
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces of a model file: rows (id, piece, score, type), and how it segments."""

    def __init__(self, data: bytes):
        self.rows: list[tuple[int, str, float, int]] = []
        self.kind, self.dummy_prefix = UNIGRAM, True
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.rows.append((len(self.rows), own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                if own.get(1, b"identity") != b"identity" or own.get(4, 1):
                    raise ValueError("only models with identity normalisation that keep white space are supported")
                self.dummy_prefix = bool(own.get(3, 1))
        self.normal = {p: (i, s) for i, p, s, t in self.rows if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p, _, t in self.rows if t == BYTE}
        self.longest = max(map(len, self.normal))
        self.unknown = min(s for _, s in self.normal.values()) - 10
        if any(SPACE in p.lstrip(SPACE) for p in self.normal):
            raise ValueError("pieces that reach across words are not supported")
        self.early = self._early() if self.kind == BPE else set()
        self.apart = self._apart()

    def _early(self) -> set[str]:
        """Pieces that rank no later than the merge that makes them possible.

        Until a piece is merged, no merge crosses the ends of its characters, so
        those within come as they do in the piece alone.
        """
        out = set()
        for p, (_, score) in self.normal.items():
            halves = [(a, b) for a, b in ((p[:k], p[k:]) for k in range(1, len(p))) if a in self.normal and b in self.normal]
            if any(len(x) > 1 and self.normal[x][1] <= score for pair in halves for x in pair):
                ranks: list[float] = []
                if len(merge_word(p, self, ranks)) == 1 and ranks[-1] <= max(ranks[:-1], default=-np.inf):
                    out.add(p)
        return out

    def _apart(self) -> np.ndarray:
        """For each two bytes, at 256 * first + second, whether they never follow each other in a character or a piece: no piece reaches across. A space stands for U+2581."""
        out = np.ones((256, 256), dtype=bool)
        out[:, 0x80:0xC0] = False
        for p in self.normal:
            b = np.frombuffer(p.replace(SPACE, " ").encode("utf-8", "surrogatepass"), np.uint8)
            out[b[:-1], b[1:]] = False
        return out.ravel()

    def piece_bytes(self) -> list[bytes]:
        special = lambda p, t: bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t == NORMAL else b""
        return [special(p, t) for _, p, _, t in self.rows]


def load(path: str = MODEL) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


# --- words --------------------------------------------------------------------


#: Bytes of the longest word that is hashed in eights.
EIGHTS = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: eight bytes at a time, and those of longer spans by their polynomials. Spans of eight bytes or less and one length never meet."""
    eights = np.lib.stride_tricks.as_strided(np.concatenate((data, np.zeros(8, np.uint8))), (len(data) + 1, 8), (1, 1))
    size = end - start

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(eights[at]).view("<u8").ravel() & _FIRST[np.minimum(left, 8)]

    out = scramble(load(start, size) + size.astype(np.uint64) * MIX[0])
    rows, k = np.flatnonzero((size > 8) & (size <= EIGHTS)), 8
    while len(rows):
        out[rows] = scramble((out[rows] + load(start[rows] + k, size[rows] - k)) * MIX[1])
        k += 8
        rows = rows[size[rows] > k]
    long = np.flatnonzero(size > EIGHTS)
    if len(long):
        out[long] = span_hashes(prefix_sums(data), start[long], end[long])
    return out


class Splitter:
    """Words of texts by their bytes; a space stands for U+2581. Their concatenation is the text as the model sees it."""

    def __init__(self, model: PieceModel):
        self.prefix = " " if model.dummy_prefix else ""
        self.apart = model.apart

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """bytes, starts, ends, texts and hashes of the words."""
        data, offsets = joined([self.prefix + t.replace(SPACE, " ") if t else "" for t in texts])
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets], cut[offsets[1:] - 1] = True, True
        cut[1:-1] |= self.apart[data[:-1].astype(np.uint16) << 8 | data[1:]]
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
        own = start < offsets[text + 1] - 1  # the line feeds between texts are no words
        start, end, text = start[own], end[own], text[own]
        return data, start, end, text, _span_codes(data, start, end)


def _word(data: np.ndarray, start: int, end: int) -> str:
    return data[start:end].tobytes().decode("utf-8", "surrogatepass").replace(" ", SPACE)


def _hashes_of(words: list[str]) -> np.ndarray:
    """The hashes that Splitter gives these words."""
    data, offsets = joined([w.replace(SPACE, " ") for w in words])
    return _span_codes(data, offsets[:-1], offsets[1:] - 1)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of data[start:start + size], one span after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _counted(model: PieceModel):
    """(word, n) of the words, with spaces for U+2581; a word may come several times."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Hashes, counts, sizes and bytes of the different words of parts."""
        h, n, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, first, at = np.unique(h, return_index=True, return_inverse=True)
        return own, np.bincount(at, n).astype(np.int64), size[first], _gather(data, (np.cumsum(size) - size)[first], size[first])

    def batch(_, n: np.ndarray, size: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data)), pa.array(n)], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts, most = Splitter(model), [], 0
        for rows in batches:
            for part in text_chunks(rows.to_pandas()):
                data, start, end, _, h = split(part["text"].tolist())
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                size = (end - start)[first]
                parts.append((own, n, size, _gather(data, start[first], size)))
                most += len(own)
                if most >= 2 * COUNTED:
                    parts = [merged(parts)]
                    most = len(parts[0][0])
                    if most >= COUNTED:
                        yield batch(*parts[0])
                        parts, most = [], 0
        if parts:
            yield batch(*merged(parts))

    return run


class Dictionary:
    """ids of words by their hashes: sorted hashes, places of the ids, and whether the ids spell the word.

    It travels in the smallest types that hold it, about 17 bytes a word.
    """

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, spelt: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        sizes = sizes.astype(np.int64)
        place = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        after = np.cumsum(sizes)
        self.hashes, self.sizes, self.spelt, self.place, self.first = hashes[order], sizes, spelt[order], after - sizes, None
        self.ids = ids[np.repeat(place - self.place, sizes) + np.arange(sizes.sum())].astype(np.int32)

    def __getstate__(self):
        least = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        return self.hashes, least(self.sizes), least(self.ids), np.flatnonzero(~self.spelt).astype(np.int32)

    def __setstate__(self, state):
        self.hashes, sizes, ids, odd = state
        self.sizes, self.ids, self.spelt = sizes.astype(np.int64), ids.astype(np.int32), np.ones(len(sizes), dtype=bool)
        self.spelt[odd], self.first = False, None
        self.place = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, words: list[str], ids: list[np.ndarray], pieces: list[bytes]) -> Dictionary:
        flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in ids)])
        spelt = [b"".join([pieces[k] for k in x]) == w.replace(SPACE, " ").encode("utf-8", "surrogatepass") for w, x in zip(words, (np.asarray(x).tolist() for x in ids), strict=True)]
        return cls(_hashes_of(words), np.array([len(x) for x in ids], np.int32), flat.astype(np.int32), np.array(spelt, dtype=bool))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        if self.first is None:
            # where the hashes of each leading bits begin: about one of two places is taken
            bits = max(1, len(self.hashes).bit_length() + 1)
            self.shift = np.uint64(64 - bits)
            self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        out, at, rows = np.full(len(h), -1), self.first[h >> self.shift], np.arange(len(h))
        while len(rows):
            inside = at < len(self.hashes)
            at, rows = at[inside], rows[inside]
            own, want = self.hashes[at], h[rows]
            hit = own == want
            out[rows[hit]] = at[hit]
            below = own < want
            at, rows = at[below] + 1, rows[below]
        return out


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """The columns of words, with edges: all (rank, s, e, id, need, inner, early) of pieces in the column `word`, best rank first.

    rank is minus the score; need has the bits of both ends and inner those
    between. Characters without a piece have an edge with id -1. A word that
    comes in two rows has two lattices.

    words is partitioned by some of its columns, and the piece table (fixed by
    the model) is broadcast, so grouping the edges needs no further shuffle.
    """
    spark = words.sparkSession
    # a hash as the key makes the lookup one of numbers; the pieces are compared as well
    table_ = spark.createDataFrame([(p, i, -s, p in model.early) for p, (i, s) in model.normal.items()], "known string, id int, rank double, early boolean")
    table_ = F.broadcast(table_.withColumn("h", F.xxhash64("known")))
    # rows come numbered, so that grouping by the number first finds them in order
    size, keys = F.length("word"), ["number", *words.columns]
    spans = words.select(F.monotonically_increasing_id().alias("number"), "*")
    spans = spans.select(*keys, F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    spans = spans.select(*keys, "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), size - F.col("s")))).alias("l"))
    spans = spans.select(*keys, "s", (F.col("s") + F.col("l")).alias("e"), F.expr("substring(word, s + 1, l)").alias("piece"))
    edges = spans.join(table_, (F.xxhash64("piece") == F.col("h")) & (F.col("piece") == F.col("known")), "left").where("id IS NOT NULL OR e = s + 1")
    one = "shiftleft(1L, {})".format
    edges = edges.select(*keys, F.struct(
        F.coalesce("rank", F.lit(-model.unknown)).alias("rank"), "s", "e", F.coalesce("id", F.lit(-1)).alias("id"),
        F.expr(f"{one('s')} | {one('e')}").alias("need"), F.expr(f"{one('s + 1')} * ({one('e - s - 1')} - 1)").alias("inner"),
        F.coalesce("early", F.lit(False)).alias("early"),
    ).alias("edge"))
    return edges.groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges")).drop("number")


#: SQL: spans of the best path over `edges`, the longest last piece on ties; unknown characters stand at a penalty.
_VITERBI = """
    aggregate(
      reverse(sequence(1, length(word))),
      named_struct('at', length(word), 'out', cast(array() as array<struct<s:int,e:int,id:int>>), 'best',
        aggregate(sequence(1, length(word)), array(named_struct('score', 0.0D, 'k', 0, 's', 0, 'id', -1)), (best, e) -> concat(best, array(
          array_max(transform(filter(edges, x -> x.e = e), y -> named_struct('score', best[y.s].score - y.rank, 'k', -y.s, 's', y.s, 'id', y.id))))))),
      (a, e) -> if(a.at = e, named_struct('at', a.best[e].s, 'out', concat(array(named_struct('s', a.best[e].s, 'e', e, 'id', a.best[e].id)), a.out), 'best', a.best), a),
      a -> a.out)"""

#: SQL: the boundaries between symbols, as bits, after all merges; always the first merge by rank that joins two symbols. A merge makes
#: only later ones possible, so one pass by rank applies them all. Words with early pieces begin again after each merge; bit 62 says that none is left.
_MERGED = """
    if(NOT exists(edges, x -> x.early),
    aggregate(edges, shiftleft(1L, length(word) + 1) - 1L, (m, x) -> if((m & x.need) = x.need AND bit_count(m & x.inner) = 1, m & ~x.inner, m)),
    aggregate(sequence(1, length(word)), shiftleft(1L, length(word) + 1) - 1L, (m, k) -> if(m >= shiftleft(1L, 62), m,
      aggregate(edges, -1L, (f, x) -> if(f >= 0, f, if((m & x.need) = x.need AND bit_count(m & x.inner) = 1, m & ~x.inner, -1L)),
        f -> if(f >= 0, f, m | shiftleft(1L, 62))))))"""
#: SQL: the edges between neighbouring boundaries, in order.
_SYMBOLS = "sort_array(transform(filter(edges, x -> (merged & x.need) = x.need AND (merged & x.inner) = 0), x -> named_struct('s', x.s, 'e', x.e, 'id', x.id)))"


def merge_word(word: str, model: PieceModel, ranks: list[float] | None = None) -> list[tuple[int, int]]:
    """Spans of a word of any length under the merge rule, with a heap; the ranks of its merges go to `ranks`."""
    n = len(word)
    after, before, ends, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if 0 <= a and b < n and (hit := model.normal.get(word[a : ends[b]])) and ends[b] - a <= model.longest:
            heapq.heappush(heap, (-hit[1], a, ends[a], ends[b]))

    for k in range(n):
        offer(k)
    while heap:
        rank, a, mid, end = heapq.heappop(heap)
        if not alive[a] or ends[a] != mid or mid >= n or ends[mid] != end:
            continue
        if ranks is not None:
            ranks.append(rank)
        alive[mid], ends[a], after[a] = False, end, after[mid]
        if after[mid] < n:
            before[after[mid]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [(k, ends[k]) for k in range(n) if alive[k]]


def _span_ids(spans: list[tuple[int, int]], word: str, model: PieceModel) -> list[int]:
    out: list[int] = []
    for s, e in spans:
        hit = model.normal.get(word[s:e])
        out += [hit[0]] if hit else [model.bytes[b] for b in word[s:e].encode("utf-8", "surrogatepass")]
    return out


def dictionary(words: DataFrame, model: PieceModel) -> DataFrame:
    """The columns of words and ids. BPE models: words of MASK characters at most."""
    found = lattice(words, model)
    if model.kind == BPE:
        found = found.withColumn("merged", F.expr(_MERGED)).withColumn("spans", F.expr(_SYMBOLS))
    else:
        found = found.withColumn("spans", F.expr(_VITERBI))
    found = found.withColumn("byte_ids", F.array(*(F.lit(model.bytes[b]) for b in range(256))))
    # the bytes of a character without a piece, from its hexadecimal digits
    char = "hex(encode(substring(word, x.s + 1, 1), 'utf-8'))"
    raw = f"transform(sequence(1, length({char}), 2), k -> cast(conv(substring({char}, k, 2), 16, 10) as int))"
    return found.select(*words.columns, F.expr(f"flatten(transform(spans, x -> if(x.id >= 0, array(x.id), transform({raw}, b -> byte_ids[b]))))").alias("ids"))


# --- texts --------------------------------------------------------------------

ENCODED = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"


def _decoded(ids, pieces: list[bytes], dummy_prefix: bool) -> str:
    out = b"".join([pieces[k] for k in ids]).decode("utf-8", "replace")
    return out[1:] if dummy_prefix and out.startswith(" ") else out


def decode(encoded: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """doc_id and text for each row of encoded (doc_id, ids).

    Null ids are no text, no ids an empty one; ids that the model lacks are an
    error; bytes that are not UTF-8 become U+FFFD.
    """
    model = model or load()
    pieces, prefix = model.piece_bytes(), model.dummy_prefix

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [None if row is None else _decoded(row.tolist(), pieces, prefix) for row in frame["ids"]]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInPandas(run, "doc_id long, text string")


def _packed(model: PieceModel):
    """A partition of (word, ids) as the arrays of a Dictionary."""
    pieces = model.piece_bytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = Dictionary.of(frame["word"].tolist(), frame["ids"].tolist(), pieces)
                yield pd.DataFrame({"hashes": [d.hashes.tobytes()], "sizes": [d.sizes.astype("<i4").tobytes()], "ids": [d.ids.tobytes()], "spelt": [d.spelt.tobytes()]})

    return run


def hot_words(own: DataFrame, model: PieceModel, hot: int, longest: int) -> Dictionary:
    """The dictionary of the `hot` most frequent words, at most about 30 bytes each on the driver."""
    words = own.select("text").mapInArrow(_counted(model), "word string, n long").where(F.length("word") <= longest)
    words = words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("word", F.translate("word", " ", SPACE))
    top = materialize(words.orderBy(F.desc("n"), "word").limit(hot).select("word"), "words")
    n = -(-top.count() // 10_000) or 1
    rows = dictionary(top.repartition(n, "word"), model).mapInPandas(_packed(model), "hashes binary, sizes binary, ids binary, spelt binary").collect()
    discard(top)
    column = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
    return Dictionary(column("hashes", "<u8"), column("sizes", "<i4"), column("ids", "<i4"), column("spelt", "?"))


def _with_rare(shared, model: PieceModel, longest: int):
    """doc_id, text and the distinct words of each text that the shared dictionary lacks, of at most `longest` characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, hot = Splitter(model), shared.value
        for frame in frames:
            for part in text_chunks(frame):
                data, start, end, text, h = split(part["text"].tolist())
                at = np.flatnonzero(hot.find(h) < 0)
                order = at[np.lexsort((h[at], text[at]))]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (text[order[1:]] != text[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
                rare: list[list[str]] = [[] for _ in range(len(part))]
                for k in order[new].tolist():
                    word = _word(data, start[k], end[k])
                    if len(word) <= longest:
                        rare[text[k]].append(word)
                yield part.assign(rare=rare)

    return run


def _encoder(shared, model: PieceModel):
    pieces = model.piece_bytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, hot = Splitter(model), shared.value
        for frame in frames:
            for part in text_chunks(frame):
                texts = part["text"].tolist()
                data, start, end, text, h = split(texts)
                own: dict[str, np.ndarray] = {}
                for words, ids in zip(part["own"], part["own_ids"], strict=True):
                    if words is not None:
                        own.update(zip(words, ids, strict=True))
                row = hot.find(h)
                rare = Dictionary.of(list(own), list(own.values()), pieces)
                other = np.where(row < 0, rare.find(h), -1)
                left = np.flatnonzero((row < 0) & (other < 0))
                if len(left):  # words too long to fold
                    words = list(dict.fromkeys(_word(data, start[k], end[k]) for k in left.tolist()))
                    own.update((w, np.array(_span_ids(merge_word(w, model), w, model), np.int32)) for w in words)
                    rare = Dictionary.of(list(own), list(own.values()), pieces)
                    other = np.where(row < 0, rare.find(h), -1)
                # one table of the hot ids and the rare ones
                size, place, spelt = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), dtype=bool)
                for d, at, base in ((hot, row, 0), (rare, other, len(hot.ids))):
                    hit = at >= 0
                    size[hit], place[hit], spelt[hit] = d.sizes[at[hit]], d.place[at[hit]] + base, d.spelt[at[hit]]
                before = np.cumsum(size) - size
                gather = np.repeat(place - before, size) + np.arange(size.sum())
                from_hot = gather < len(hot.ids)
                ids = np.empty(len(gather), np.int32)
                ids[from_hot], ids[~from_hot] = hot.ids[gather[from_hot]], rare.ids[gather[~from_hot] - len(hot.ids)]
                n = np.bincount(text, size, minlength=len(part)).astype(np.int64)
                cut = np.concatenate(([0], np.cumsum(n)))
                # the pieces spell each word, and nothing but spaces is shown as U+2581
                same = (np.bincount(text, ~spelt, minlength=len(part)) == 0) & np.array([SPACE not in t for t in texts], dtype=bool)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], "n_tokens": n, "round_trip": same})

    return run


def encode(docs: DataFrame, model: PieceModel | None = None, hot_words_: int = HOT) -> DataFrame:
    """ENCODED for each row of docs."""
    model = model or load()
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longest = MASK if model.kind == BPE else 1 << 30
    hot = own.sparkSession.sparkContext.broadcast(hot_words(own, model, hot_words_, longest))  # HOT words at most
    # two rows of one key would only pool their words, so a 64-bit key is enough
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PARTITION_CHARS))
    # (the key is made last: it is known not to be null, and so nothing is filtered before the shuffle)
    keyed = own.mapInPandas(_with_rare(hot, model, longest), "doc_id long, text string, rare array<string>").withColumn("key", F.xxhash64("doc_id", "text")).repartition(n, "key")
    # both uses of keyed take the same columns, so that they share one shuffle of the texts
    rare = keyed.select("key", "doc_id", F.explode(F.when(F.col("text").isNotNull(), F.col("rare"))).alias("word"))
    rare = dictionary(rare, model).groupBy("key").agg(F.collect_set(F.struct("word", "ids")).alias("x"))
    rare = rare.select("key", F.col("x.word").alias("own"), F.col("x.ids").alias("own_ids"))
    full = keyed.join(rare, "key", "left").select("doc_id", F.when(F.col("rare").isNotNull(), F.col("text")).alias("text"), "own", "own_ids")
    return full.mapInPandas(_encoder(hot, model), ENCODED)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ENCODED for each document that is left."""
    return encode(docs)
