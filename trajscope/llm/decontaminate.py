"""Benchmark decontamination by template canonicalisation.

Words are runs of letters and digits. A number becomes the placeholder NUM, a
capitalised word NAME, a unit after a number UNIT; runs of NUM or of NAME become
one placeholder; other words are kept in lower case. Templates are windows of
WINDOW canonical tokens (an item with fewer is one window of its own length).

Beside the templates, literal windows are WINDOW case-folded words, without
placeholders; an item is found by either kind. So letter case hides nothing: a
passage in capitals, whose words all look like names, has its literal windows.
By literal windows an item is found when they cover at least COVERAGE of its
words, or when RUN words of it stand in the document one after another, however
long the item is. Folded templates are templates of the case-folded text, where
numbers and units are placeholders and names are not: they find a question with
other numbers in whatever case.

Document windows are hash-joined to the benchmark's windows. The matches of a
document and an item are grouped by alignment (difference of positions). Within
it the values of the item's placeholders should map to the document's one to
one; windows with a value that maps to several, or to which several map, do not
count, save where the document has the item's own value. A run of NAME or NUM at the item's border
may go on beyond it in the document; there any suffix (at the start) or prefix
(at the end) of the run may be the value. An item is found when the windows left
in all alignments cover at least COVERAGE of its windows, so a question with
other numbers, names or units is found as well, and one whose slots contradict
each other is not.

Benchmark windows go to the executors in blocks of at most BLOCK_WINDOWS; a
larger benchmark takes more passes over the documents, and loses nothing.

Defined cases: null or empty texts have no windows and are clean; items without
a word match nothing; repeated documents or items each count (items by their
id and text); an empty benchmark leaves all clean; an empty table of documents
gives an empty result; null ids are documents like others; very long texts count
whole; ties need no order, as all items found are listed; columns beyond doc_id
(item_id) and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, MIX, NOT_ALNUM, joined, materialize, prefix_sums, scramble, sequence_sums, sized, span_hashes, spans_of_words, table, text_chunks, word_hashes

WINDOW = 8
COVERAGE = 0.5
RUN = 13
LEAST_LITERALS = 2
BLOCK_WINDOWS = 1_000_000
TEMPLATE, LITERAL, FOLDED = 0, 1, 2
NUM, NAME, UNIT = (np.uint64(x) for x in (11, 13, 17))
#: Units of measure that may follow a number.
UNITS = "mm cm m km in inch inches ft feet foot yd yards mile miles mg g kg t lb lbs oz ml l litre litres liter liters gallon gallons s sec seconds min minute minutes h hour hours day days week weeks month months year years dollars dollar euro euros cents percent degrees mph kmh".split()


def _hash(words: list[str]) -> np.ndarray:
    data, offsets = joined(words)
    return span_hashes(prefix_sums(data), offsets[:-1], offsets[1:] - 1)


_UNIT_HASHES = np.sort(_hash(UNITS))


def canonical(texts: list[str | None]):
    """(token hash, slot value or 0, n + 1 offsets, value) of the canonical tokens.

    value(token, from_start) has the values of all suffixes or prefixes of a token's run.
    """
    data, offsets = joined(texts)
    start, end = spans_of_words(data, NOT_ALNUM)
    first = np.searchsorted(start, offsets)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    plain = span_hashes(prefix_sums(LOWER[data]), start, end)
    digit = np.zeros(len(data) + 1, dtype=np.int64)
    digit[1:] = np.cumsum((data >= 48) & (data < 58))
    kind = np.zeros(len(start), dtype=np.uint64)
    lead = data[start] if len(start) else np.zeros(0, np.uint8)
    second = data[np.minimum(start + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kind[capital] = NAME
    kind[digit[end] - digit[start] == end - start] = NUM
    same_text = np.zeros(len(start), dtype=bool)
    same_text[1:] = text_of[1:] == text_of[:-1]
    after_number = np.zeros(len(start), dtype=bool)
    after_number[1:] = same_text[1:] & (kind[:-1] == NUM)
    at = np.minimum(np.searchsorted(_UNIT_HASHES, plain), len(_UNIT_HASHES) - 1)
    kind[after_number & (_UNIT_HASHES[at] == plain) & (kind == 0)] = UNIT
    goes_on = np.zeros(len(start), dtype=bool)
    goes_on[1:] = same_text[1:] & (kind[1:] == kind[:-1]) & ((kind[1:] == NUM) | (kind[1:] == NAME))
    head = np.flatnonzero(~goes_on)
    # the value of a run of NUM or NAME takes in all its words, in order; that of a part of the run is the same as anywhere else
    sums = sequence_sums(plain)
    ends = np.append(head, len(start))
    kind = kind[head]
    token = np.where(kind == 0, plain[head], scramble(kind))
    slot = np.where(kind == 0, np.uint64(0), span_hashes(sums, head, ends[1:]) | np.uint64(1))

    def parts(k: int, from_start: bool) -> np.ndarray:
        a, b = (np.full(ends[k + 1] - ends[k], ends[k]), np.arange(ends[k] + 1, ends[k + 1] + 1)) if from_start else (np.arange(ends[k], ends[k + 1]), np.full(ends[k + 1] - ends[k], ends[k + 1]))
        return (span_hashes(sums, a, b) | np.uint64(1)).view(np.int64)

    return token, slot, np.searchsorted(head, first), parts


def literal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, n + 1 offsets) of the case-folded words."""
    return word_hashes([(t or "").casefold() for t in texts], NOT_ALNUM)


def windows(tokens: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    out = np.full(max(0, len(tokens) - n + 1), np.uint64(n + 1000 * kind))
    for k in range(n):
        out = scramble(out + tokens[k : k + len(out)] * MIX[k])
    return out


def folded(texts: list[str | None]):
    """canonical() of the case-folded texts, which have no names."""
    return canonical([(t or "").casefold() for t in texts])


def _template_rows(items: list[tuple[int, int, str]], kind: int) -> list[dict]:
    token, slot, cut, _ = (folded if kind == FOLDED else canonical)([t for _, _, t in items])
    out = []
    for (key, item_id, _), a, b in zip(items, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        n = min(WINDOW, b - a)
        if n == 0 or (kind == FOLDED and not slot[a:b].any()):  # literal windows say the same
            continue
        for k, h in enumerate(windows(token[a:b], n, kind)):
            slots = slot[a + k : a + k + n].view(np.int64).tolist()
            out.append({"item": key, "item_id": item_id, "kind": kind, "at": k, "size": n, "hash": int(h.view(np.int64)), "slots": slots, "last": k + n == b - a})
    # windows of placeholders alone say nothing, unless the item has no others
    literals = lambda r: sum(x == 0 for x in r["slots"])
    rich = {r["item"] for r in out if literals(r) >= LEAST_LITERALS}
    out = [r for r in out if r["item"] not in rich or literals(r) >= LEAST_LITERALS]
    total = Counter(r["item"] for r in out)
    return [r | {"n_windows": total[r["item"]]} for r in out]


def item_windows(items: list[tuple[int, int, str]]) -> list[dict]:
    """Rows (item, kind, position, size, hash, slots, n_windows) of (key, item_id, text) items; literal ones have the words as n_windows."""
    out = _template_rows(items, TEMPLATE) + _template_rows(items, FOLDED)
    word, cut = literal([t for _, _, t in items])
    for (key, item_id, _), a, b in zip(items, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        n = min(WINDOW, b - a)
        for k, h in enumerate(windows(word[a:b], n, LITERAL).view(np.int64).tolist() if n else []):
            out.append({"item": key, "item_id": item_id, "kind": LITERAL, "at": k, "size": n, "hash": h, "slots": [], "last": k + n == b - a, "n_windows": b - a})
    return out


MATCHES = "row_key binary, doc_id long, hash long, at int, slots array<long>, lead array<long>, tail array<long>"


def _matcher(hashes: dict[tuple[int, int], np.ndarray]):
    """Windows of documents whose hash is among the block's (sorted, by kind and window size)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame):
                texts, ids, keys = part["text"].tolist(), part["doc_id"].to_numpy(), part["row_key"].tolist()
                read = {}
                for kind, n in hashes:
                    if kind not in read:
                        if kind == LITERAL:
                            (tokens, first), slot, parts = literal(texts), None, None
                        else:
                            tokens, slot, first, parts = (folded if kind == FOLDED else canonical)(texts)
                        read[kind] = tokens, slot, first, parts, np.repeat(np.arange(len(part)), np.diff(first))
                for (kind, n), known in hashes.items():
                    tokens, slot, first, parts, doc = read[kind]
                    found = windows(tokens, n, kind)
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hit = np.flatnonzero((known[at] == found) & (doc[: len(found)] == doc[n - 1 :]))
                    if not len(hit):
                        continue
                    d = doc[hit]
                    none = np.zeros(0, np.int64)
                    slots, lead, tail = [none] * len(hit), [none] * len(hit), [none] * len(hit)
                    if kind != LITERAL:
                        slots = [slot[k : k + n].view(np.int64) for k in hit]
                        # values that the first and the last slot may have at the border of an item; empty for other words
                        lead, tail = ([parts(k, side) if slot[k] else none for k in (hit + (n - 1) * side).tolist()] for side in (0, 1))
                    yield pd.DataFrame({"row_key": [keys[k] for k in d], "doc_id": ids[d], "hash": found[hit].view(np.int64), "at": (hit - first[d]).astype("int32"), "slots": slots, "lead": lead, "tail": tail})

    return run


def consistent(hits: list[dict]) -> list[int]:
    """Positions of the item's windows that count, of the template matches of one alignment."""
    # item's value -> values of the document, and what is possible at the item's borders
    inner: dict[int, set[int]] = {}
    border: dict[int, list[set[int]]] = {}
    slots = []
    for x in hits:
        own = []
        for k, (i, d) in enumerate(zip(x["item_slots"], x["slots"], strict=True)):
            if i == 0 or d == 0:
                continue
            possible = {d}
            if k == 0 and x["item_at"] == 0:
                possible |= set(x["lead"])
            if k == len(x["slots"]) - 1 and x["last"]:
                possible |= set(x["tail"])
            own.append((i, possible))
            if len(possible) > 1:
                border.setdefault(i, []).append(possible)
            else:
                inner.setdefault(i, set()).add(d)
        slots.append(own)
    bad = {i for i, d in inner.items() if len(d) > 1}
    # two values of the item that the document does not tell apart
    owners: dict[int, set[int]] = {}
    for i, ds in inner.items():
        for d in ds:
            owners.setdefault(d, set()).add(i)
    bad |= {i for d, own in owners.items() if len(own) > 1 for i in own if i != d}
    bad |= {i for i, ps in border.items() if not set.intersection(*ps, *([inner[i]] if i in inner else []))}
    return [x["item_at"] for x, own in zip(hits, slots, strict=True) if all(i not in bad or i in possible for i, possible in own)]


def covered_words(hits: list[dict]) -> tuple[list[int], bool]:
    """Positions of the item's words in the literal matches of one alignment, and whether RUN of them follow one another."""
    size = len(hits) and hits[0]["size"]
    at = np.unique([x["item_at"] for x in hits])
    words = np.unique((at[:, None] + np.arange(size)).ravel())
    # windows that follow one another, one position apart, are a run of words
    breaks = np.flatnonzero(np.diff(at) != 1)
    longest = np.diff(np.concatenate(([-1], breaks, [len(at) - 1]))).max() + size - 1
    return words.tolist(), bool(longest >= RUN)


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        done = [covered_words(hits) if kind == LITERAL else (consistent(hits), False) for hits, kind in zip(frame["hits"], frame["kind"], strict=True)]
        frame["covered"], frame["run"] = [c for c, _ in done], [r for _, r in done]
        yield frame.drop(columns="hits")


def matches(docs: DataFrame, rows: list[dict]) -> DataFrame:
    """(row_key, doc_id, item, coverage) of every item found in a document, for one block of benchmark windows."""
    spark = docs.sparkSession
    hashes = {kind: np.unique(np.array([r["hash"] for r in rows if (r["kind"], r["size"]) == kind], dtype=np.int64).view(np.uint64)) for kind in sorted({(r["kind"], r["size"]) for r in rows})}
    block = F.broadcast(spark.createDataFrame([(r["hash"], r["item"], r["item_id"], r["kind"], r["at"], r["slots"], r["size"], r["last"], r["n_windows"]) for r in rows], "hash long, item long, item_id long, kind int, item_at int, item_slots array<long>, size int, last boolean, n_windows int"))
    hits = docs.mapInPandas(_matcher(hashes), MATCHES)
    joined_ = hits.join(block, "hash").withColumn("shift", F.col("at") - F.col("item_at"))
    key = ["row_key", "item", "item_id", "kind", "n_windows"]
    aligned = joined_.groupBy(*key, "shift").agg(F.collect_list(F.struct("item_at", "size", "last", "item_slots", "slots", "lead", "tail")).alias("hits"))
    aligned = aligned.drop("shift").mapInPandas(_aligned, "row_key binary, item long, item_id long, kind int, n_windows int, covered array<int>, run boolean")
    found = aligned.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"), F.max("run").alias("run"))
    return found.withColumn("coverage", F.col("n") / F.col("n_windows")).where((F.col("coverage") >= COVERAGE) | F.col("run")).select("row_key", "item_id", "coverage")


def _keyed(docs: DataFrame, name: str = "row_key") -> DataFrame:
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256)
    return docs.withColumn(name, F.unhex(key))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """row_key, items (sorted ids) and coverage of every contaminated row of docs (with row_key)."""
    spark = docs.sparkSession
    own = docs.select("row_key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, block = [], []

    def flush() -> None:
        rows = item_windows([(k, i, t) for k, (i, t) in enumerate(block)])
        if rows:
            parts.append(matches(own, rows))
        block.clear()

    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL").distinct().toLocalIterator():
        block.append((r["i"] if r["i"] is not None else -1, r["t"]))
        size += len(r["t"]) + 2
        if size >= block_windows:
            flush()
            size = 0
    flush()
    if not parts:
        return spark.createDataFrame([], "row_key binary, items array<long>, coverage double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out.groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage")), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, contaminated, n_items, items, coverage."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = keyed.select("doc_id", "row_key").join(sized(contaminated(keyed, benchmark)), "row_key", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs in which no benchmark item is found."""
    keyed = _keyed(docs, "key_of_row_")
    found = contaminated(keyed.select(F.col("key_of_row_").alias("row_key"), "doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("row_key").alias("key_of_row_"))
    return keyed.join(sized(found), "key_of_row_", "left_anti").select(*docs.columns)
