"""Toxicity as a cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w.x - theta_k), theta_1 < theta_2 < theta_3: the grades
share the weights w. x holds log2(1 + count) of the model's features: lower-case
runs of letters and digits, and the first STEM bytes of longer ones (so words
with one stem are learnt together). The proximal step of an L1 penalty keeps w
sparse. Severity is the expected grade, the sum of P(grade >= k).

The labels say only toxic or not. Grade 0 is not toxic; toxic documents get the
grades 1 to 3 by thirds of the sum of x over features that go with the label, the
same quantity that the regression scores.

The fit uses a bounded sample, a documented parameter: per label the
SAMPLE_PER_LABEL documents with the smallest hash of their id. Of each family of
near copies in it one document is learnt from; else a family's own words would
look telling. A feature is learnt if enough documents have it and its shares
among the labels differ by enough standard errors (SELECTION; FEW_SELECTION if
there are fewer than MANY_LABELS toxic rows) and by a factor of LEAST_RATIO. The cut between toxic and not is the one with the least balanced
error on a third of the sample that the model which sets it has not seen; with
fewer than CUT_LABELS toxic rows in that third it is 1/2.
Scoring covers every document, whole.

Defined cases: null or empty text has no features, and so the grade that the
intercept gives; null labels or ids are not learnt from; an empty table, or one
label only, gives a model that says "not toxic" everywhere; a document with two
labels is learnt from under both; features that tell equally much are all taken,
so ties need no order; repeated rows each get a row; very long texts count whole;
columns beyond doc_id, text and toxic are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, MIX, NOT_ALNUM, chunk_ranges, joined, prefix_sums, scramble, span_hashes, spans_of_words, table, text_chunks, window_hashes, word_hashes

SAMPLE_PER_LABEL = 3000
#: 0 and three grades of toxic rows. Labels say toxic or not, so grades 1 to 3 are thirds of the rows by the weight of telling features: severity orders documents by how much speaks for the label, not by an outside measure of harm.
GRADES = 4
STEM = 4
LEAST_RATIO = 3.0
LEAST_DOCS = 2
#: A feature's z must reach LEAST_Z, up to one more half as toxic rows get many: chance finds more among many rows' words.
LEAST_Z, MORE_Z, HALF_Z_ROWS = 3.5, 0.5, 25
#: The learnt cut's distance from 1/2 counts half with so many toxic rows held out, and more with more.
HALF_CUT_ROWS = 3
#: A family of near copies shares at least COPY_SKETCHES of SKETCHES smallest shingle hashes.
SKETCHES = 8
COPY_SKETCHES = 3
SCORED = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words, offsets of the texts' words, hashes of the stems, the words that have them)."""
    data, offsets = joined(texts)
    data = LOWER[data]
    start, end = spans_of_words(data, NOT_ALNUM)
    sums = prefix_sums(data)
    long_ = np.flatnonzero(end - start > STEM)
    stems = scramble(span_hashes(sums, start[long_], start[long_] + STEM) + np.uint64(1))
    return span_hashes(sums, start, end), np.searchsorted(start, offsets), stems, long_


def counts_of(texts: list[str | None], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature, count) triples; features are positions in the sorted `known`, or hashes."""
    words, offsets, stems, long_ = features_of(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    row, words = np.concatenate((row, row[long_])), np.concatenate((words, stems))
    if known is not None:
        at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        hit = known[at] == words if len(known) else np.zeros(len(words), bool)
        row, words = row[hit], at[hit].astype(np.uint64)
    order = np.lexsort((words, row))
    row, words = row[order], words[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (words[1:] != words[:-1])
    at = np.flatnonzero(new)
    return row[at], words[at], np.diff(np.append(at, len(row)))


def sketches(texts: list[str | None], n: int = 5) -> np.ndarray:
    """The least of SKETCHES hashes over the n-word shingles (or the words, if fewer) of each text, as (text, sketch); the largest number without words."""
    words, offsets = word_hashes(texts, NOT_ALNUM, lower=True)
    shingles = window_hashes(words, n)
    out = np.full((len(texts), SKETCHES), ~np.uint64(0))
    for k in range(len(texts)):
        a, b = offsets[k], offsets[k + 1]
        own = shingles[a : b - n + 1] if b - a >= n else words[a:b]
        if len(own):
            out[k] = [scramble(own + m).min() for m in MIX[:SKETCHES]]
    return out


def _sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in text_chunks(frame):
            texts = part["text"].tolist()
            row, words, count = counts_of(texts)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "toxic": part["toxic"].to_numpy(), "sketch": [x.astype("<u8").tobytes() for x in sketches(texts)],
                "words": [words[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                "counts": [count[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
            })


def one_of_each(rows: list) -> list:
    """The rows without those that nearly copy an earlier one of the same label."""
    out, seen = [], {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], bytes(r["words"]))):
        places = [(r["toxic"], k, x) for k, x in enumerate(np.frombuffer(r["sketch"], "<u8").tolist()) if x != (1 << 64) - 1]
        shared = Counter(j for p in places for j in seen.get(p, ()))
        if shared and max(shared.values()) >= COPY_SKETCHES:
            continue
        for p in places:
            seen.setdefault(p, []).append(len(out))
        out.append(r)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> list:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for t in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    # rows of one id are of one document: of several texts the one with the least hash counts, so the sample is bounded and the same on every run
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.mapInPandas(_sampled, "doc_id long, toxic int, sketch binary, words binary, counts binary")
    return one_of_each(rows.collect())


class OrdinalModel:
    """known: sorted feature hashes; weights: one for each; theta: the thresholds; cut: P(grade >= 1) from which a document is toxic."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, theta: np.ndarray, cut: float = 0.5):
        self.known, self.weights, self.theta, self.cut = known, weights, theta, cut

    def at_least(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as (text, k)."""
        row, feature, count = counts_of(texts, self.known)
        score = np.bincount(row, self.weights[feature.astype(np.int64)] * np.log2(1 + count), minlength=len(texts))
        return _sigmoid(score[:, None] - self.theta)

    def of_rows(self, rows: list) -> np.ndarray:
        """P(grade >= 1) of training rows."""
        out = np.zeros(len(rows))
        for k, r in enumerate(rows):
            word, count = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["counts"], "<u4")
            at = np.minimum(np.searchsorted(self.known, word), max(len(self.known) - 1, 0))
            hit = self.known[at] == word if len(self.known) else np.zeros(len(word), bool)
            out[k] = self.weights[at[hit]] @ np.log2(1 + count[hit])
        return _sigmoid(out - self.theta[0])


def _never() -> OrdinalModel:
    return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 5.0))


def _fitted(rows: list, rounds: int, l1: float, rate: float, least_docs: int, least_z: float) -> OrdinalModel:
    y = np.array([r["toxic"] for r in rows], dtype=int)
    if len(set(y.tolist())) < 2:
        return _never()
    words = [np.frombuffer(r["words"], "<u8") for r in rows]
    sizes = np.array([len(w) for w in words])
    row, word = np.repeat(np.arange(len(rows)), sizes), np.concatenate(words)
    count = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(float)
    known, feature = np.unique(word, return_inverse=True)
    # the features whose document frequencies differ between the labels
    df = [np.bincount(feature[y[row] == c], minlength=len(known)) for c in (0, 1)]
    n = [(y == c).sum() for c in (0, 1)]
    p = (df[0] + df[1]) / len(y)
    share = [(df[c] + 0.5) / (n[c] + 1) for c in (0, 1)]
    z = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-9)
    ratio = share[1] / share[0]
    able = np.flatnonzero((df[0] + df[1] >= least_docs) & (np.abs(z) >= least_z) & (np.maximum(ratio, 1 / ratio) >= LEAST_RATIO))
    if not len(able):
        return _never()
    place = np.full(len(known), -1)
    place[able] = np.arange(len(able))
    keep = place[feature] >= 0
    row, col, x = row[keep], place[feature[keep]], np.log2(1 + count[keep])
    # grades by thirds of what the toxic documents have of the features that go with the label
    weight = np.bincount(row, x * (z[able] > 0)[col], minlength=len(rows))
    cuts = np.quantile(weight[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (weight > cuts[0]).astype(int) + (weight > cuts[1]), 0)
    # Adam on the likelihood of the grades, then the proximal step of the L1 penalty
    w, theta = np.zeros(len(able)), np.array([0.5, 1.5, 2.5])
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    index = np.arange(len(rows))
    for step in range(1, rounds + 1):
        s = np.bincount(row, w[col] * x, minlength=len(rows))
        c = np.hstack([np.ones((len(rows), 1)), _sigmoid(s[:, None] - theta), np.zeros((len(rows), 1))])
        d = c * (1 - c)
        p = np.maximum(c[index, grade] - c[index, grade + 1], 1e-9)
        up, down = d[index, grade] / p, d[index, grade + 1] / p
        ds = up - down
        g_theta = np.array([(-(up * (grade == k)) + down * (grade + 1 == k)).sum() for k in range(1, GRADES)])
        g = np.append(np.bincount(col, ds[row] * x, minlength=len(w)), g_theta) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, theta = w + move[:-3], np.sort(theta + move[-3:])
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / (np.sqrt(v[:-3] / (1 - 0.999**step)) + 1e-4), 0)
    used = np.flatnonzero(w)
    order = used[np.argsort(known[able][used])]
    return OrdinalModel(known[able][order], w[order], theta)


def balanced_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of p with the least mean error of the two labels."""
    order = np.argsort(p, kind="stable")
    logit = np.log(np.clip(p[order], 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(p[order], 1e-9, 1 - 1e-9))
    y = y[order]
    missed = np.concatenate(([0], np.cumsum(y == 1))) / max(1, (y == 1).sum())
    false = (np.sum(y == 0) - np.concatenate(([0], np.cumsum(y == 0)))) / max(1, (y == 0).sum())
    edge = np.concatenate(([logit[0] - 2], logit, [logit[-1] + 2]))
    gap = np.diff(edge)
    error = np.where(gap > 0, missed + false, np.inf)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    k = best[np.argmax(gap[best])]
    return float(1 / (1 + np.exp(-(edge[k] + edge[k + 1]) / 2)))


def fit(rows: list, rounds: int = 1000, l1: float = 1e-4, rate: float = 0.1) -> OrdinalModel:
    toxic = sum(r["toxic"] for r in rows)
    setting = rounds, l1, rate, LEAST_DOCS, LEAST_Z + MORE_Z * toxic / (toxic + HALF_Z_ROWS)
    model = _fitted(rows, *setting)
    held = [k % 3 == 2 for k in range(len(rows))]
    rest = [r for r, h in zip(rows, held, strict=True) if h]
    y = np.array([r["toxic"] for r in rest])
    if len(model.known) and y.any() and (y == 0).any():
        first = _fitted([r for r, h in zip(rows, held, strict=True) if not h], *setting)
        if len(first.known):
            learnt = balanced_cut(first.of_rows(rest), y)
            trust = y.sum() / (y.sum() + HALF_CUT_ROWS)
            model.cut = float(1 / (1 + (1 / learnt - 1) ** trust))
    return model


def _scorer(model: OrdinalModel):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame):
                p = model.at_least(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "severity": p.sum(1), "p_toxic": p[:, 0], "grade": (p >= 0.5).sum(1).astype("int32"), "toxic": p[:, 0] >= model.cut})

    return run


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """SCORED for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_scorer(model), SCORED)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))


def keep_nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the model does not call toxic, in one pass."""
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in chunk_ranges(texts):
                yield batch.slice(begin, end - begin).filter(pa.array(model.at_least(texts[begin:end])[:, 0] < model.cut))

    return docs.mapInArrow(run, docs.schema)
