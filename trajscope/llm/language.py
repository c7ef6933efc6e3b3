"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of WINDOW bytes (every byte of every text is in one).
Two GRUs read a window forwards and backwards; a softmax over both states labels
every position. The position probabilities of all windows of a document are
averaged; the largest is the label, its average the score.

Training is backpropagation through time with Adam on a bounded sample: per
language the DOCS_PER_LANG documents with the smallest hash of their id, of
each of these up to WINDOWS_PER_DOC windows spread over its whole text. Fold: documents with crc32(id) % 4 = 2 are
held out. lang, source and doc_id are no inputs of a prediction.

Defined cases: null text or text without a letter gives `und` with score 0; with
no labelled document everything is `und`; with one language all is that one;
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined, table, text_chunks

WINDOW = 64
HIDDEN = 8
EMBED = 8
DOCS_PER_LANG = 150
WINDOWS_PER_DOC = 10
HELD_OUT = 2
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
BATCH = 4096


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    """Parameters as a dict of float32 arrays; W* map embeddings, U* map states, for gates z, r and candidate n."""

    def __init__(self, classes: list[str], parameters: dict[str, np.ndarray]):
        self.classes, self.p = classes, parameters

    @staticmethod
    def start(classes: list[str], seed: int = 3) -> ByteGRU:
        g, h, e = np.random.default_rng(seed), HIDDEN, EMBED
        new = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": 0.5 * new(256, e) * 16, "V": new(2 * h, len(classes)), "c": np.zeros(len(classes), np.float32)}
        for d in "fb":
            p |= {f"W{d}": new(e, 3 * h), f"U{d}": new(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32), f"a{d}": np.zeros(h, np.float32)}
        return ByteGRU(classes, p)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, batch, h) of one direction over x (time, batch) bytes, in reading order."""
        h, p = HIDDEN, self.p
        inputs = p["E"] @ p[f"W{d}"] + p[f"b{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(len(x)):
            i, u = inputs[x[t]], state @ p[f"U{d}"]
            gates = _sigmoid(i[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            inner = u[:, 2 * h :] + p[f"a{d}"]
            n = np.tanh(i[:, 2 * h :] + r * inner)
            if keep is not None:
                keep.append((state, z, r, inner, n))
            state = n + z * (state - n)
            out[t] = state
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities (time, batch, class)."""
        both = np.concatenate([self._run(x, "f"), self._run(x[::-1], "b")[::-1]], axis=2)
        s = both @ self.p["V"] + self.p["c"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of every unmasked position, by backpropagation through time."""
        p, h, n_t = self.p, HIDDEN, len(x)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, "f", kept["f"]), self._run(x[::-1], "b", kept["b"])[::-1]], axis=2)
        s = both @ p["V"] + p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        ds = s / s.sum(axis=2, keepdims=True)
        ds[:, np.arange(len(y)), y] -= 1
        ds *= (mask / max(1, mask.sum()))[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"], g["c"] = np.einsum("tbh,tbk->hk", both, ds, optimize=True), ds.sum((0, 1))
        d_both = ds @ p["V"].T
        for d, xs, dh_all in (("f", x, d_both[:, :, :h]), ("b", x[::-1], d_both[::-1, :, h:])):
            dh = np.zeros((x.shape[1], h), np.float32)
            table_ = np.zeros((256, 3 * h), np.float32)
            for t in range(n_t - 1, -1, -1):
                state, z, r, inner, n = kept[d][t]
                dh = dh + dh_all[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                d_in = np.concatenate([dz, dr, dn], axis=1)
                d_u = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"U{d}"] += state.T @ d_u
                g[f"a{d}"] += (dn * r).sum(0)
                g[f"b{d}"] += d_in.sum(0)
                np.add.at(table_, xs[t], d_in)
                dh = dh * z + d_u @ p[f"U{d}"].T
            g["E"] += table_ @ p[f"W{d}"].T
            g[f"W{d}"] += p["E"].T @ table_
        return g


def windows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(WINDOW, n) bytes, mask of real positions, and the text of each window."""
    data, offsets = joined(texts)
    sizes = np.diff(offsets) - 1
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    within = (np.arange(len(text)) - first[text]) * WINDOW
    at = (offsets[:-1][text] + within)[None, :] + np.arange(WINDOW)[:, None]
    mask = (within[None, :] + np.arange(WINDOW)[:, None]) < sizes[text][None, :]
    return np.where(mask, data[np.minimum(at, len(data) - 1)], 32), mask, text


def train(rows: list[tuple[str, bytes]], epochs: int = 9, rate: float = 0.02, seed: int = 11) -> ByteGRU | None:
    """Fit on (lang, window) rows; the result does not depend on their order."""
    rows = sorted(rows)
    classes = sorted({lang for lang, _ in rows})
    if not classes:
        return None
    model = ByteGRU.start(classes)
    if len(classes) == 1:
        return model
    draw = np.random.default_rng(seed)
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b" ") for _, w in rows), np.uint8).reshape(-1, WINDOW).T
    mask = (np.arange(WINDOW)[:, None] < np.array([len(w) for _, w in rows])).astype(np.float32)
    y = np.array([classes.index(lang) for lang, _ in rows])
    m, v, step = {k: 0 * a for k, a in model.p.items()}, {k: 0 * a for k, a in model.p.items()}, 0
    for epoch in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(order), 128):
            part, step = order[at : at + 128], step + 1
            g = model.gradients(x[:, part], mask[:, part], y[part])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k in model.p:
                a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                model.p[k] = (model.p[k] - rate * 0.85**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def predict(model: ByteGRU | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    able = np.array([model is not None and bool(t) and _LETTER.search(t) is not None for t in texts], dtype=bool)
    names, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
    some = np.flatnonzero(able)
    if len(some):
        x, mask, text = windows_of([texts[k] for k in some])
        pooled = np.zeros((len(some), len(model.classes)))
        for at in range(0, len(text), BATCH):
            part = slice(at, at + BATCH)
            p = np.einsum("tbk,tb->bk", model.positions(x[:, part]), mask[:, part].astype(np.float32))
            np.add.at(pooled, text[part], p)
        pooled /= pooled.sum(1, keepdims=True)
        best = pooled.argmax(1)
        names[some] = np.array(model.classes, dtype=object)[best]
        scores[some] = np.clip(pooled[np.arange(len(some)), best], 0, 1)
    return names.tolist(), scores


def _sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            starts = np.arange(0, len(data), WINDOW)
            if len(starts) > WINDOWS_PER_DOC:
                starts = starts[np.linspace(0, len(starts) - 1, WINDOWS_PER_DOC).astype(int)]
            yield pd.DataFrame({"lang": [lang] * len(starts), "window": [data[s : s + WINDOW] for s in starts]})


def training_rows(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> list[tuple[str, bytes]]:
    """The bounded sample; the ranks are found on narrow rows, and only the picked texts are read."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learnable = own.where("length(text) > 0 AND lang IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != HELD_OUT)
    learnable = learnable.withColumn("t", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t"))
    picked = learnable.select("doc_id", "t", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang).drop("rank")
    # an id may have many rows: each of its texts is picked for itself, and once
    texts = learnable.select("doc_id", "t", "lang", "text").join(F.broadcast(picked), ["doc_id", "t", "lang"]).dropDuplicates(["doc_id", "t", "lang"])
    sample = texts.select("lang", "text").mapInPandas(_sampled, "lang string, window binary")
    return [(r["lang"], bytes(r["window"])) for r in sample.collect()]


def _predictor(model: ByteGRU | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame):
                names, scores = predict(model, part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "lang_pred": names, "score": scores})

    return run


def identify(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """PREDICTED for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return own.withColumn("held_out", held).mapInPandas(_predictor(model), PREDICTED)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(training_rows(docs)))
