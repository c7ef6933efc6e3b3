"""Quality rules under weak supervision.

Each rule votes good or bad on a document, or abstains. Expectation-maximisation
over the counts of vote patterns estimates how often each rule votes bad in
either class, and the share of good documents. A document is kept when its
posterior probability of being good is at least THRESHOLD and no base rule failed
it; one bad vote of an unreliable rule does not reject it.

The documents that the base rules reject are decided, so the estimate is made on
the others, all of them. The classes are anchored by what a vote means: the
estimates start from, and are drawn by ANCHOR of the documents' weight to, the
shares BAD_VOTES of bad votes in the two classes. Rules count as independent
within a class. Two that see one defect (`symbols` and `plain_words`) agree on
documents that have it, which is what tells the estimate that both are reliable;
the posterior is then sharper than the evidence, of the same sign.

There are at most 3**len(RULES) patterns whatever the size of the corpus, so the
counts that reach the driver are bounded; they cover all documents.

Defined cases: null text counts as empty (no words, base_failed); repeated rows
each get a row, null ids as well; an empty table gives an empty result; equal
patterns have equal posteriors, so ties need no order; very long texts count
whole; columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, SPACES, joined, materialize, prefix_sums, scramble, span_hashes, spans_of_words, table, text_chunks, window_hashes

WINDOW = 8
THRESHOLD = 0.5
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_digits long, n_letters long, n_lines long, n_ended_lines long, n_alnum_words long"

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[48:58] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\":;)")] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def features_of(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of FEATURES (without doc_id) for each text."""
    data, offsets = joined(texts)
    n = len(texts)
    per = lambda hits: np.add.reduceat(hits.astype(np.int64), offsets[:-1]) if n else np.zeros(0, np.int64)
    start, end = spans_of_words(data)
    first = np.searchsorted(start, offsets)
    text_of = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first)}
    code_point, space = (data & 0xC0) != 0x80, SPACES[data]
    out["word_chars"] = per(code_point & ~space)
    for name, kind in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_digits", _DIGITS)):
        out[name] = per(kind[data])
    out["n_letters"] = per(code_point & ~NOT_ALNUM[data]) - out["n_digits"]
    sums = prefix_sums(data)

    stops = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    word_starts = np.zeros(len(data) + 1, dtype=np.int64)
    word_starts[1:] = np.cumsum(~space)
    worded = word_starts[stops] > word_starts[begins]
    begins, stops = begins[worded], stops[worded]
    line_of = np.searchsorted(offsets, begins, side="right") - 1
    keys = scramble(span_hashes(sums, begins, stops) + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_lines"] = np.bincount(line_of, minlength=n)
    out["n_dup_lines"] = np.bincount(line_of[later], minlength=n)
    out["n_ended_lines"] = np.bincount(line_of[_ENDS[data[np.maximum(stops - 1, 0)]]], minlength=n)

    words = span_hashes(sums, start, end)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= WINDOW:
        windows = window_hashes(words, WINDOW)
        inside = text_of[: len(windows)] == text_of[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        hit = at[_repeated(scramble(windows[at] + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + WINDOW, 1)
    out["n_repeat_words"] = np.bincount(text_of[np.cumsum(covered[:-1]) > 0], minlength=n)
    plain = ~(_SYMBOLS[data[np.maximum(end - 1, 0)]]) & ~NOT_ALNUM[data[start]] if len(start) else np.zeros(0, bool)
    out["n_alnum_words"] = np.bincount(text_of[plain], minlength=n)
    return out


_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in text_chunks(frame):
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()} | features_of(part["text"].tolist()))[_NAMES]


def features(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_features, FEATURES)


#: name -> (bad when, good when) over the columns of FEATURES; in between the rule abstains.
RULES = {
    "length": ("n_words < 20", "n_words >= 40"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols < n_words"),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
    "repeats": ("10 * n_repeat_words > 2 * n_words", "20 * n_repeat_words < n_words AND n_words >= 16"),
    "case": ("10 * n_upper > 4 * n_letters", "10 * n_upper < n_letters AND n_letters > 0"),
    "digits": ("10 * n_digits > 2 * word_chars", "50 * n_digits < word_chars"),
    "plain_words": ("10 * n_alnum_words < 7 * n_words", "10 * n_alnum_words >= 9 * n_words AND n_words > 0"),
    "line_ends": ("n_lines >= 3 AND 10 * n_ended_lines < n_lines", "2 * n_ended_lines >= n_lines AND n_lines > 0"),
}


def votes(counted: DataFrame) -> DataFrame:
    digits = [F.when(F.expr(bad), F.lit(0)).when(F.expr(good), F.lit(2)).otherwise(F.lit(1)) for bad, good in RULES.values()]
    pattern = sum((d * 3**k for k, d in enumerate(digits)), F.lit(0))
    return counted.withColumn("pattern", pattern.cast("int"))


#: What is expected beforehand: the share of good documents, the shares of bad votes among good and bad documents, and the weight of that.
GOOD_SHARE = 0.8
BAD_VOTES = np.array([0.02, 0.3])
ANCHOR = 0.01


def _one_hot(keys: np.ndarray) -> np.ndarray:
    """(pattern, rule, vote) with votes 0 bad, 1 none and 2 good; an abstention says nothing."""
    out = np.eye(3)[(keys[:, None] // 3 ** np.arange(len(RULES))) % 3]
    out[:, :, 1] = 0
    return out


def posteriors(keys: np.ndarray, prior: float, table_: np.ndarray) -> np.ndarray:
    """P(good) of each pattern."""
    score = np.log(prior) - np.log1p(-prior) + np.einsum("pkv,kv->p", _one_hot(keys), np.log(table_[:, 0] / table_[:, 1]))
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def fit(patterns: dict[int, int], rounds: int = 500) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good documents, P(vote | class, no abstention) as (rule, class, vote) with class 0 good, posterior of each pattern."""
    keys = np.array(sorted(patterns), dtype=np.int64)
    weight = np.array([patterns[x] for x in keys], dtype=float)
    one_hot, total = _one_hot(keys), weight.sum()
    pull = max(1.0, ANCHOR * total)
    expected = np.stack([BAD_VOTES, np.ones(2), 1 - BAD_VOTES], 1)
    prior, table_ = GOOD_SHARE, np.tile(expected, (len(RULES), 1, 1))
    posterior = posteriors(keys, prior, table_)
    for _ in range(rounds):
        mass = weight * posterior, weight * (1 - posterior)
        prior = (mass[0].sum() + pull * GOOD_SHARE) / (total + pull)
        for c, m in enumerate(mass):
            table_[:, c, :] = np.einsum("p,pkv->kv", m, one_hot) + pull * expected[c] * [1, 0, 1]
        table_ /= table_.sum(2, keepdims=True)
        table_[:, :, 1] = 1
        new = posteriors(keys, prior, table_)
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return float(prior), table_, dict(zip(keys.tolist(), posterior.tolist(), strict=True))


def quality_rules(docs: DataFrame) -> DataFrame:
    """FEATURES, base_failed, quality (posterior of good) and kept for each row of docs."""
    spark = docs.sparkSession
    base_failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    counted = materialize(votes(features(docs)).withColumn("base_failed", base_failed), "quality")
    counts = counted.groupBy("pattern").agg(F.count_if(~F.col("base_failed")).alias("n")).collect()  # 3**len(RULES) rows at most
    prior, table_, _ = fit({r["pattern"]: r["n"] for r in counts})
    keys = np.array([r["pattern"] for r in counts], dtype=np.int64)
    quality = F.broadcast(spark.createDataFrame(list(zip(keys.tolist(), posteriors(keys, prior, table_).tolist(), strict=True)), "pattern int, quality double"))
    return counted.join(quality, "pattern", "left").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
