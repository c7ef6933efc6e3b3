"""Quality, toxicity, language, decontamination, joins and dedup against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajscope.llm import decontaminate, language, ngram_join, quality, suffix_dedup, toxicity
from trajscope.llm.common import word_hashes
from trajscope.llm.components import connected_components

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, t string, row_key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "x " * 30, "a b c d e f g h\n" * 4, "é" * 300, "word " * 3000, "A\x00B C \U0001f600 ﬁ", "\n\n#$% |<>\n"]


def frame(spark, texts):
    """Rows with nulls, repeats and columns whose names clash with the operators' own."""
    rows = [(k, t, None, "s", None, "x", "y", "z") for k, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [r["text"] for r in docs.select("text").collect()]


def test_word_hashes_follow_the_words():
    h, cut = word_hashes(["a b a", None, "b  c\n", ""])
    assert cut.tolist() == [0, 3, 3, 5, 5]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def thue_morse(doublings):
    """A word over a and b, and its complement: equal under every polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_of_strings_that_cancel(spark):
    x, y = thue_morse(10)
    h, _ = word_hashes([x, y, x])
    assert h[0] != h[1] and h[0] == h[2]
    assert quality.features_of([f"{x} z\n{y} z"])["n_dup_lines"].tolist() == [0]
    df = spark.createDataFrame([(0, x), (1, y), (2, x)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()} == {0: 0, 1: 1, 2: 0}
    long_ = [*thue_morse(12), "q" + thue_morse(12)[1]]
    df = spark.createDataFrame(list(enumerate(long_)), "doc_id long, text string")
    assert sorted(tuple(r) for r in suffix_dedup.suffix_dedup(df).collect()) == brute_cut(list(enumerate(long_)))


def brute_quality(text):
    text = text or ""
    words, places, covered = WORD.findall(text), {}, set()
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    for found in places.values():
        if len(found) > 1:
            for k in found:
                covered.update(range(k, k + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_counts(spark, docs, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(tuple(r) for r in quality.quality_rules(docs).select(*names).collect())
    assert got == sorted(map(brute_quality, texts))
    odd = frame(spark, ODD)
    got = sorted(tuple(r) for r in quality.quality_rules(odd).select(*names).collect())
    assert got == sorted(map(brute_quality, [*ODD, ODD[0], "no id here"]))


def test_quality_em_finds_the_accuracies():
    draw = np.random.default_rng(1)
    good = draw.random(20000) < 0.7
    k = len(quality.RULES)
    accuracy = np.linspace(0.6, 0.95, k)
    right = draw.random((20000, k)) < accuracy
    abstain = draw.random((20000, k)) < 0.3
    vote = np.where(abstain, 1, np.where(right == good[:, None], 2, 0))
    pattern = (vote * 3 ** np.arange(k)).sum(1)
    prior, table, posterior = quality.fit(dict(Counter(pattern.tolist())))
    assert abs(prior - 0.7) < 0.03
    assert np.abs(table[:, 0, 2] - accuracy).max() < 0.04
    assert np.mean((np.array([posterior[p] for p in pattern.tolist()]) >= 0.5) == good) > 0.93


def test_quality_of_nothing(spark):
    assert quality.quality_rules(frame(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("column", ["kept", "base_failed"])
def test_quality_keeps_clean_documents(spark, docs, column):
    rows = quality.quality_rules(docs).join(spark.read.parquet(f"{DIR}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    got = rows.where("label = 1 AND n_words >= 20").agg(F.avg(F.col(column).cast("int"))).first()[0]
    assert got > 0.95 if column == "kept" else got < 0.05


def test_quality_drops_low_documents(spark):
    rows = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    got = {r["label"]: r["kept"] for r in rows.where("NOT base_failed").groupBy("label").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[1] >= 0.95 and got[0] <= 0.1


def brute_kept(votes, decided):
    """Posterior of each document, with the estimate made one document at a time; votes are 0 bad, 1 none, 2 good."""
    rest = [v for v, d in zip(votes, decided) if not d]
    pull, expected = max(1.0, 0.01 * len(rest)), [{0: 0.02, 2: 0.98}, {0: 0.3, 2: 0.7}]
    share, tables = 0.8, [[dict(e) for e in expected] for _ in votes[0]]

    def good(vote):
        odds = share / (1 - share)
        for t, v in zip(tables, vote):
            odds *= t[0][v] / t[1][v] if v != 1 else 1
        return odds / (1 + odds)

    for _ in range(60):
        weight = [good(v) for v in rest]
        share = (sum(weight) + pull * 0.8) / (len(rest) + pull)
        for k, t in enumerate(tables):
            for c in (0, 1):
                n = {x: pull * expected[c][x] + sum(w if c == 0 else 1 - w for w, v in zip(weight, rest) if v[k] == x) for x in (0, 2)}
                t[c] = {x: m / (n[0] + n[2]) for x, m in n.items()}
    return [good(v) for v in votes]


def test_quality_verdict_by_brute_force(spark, docs):
    rows = [r.asDict() for r in quality.quality_rules(docs).collect()]
    decided = [r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"] for r in rows]
    patterns = [[r["pattern"] // 3**k % 3 for k in range(len(quality.RULES))] for r in rows]
    for r, d, p in zip(rows, decided, brute_kept(patterns, decided), strict=True):
        assert r["quality"] == pytest.approx(p, abs=1e-4) and r["kept"] == (not d and p >= 0.5)
    con = duckdb.connect()
    con.register("rows", pd.DataFrame(rows))
    for k, (bad, good) in enumerate(quality.RULES.values()):
        wanted = con.sql(f"SELECT doc_id, CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END AS v FROM rows").df()
        assert dict(wanted.itertuples(index=False)) == {r["doc_id"]: v[k] for r, v in zip(rows, patterns)}


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit(toxicity.training_rows(docs, labels.where("doc_id % 3 <> 0")))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    bad = got["label"] == 1
    assert got[bad]["toxic"].mean() >= 0.9 and 1 - got[~bad]["toxic"].mean() >= 0.95
    for lang in ("en", "de", "fr", "es"):
        own = got["lang"] == lang
        assert got[bad & own]["toxic"].mean() >= 0.75 and 1 - got[~bad & own]["toxic"].mean() >= 0.9, lang
    assert np.all(np.diff(model.theta) >= 0) and ((got["severity"] >= 0) & (got["severity"] <= 3)).all()
    assert got[bad]["severity"].mean() > got[~bad]["severity"].mean() + 0.5


def test_toxicity_scores_by_brute_force(spark, docs):
    """Severity, grade and verdict from the formula, with one document and one feature at a time."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{DIR}/labels.parquet")))
    weight = dict(zip(model.known.tolist(), model.weights.tolist(), strict=True))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-1: "", -2: "idiot " * 70_000}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in toxicity.score(rows, model).collect():
        count = Counter()
        for word in re.findall(rb"[a-z0-9\x80-\xff]+", (texts[r["doc_id"]] or "").translate(lower).encode()):
            whole, _, stem, _ = toxicity.features_of([word.decode("utf-8")])
            count.update([*whole.tolist(), *stem.tolist()])
        score = sum(weight.get(f, 0) * np.log2(1 + n) for f, n in count.items())
        p = [1 / (1 + np.exp(-(score - t))) for t in model.theta]
        assert r["severity"] == pytest.approx(sum(p)) and r["grade"] == sum(x >= 0.5 for x in p) and r["toxic"] == (p[0] >= model.cut)


def test_toxicity_has_no_steps():
    """One more toxic row here or there changes the cut and what is learnt by little: the same documents are caught."""
    draw = np.random.default_rng(1)
    texts = [(t, " ".join([*(f"w{x}" for x in draw.integers(0, 4000, 60)), *(["vile"] * 2 + ["slur"] if t else ["kind"])])) for t in [1] * 140 + [0] * 400]

    def rows(n):
        own = [x for x in texts if x[0]][:n] + [x for x in texts if not x[0]]
        out = []
        for k, (t, text) in enumerate(own):
            _, feature, count = toxicity.counts_of([text])
            order = np.argsort(feature)
            out.append({"doc_id": k, "toxic": t, "sketch": b"", "words": feature[order].astype("<u8").tobytes(), "counts": count[order].astype("<u4").tobytes()})
        return out

    cuts = {}
    for n in (29, 30, 31, 99, 100, 101):
        model = toxicity.fit(rows(n), rounds=150)
        p = model.at_least([t for _, t in texts])[:, 0] >= model.cut
        assert p[:140].mean() > 0.99 and p[140:].mean() < 0.01, n
        cuts[n] = model.cut
    assert abs(cuts[29] - cuts[31]) < 0.25 and abs(cuts[99] - cuts[101]) < 0.25


def test_toxicity_learns_from_one_of_each_family():
    draw = np.random.default_rng(3)
    base = [f"w{k}" for k in draw.integers(0, 900, 200)]
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 200, 10)] + [" ".join(f"v{k}" for k in draw.integers(0, 900, 200)) for _ in range(5)] + ["", "a b"]
    rows = [{"doc_id": k, "toxic": 1, "sketch": s.tobytes(), "words": b"", "counts": b""} for k, s in enumerate(toxicity.sketches(texts))]
    assert [r["doc_id"] for r in toxicity.one_of_each(rows)] == [0, 20, 21, 22, 23, 24, 25, 26]


def test_language_gradients():
    draw = np.random.default_rng(0)
    model = language.ByteGRU.start(["a", "b"])
    x, mask, y = draw.integers(0, 256, (6, 4)), np.ones((6, 4), np.float32), np.array([0, 1, 0, 1])
    mask[4:, 0] = 0

    def loss():
        p = model.positions(x)[:, np.arange(4), y]
        return float(-(np.log(p) * mask).sum() / mask.sum())

    g = model.gradients(x, mask, y)
    for name in ("V", "Wf", "Uf", "Ub", "ab", "bf", "E"):
        p = model.p[name] = model.p[name].astype(np.float64)
        at = tuple(draw.integers(0, n) for n in p.shape) if name != "E" else (int(x[0, 0]), 0)
        keep = p[at]
        p[at] = keep + 1e-4
        high = loss()
        p[at] = keep - 1e-4
        low = loss()
        p[at] = keep
        assert (high - low) / 2e-4 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4), name


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.train(language.training_rows(docs, 60))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_language_edges(spark):
    odd = frame(spark, ODD)
    got = language.identify(odd, language.train(language.training_rows(odd))).toPandas()
    assert (got["lang_pred"] == "und").all() and (got["score"] == 0).all()
    model = language.train([("en", b"the word"), ("en", b"of it")])
    names = language.identify(odd, model).toPandas().set_index("doc_id")["lang_pred"]
    assert names[3] == "en" and names[9] == "und" and names[1] == "und"
    assert language.identify(odd.limit(0), model).count() == 0


ITEM = "Maria has 12 kg of red apples and gives 3 kg to her friend John before the long trip"
CASES = [
    ("intro words here. " + ITEM + " and more", True),
    ("tomorrow Peter has 45 lb of red apples and gives 7 lb to her friend Ann before the long trip today", True),
    ("Peter has 45 lb of red apples and gives 7 oz to her friend Ann before the long trip", False),  # kg stands for two units
    ("nothing of the kind is said in this text about apples", False),
    (None, False),
    ("", False),
]


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination_of_parameters(spark, block):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "What is the capital city of that large and cold northern country?"), (4, "What is the capital city of that large and cold northern country?")], "item_id long, text string")
    docs = frame(spark, [t for t, _ in CASES]).withColumn("row_key", F.lit(b"x"))
    keyed = decontaminate._keyed(docs)
    found = {bytes(r["row_key"]) for r in decontaminate.contaminated(keyed, bench, block).collect()}
    got = {r["text"]: bytes(r["row_key"]) in found for r in keyed.collect()}
    assert {t: got[t] for t, _ in CASES} == dict(CASES)


def test_decontamination_of_the_tables(spark, docs, texts):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = [re.findall(r"\w+", r["text"].lower()) for r in bench.collect()]
    wanted = sum(any(" " + " ".join(i) + " " in " " + " ".join(re.findall(r"\w+", t.lower())) + " " for i in items) for t in texts)
    got = decontaminate.decontaminate(docs, bench)
    assert got.where("contaminated").count() == wanted and got.count() == len(texts)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def _contaminated(spark, item, texts):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(docs, bench).collect()}
    return [got[k] for k in range(len(texts))]


PROSE = "The old mill stands by the river and grinds corn for the village. Every autumn Étienne brings forty sacks to the miller. His wife Anna counts the coins before they leave."


def test_decontamination_is_case_blind(spark):
    around = "nothing here {} nor there"
    assert _contaminated(spark, PROSE, [around.format(t) for t in (PROSE, PROSE.upper(), PROSE.lower(), PROSE.title(), "some other words")]) == [True] * 4 + [False]


def test_decontamination_at_the_border_of_a_passage(spark):
    item = "Maria has 12 red apples and gives 3 of them away so that Maria has only 9 left at home"
    other = item.replace("Maria", "Peter").replace("12", "40").replace("3", "7").replace("9", "33")
    mixed = other.replace("that Peter", "that Paul")
    # a capital before the passage, and after one that ends with a name
    ends = "the red apples of Maria lie on the table of the hall until they are eaten by Maria"
    texts = ["Question: " + item, "Question: " + other, "Question: " + mixed, other, mixed]
    assert _contaminated(spark, item, texts) == [True, True, False, True, False]
    assert _contaminated(spark, ends, [ends.replace("Maria", "Peter") + " Answer none", ends.replace("Maria", "Peter Smith") + " Answer none"]) == [True, True]


def test_decontamination_wants_values_one_to_one(spark):
    item = "Tom has 12 red apples in his basket today while Ann has 3 green pears in her bag over there now"
    texts = [item.replace("Ann", "Sue").replace("3", "8"), item.replace("Tom", "Jim").replace("Ann", "Jim").replace("12", "5").replace("3", "5")]
    assert _contaminated(spark, item, texts) == [True, False]


def test_decontamination_finds_other_numbers_in_any_case(spark):
    item = "In the year 1987 the mill of Ashford ground 412 sacks of corn and sold 96 of them at the market of the town"
    changed = item.replace("1987", "2003").replace("412", "388").replace("96", "71")
    assert _contaminated(spark, item, [changed.lower(), changed.upper(), changed.title(), "nothing of that kind"]) == [True, True, True, False]


def test_decontamination_drops_contradicting_windows_only(spark):
    item = "The cat of 3 men sat on a mat. The dog ate 12 bones on day 4 and slept until 5 men came at noon to see what was going on there"
    changed = item.replace("The dog", "Some dog").replace("12", "13").replace("4", "6").replace("5", "8")
    assert _contaminated(spark, item, [changed]) == [True]


def test_decontamination_finds_parts_of_long_items(spark):
    draw = np.random.default_rng(11)
    words = ["".join(map(chr, draw.integers(97, 123, 7))) for _ in range(400)]
    replaced = [w if k % 12 else "other" for k, w in enumerate(words)]
    part = lambda a, n: " ".join(["before", *words[a : a + n], "after"])
    texts = [part(100, 150), " ".join(replaced), part(30, 13), part(387, 13), part(30, 12), " ".join(words[k] for k in range(0, 400, 2))]
    assert _contaminated(spark, " ".join(words), texts) == [True, True, True, True, False, False]


def brute_components(rows, n, threshold):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def _variants(seed, n_docs=60, families=4, words=80):
    """Families of near copies around the threshold, with chains, and strangers that share a passage."""
    draw = np.random.default_rng(seed)
    word = lambda: "w" + str(draw.integers(0, 5000))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(words)]
        for _ in range(n_docs // families):
            copy = list(base)
            for at in draw.integers(0, words, draw.integers(0, 4)):
                copy[at] = word()
            out.append(" ".join(copy))
            if draw.random() < 0.4:
                base = copy
    out += [" ".join([*(word() for _ in range(40)), *passage]) for _ in range(10)]
    return out + ["one two", "One  Two", "three", None, "", " "]


@pytest.mark.parametrize("seed,tile", [(1, 512), (2, 5)])
def test_join_against_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    texts = _variants(seed)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, node string, n int").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(list(enumerate(texts)), 4, 85)


def test_join_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 5)
    texts = _variants(4, 30, 2, 300)
    texts += texts[:3] + [texts[5].upper()]
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for t in texts)]
    link = lambda x, y: bool(x & y) and 100 * len(x & y) >= 85 * len(x | y)
    wanted = {k: sum(link(s, t) for j, t in enumerate(sets) if j != k) for k, s in enumerate(sets)}
    firsts = sorted({s: k for k, s in reversed(list(enumerate(sets)))}.values())
    pairs = sorted((a, b) for a in firsts for b in firsts if a < b and link(sets[a], sets[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_components(df).collect()} == wanted
    assert sorted(tuple(r) for r in ngram_join.jaccard_links(df).collect()) == pairs and len(pairs) > len(firsts)


def test_join_edges(spark):
    odd = frame(spark, ODD)
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD) + 2
    assert {r["component_id"] for r in got if r["doc_id"] == 0} == {0}
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0
    kept = ngram_join.keep_one(spark, odd.union(odd.where("doc_id = 7").withColumn("doc_id", F.lit(99).cast("long"))), "")
    assert kept.columns == odd.columns and kept.where("doc_id = 99").count() == 0 and kept.where("doc_id = 0").count() == 2


def test_rows_of_one_id_are_one_document(spark):
    """Two texts under one id: what either reaches, both do."""
    a, b = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    texts = [(1, a), (5, a + " x"), (5, b), (9, b + " y"), (12, "alone " * 9), (None, a)]
    got = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (5, 1), (9, 1), (12, 12), (None, 1)} and len(got) == 6


def test_rtree_bound_loses_nothing():
    draw = np.random.default_rng(3)
    sets = [set(draw.integers(0, 400, 120).tolist()) for _ in range(5)]
    sets += [s ^ set(draw.integers(0, 400, 6).tolist()) for s in sets for _ in range(8)]
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    points = ngram_join._counts([ngram_join._vector(a) for a in arrays])
    sizes = np.array([len(s) for s in sets])
    x, y = ngram_join.rtree_pairs(points, sizes, np.arange(len(sets)), 85)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    wanted = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert wanted and wanted <= got and len(got) < len(sets) ** 2 / 2


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_cut(rows, length=200):
    data = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for k, b in data:
        mark = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                mark[p] += 1
                mark[p + length] -= 1
        cut = np.cumsum(mark)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cut])
        out.append((k, len(b), int(cut.sum()), int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_bucket,piece", [(300_000, 1 << 18), (40, 64)])
def test_dedup_against_brute_force(spark, docs, monkeypatch, rows_per_bucket, piece):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", rows_per_bucket)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    draw = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    passage = word(260)
    odd = [*ODD, *(word(int(draw.integers(0, 90))) + passage + word(50) for _ in range(40)), passage[:199], passage[:200], passage[30:230] + "x" + passage[30:229], word(500), "ab" * 500]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 40").collect()] + [(1000 + k, t) for k, t in enumerate(odd)] + [(1000, None), (None, "q" * 250)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, t string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.suffix_dedup(df).collect()), key=str)
    assert got == brute_cut(rows)
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_dedup_of_a_long_text():
    """Memory does not grow with a text: 20 MB in pieces, and what lies across their ends is found."""
    import tracemalloc

    draw = np.random.default_rng(6)
    text = draw.integers(97, 123, 20_000_000).astype(np.uint8)
    text[9_000_000:9_000_500] = text[262_000:262_500]
    text = text.tobytes().decode()
    tracemalloc.start()
    most, starts, seen = 0, [], 0
    for lead, rest, _, at, more, anchor in suffix_dedup.stretches([text]):
        starts.append(np.stack([lead[:, 0], rest, at, more, anchor]))
        seen += int((more + 1).sum())
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert seen == 20_000_000 - 199 and most < 200 << 20
    lead, _, at, more, anchor = np.concatenate(starts, axis=1)
    near = (at + more >= 9_000_000) & (at <= 9_000_300)
    assert np.isin(anchor[near][2:-2] - 9_000_000 + 262_000, anchor).all()


def test_dedup_of_repeated_rows(spark):
    text = "z" + "".join(map(chr, np.random.default_rng(1).integers(97, 123, 400)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text[:150])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect())
    assert got == [(1, 401), (1, 401), (2, 0)]


def test_tokens_sort_as_bytes():
    draw = np.random.default_rng(2)
    data = draw.choice(np.array([0, 97, 98, 200, 255], dtype=np.uint8), 400)
    at = np.arange(360)
    rows = suffix_dedup.tokens(data, at, suffix_dedup.ANCHOR)
    order = suffix_dedup.multikey_quicksort([rows[:, k] for k in range(suffix_dedup.TOKENS)])
    grams = [data[k : k + suffix_dedup.ANCHOR].tobytes() for k in at]
    assert [grams[k] for k in order] == sorted(grams)
    assert (suffix_dedup.tokens(data, at, 5)[:, 1:] == np.iinfo(np.int64).min).all()


def test_multikey_quicksort():
    draw = np.random.default_rng(2)
    columns = [draw.integers(0, 4, 300), draw.integers(0, 4, 300), draw.integers(0, 1000, 300)]
    order = suffix_dedup.multikey_quicksort(columns)
    rows = pd.DataFrame(dict(enumerate(columns)))
    assert rows.iloc[order].to_numpy().tolist() == rows.sort_values([0, 1, 2]).to_numpy().tolist()
