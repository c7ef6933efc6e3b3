"""run() as a whole against plain Python, on documents with nulls, repeats and columns of clashing names."""

import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from trajscope.llm import pieces, toxicity

SECRET = "q7Zk2mP9xL4vB8nR3tW6yC1d"
EXAMPLE = "AAAA1111BBBB2222CCCC"


def words(draw, n, tag):
    return " ".join(f"{tag}{draw.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, folder = random.Random(11), tmp_path_factory.mktemp("tables")
    rows, labels, item = [], [], " ".join(f"bench{k}" for k in range(40))
    for k in range(60):
        rows.append((k, words(draw, 80, "w"), f"s{k % 5}"))
        labels.append((k, 1, 0))
    for k in range(60, 100):
        rows.append((k, f"you vile slur {words(draw, 60, 'w')} vile slur", f"s{k % 5}"))
        labels.append((k, 0, 1))
    base = words(draw, 90, "c")
    rows += [(200, base, "s1"), (201, base + " tail", "s2"), (202, "head " + base, "s3"), (203, base, "s4")]  # near and exact copies: 200 stays
    rows += [(300, f"{words(draw, 40, 'w')} {item} {words(draw, 40, 'w')}", "s1"), (301, item.upper(), "s2")]  # passages of the benchmark
    rows += [(400, f"password = {SECRET} and {words(draw, 30, 'w')}", "s1")]  # one owner: live
    rows += [(410 + k, f"see {EXAMPLE} in {words(draw, 30, 'e')}", f"s{k}") for k in range(4)]  # four owners: an example
    rows += [(500, None, "s1"), (501, "", None), (None, words(draw, 20, "n"), "s2"), (502, "one", "s1"), (502, words(draw, 30, "t"), "s1"), (503, "ab " * 30_000, "s9")]
    rows += [rows[3], rows[-3]]
    full = [(d, t, "en", s, len(t) if t else None, 7, "x", "y", "z", "k") for d, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node int, component_id string, live_ string, row_key string, text_key string"
    spark.createDataFrame(full, schema).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows


def near_groups(rows):
    """Component of each id: documents whose sets of five words share four fifths."""
    sets = {}
    for d, t, _ in rows:
        w = [x.lower() for x in (t or "").split()]
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        sets.setdefault(d, []).append(own)
    parent = {d: d for d in sets if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in ids}


def test_run_equals_plain_python(spark, tables):
    folder, rows = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    left = [r for r in rows if not model.at_least([r[1]])[0, 0] >= model.cut]
    assert {r[0] for r in left} == {r[0] for r in rows} - set(range(60, 100))
    group = near_groups(left)
    left = [r for r in left if r[0] is None or group[r[0]] == r[0]]
    assert {200} == {r[0] for r in left} & {200, 201, 202, 203}
    left = [r for r in left if r[0] not in (300, 301)]
    left = [(d, t.replace(f"password = {SECRET}", "[REDACTED]") if t else t, s) for d, t, s in left]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = Counter((d, tuple(library.encode(t)) if t is not None else None) for d, t, _ in left)
    out = corpus_pipeline.run(spark, folder)
    got = Counter((r["doc_id"], tuple(r["ids"]) if r["ids"] is not None else None) for r in out.collect())
    empty = lambda c: Counter({(d, ids or ()): n for (d, ids), n in c.items()})
    assert empty(got) == empty(want)
    assert any(EXAMPLE in t for _, t, _ in left if t) and sum(got.values()) == len(left)
