"""Spelling variants, source mixtures and Merkle manifests, against brute force."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from trajscope.llm import merkle, mixture, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, pos int, group_ string, n int, size string, root double, weight string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) as documents with columns of clashing names."""
    return spark.createDataFrame([(d, t, g, s, len(t) if t else None, "w", 1, "g", 2, "s", 1.0, "x") for d, t, g, s in rows], SCHEMA)


# --- spelling variants --------------------------------------------------------


def plain_variants(rows):
    counts = {}
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                counts[w] = counts.get(w, 0) + 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, own in beside.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(beside[w]), words[form[w]] if form[w] else None))
    return out


def wordy_rows():
    words = ["government"] * 40 + ["goverment", "govermnent", "governmant"] * 2 + ["Government", "naïveté", "NAÏVETÉ", "naïvete", "naïvete", "aaaaaaab", "aaaaaabb", "aaaaaabb", "abababab", "abababab"]
    words += ["bbbbbbba", "bbbbbbba", "×÷×÷×÷×", "×÷×÷×÷×", "short", "short", "governmen", "governmen"]
    rows = [(k, " ".join(words[k % 7 :]) + ("," if k % 2 else "_"), None, None) for k in range(30)]
    return [*rows, rows[0], (None, "nulldoc words words nulldoc nulldoc", None, None), (90, None, None, None), (91, "", None, None), (92, "x" * 300_000 + " " + "x" * 300_000, None, None)]


@pytest.mark.parametrize("hot", [spelling.HOT, 1])
def test_variants_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rows = wordy_rows()
    got = spelling.variants(frame(spark, rows)).collect()
    assert len(got) > 10 and {tuple(r) for r in got} == plain_variants([r[:2] for r in rows]) and len(got) == len({r["word"] for r in got})


def test_anagrams_make_no_pairs_in_vain(spark):
    """Hundreds of words of the same letters: what is emitted is what is near."""
    import itertools

    words = ["".join(p) for p in itertools.islice(itertools.permutations("abcdefgh"), 700)] + ["abcdefg", "abcdefgx", "bbcdefgh"]
    text = " ".join(words * 2)
    rows = [(7, text, None, None)]
    assert {tuple(r) for r in spelling.variants(frame(spark, rows)).collect()} == plain_variants([r[:2] for r in rows])


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)], "word string, form string")
    assert {r["root"] for r in spelling.roots(chain).collect()} == {"w37"}
    assert spelling.roots(chain.limit(0)).count() == 0 and spelling.variants(frame(spark, [])).count() == 0


# --- source mixtures ----------------------------------------------------------


def plain_targets(sizes, weights, share, repeats):
    """The contract's words: deal by weight, stop who is above, deal the rest again."""
    left, total, out = set(sizes), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(weights[s] for s in left)
        above = {s for s in left if level * weights[s] > repeats * sizes[s]}
        if not above:
            return out | {s: level * weights[s] for s in left}
        out |= {s: repeats * sizes[s] for s in above}
        left -= above
    return out


def source_rows():
    rows = [(k, "w " * (k % 23 + 1), None, f"s{k % 5}" if k % 3 else "big") for k in range(300)]
    rows += [(900, "a\tb\nc", None, None), (None, "one two", None, None), (None, "one two", None, "big"), (901, None, None, "s1"), (902, "", None, "s1"), (903, "v " * 30_000, None, "Z")]
    return [*rows, *[(950, "twin text here", None, "s2")] * 700]


def test_mixture_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixture, "LAID", 64)
    rows = source_rows()
    got = mixture.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = plain_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    assert len(set(map(len, [order, goal]))) == 1 and abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and all(abs(r["target"] - goal[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= 0.5 and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    again = mixture.mix(frame(spark, rows[::-1]).repartition(7))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["size"], r["taken"], str(r["takes"]))
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))


def test_curriculum_follows_schedules(spark):
    rows = [(k, "w w w", None, f"s{k % 3}") for k in range(3000)]
    order = mixture.curriculum(mixture.mix(frame(spark, rows))).collect()
    at = [r["position"] for r in order]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    for k, s in enumerate(mixture.SCHEDULES):
        own = [r for r in order if r["source"] == f"s{k}"]
        total = sum(r["words"] for r in own)
        for cut in (0.25, 0.5, 0.8):
            knots = [(t, w) for t, w in s if t < cut] + [(cut, next(w0 + (w1 - w0) * (cut - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(s, s[1:]) if t0 <= cut <= t1))]
            want = mixture.integral(knots) / mixture.integral(s)
            assert abs(sum(r["words"] for r in own if r["position"] <= cut) / total - want) < 0.01


def test_mixture_of_nothing(spark):
    assert mixture.mix(frame(spark, [])).count() == 0
    only = mixture.mix(frame(spark, [(1, None, None, "a"), (2, " \n", None, None)])).collect()
    assert {(r["doc_id"], r["taken"], r["target"], len(r["takes"])) for r in only} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_mixture_is_native(spark):
    plan = mixture.curriculum(mixture.mix(frame(spark, source_rows()[:20])))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- Merkle manifest ----------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    def leaf(d, t, g, s):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, g, len(t) if t else None, t)))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                paths[k].append(([*nodes[a - a % 8 : a]], [*nodes[a + 1 : a - a % 8 + 8]]))
            nodes, at = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [a // 8 for a in at]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == g), key=lambda x: x[:3]) for g in langs}
    trees = {g: climb([x[2] for x in own[g]]) for g in langs}
    root, upper = climb([trees[g][0] for g in langs])
    out = []
    for g, above in zip(langs, upper):
        for (_, _, node, (d, t, lang, s)), path in zip(own[g], trees[g][1]):
            now = node
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and t:
                now = sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, lang, len(t), "".join(c.lower() if "A" <= c <= "Z" else c for c in t))))
            for before, after in path + above:
                now = sha("".join([*before, now, *after]))
            out.append((d, node, trees[g][0], root, sha("".join("".join(b + a) for b, a in path + above)), now, now == root))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def merkle_rows():
    rows = [(k, f"Text {k} É Ωmega" if k % 5 else f"plain {k}", ("en", "de", None, "zz")[(k % 9 > 5) + (k % 11 == 3) + (k == 77)], f"s{k % 3}" if k % 7 else None) for k in range(700)]
    return [*rows, (None, "No Id", "en", "s"), (None, None, None, None), (3, "", "de", "s"), (3, "", "de", "s"), (3, "Twice", "de", "s"), (10**12, "Z" * 200_000, "en", "s")]


@pytest.mark.parametrize(("levels", "top"), [(merkle.BLOCK_LEVELS, merkle.TOP_NODES), (1, 40), (2, 5), (1, 2)])
def test_manifest_equals_brute_force(spark, levels, top):
    rows = merkle_rows()
    got = merkle.manifest(spark, merkle.tampered_leaves(frame(spark, rows)), levels, top).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_tree_sizes(spark, n):
    """Single leaves and last runs of one node; more languages than the driver's tree may hold."""
    for rows in ([(k, "A", "en", "s") for k in range(n)], [(k, "A", f"l{k}", "s") for k in range(n)]):
        got = merkle.manifest(spark, merkle.tampered_leaves(frame(spark, rows)), 1, 3).collect()
        assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark, merkle.tampered_leaves(frame(spark, []))).count() == 0


def test_equal_rows_are_spread(spark):
    from trajscope.llm.ranks import ranked

    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    same = spark.range(4000).select(F.lit("g").alias("g"), F.lit(1).alias("x"))
    out, made = ranked(same, "g", [F.col("g"), F.col("x")], "same")
    assert sorted(r["pos"] for r in out.collect()) == list(range(4000)) and {r["n"] for r in out.collect()} == {4000}
    spark.conf.unset(name)
    assert max(r["c"] for r in made[1].collect()) < 3000
