"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct n-word shingles. Documents link when
100 * intersection >= threshold * union; the result is the components of links.

1. Documents with equal sets are one node, so copies cost one pass and no pairs.
2. Blocks: a shingle order that puts shingles from heavily used buckets last (a
   count of all shingles over BUCKETS buckets) gives each set a prefix of
   n - ceil(t * n) + 1 shingles; two sets that link share one of them. An R-tree
   alone has no key by which far machines could each hold a part of the join.
3. In each block all nodes are tried against the one that shares most blocks.
   That joins a family of near copies with as many tries as it has members.
4. Blocks that still hold more than one component get a count-vector R-tree: the
   shingles are hashed into groups, the counts of the groups are a point; leaves
   and points are compared by the sum of coordinate minima, which bounds the
   overlap from above. Pairs that pass are verified on the sets. Blocks of over
   TILE nodes are split by set sizes (linked sets are in one band of sizes or in
   neighbouring ones), and these into pairs of tiles, so none is too large for a
   task. Work is quadratic only in documents of one size that have a prefix
   shingle in common and yet belong to different components.

No component is left in parts: a pair is skipped only if both are in one
component already, if they share no prefix shingle, or if the bound excludes it.

5. Links lie within components. Each component of two nodes or more is dealt into
   tiles of TILE nodes, and for each pair of tiles the overlaps of all pairs of
   sets are counted exactly, so every link between different texts is found.
   `jaccard_links` gives them; the join adds their number to each document. A
   node weighs as many links as it has documents (distinct ids), and documents
   of equal sets link with each other.

Defined cases: fewer words than n make one shingle of all words; null, empty or
blank texts have no set, link with nothing and are their own component; repeated
ids count as rows of one document; an empty table gives an empty result; null ids
are in no component and have no links; very long texts count whole; ties need no
order, as all links are found; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, scramble, sized, small_batches, table, text_chunks, window_hashes, word_hashes
from .components import connected_components

BUCKETS = 1 << 17
GROUPS = 512
LEAF = 16
TILE = 512
#: Rows and pairs that a task holds at a time.
BATCH_ROWS = 2048
BATCH_PAIRS = 1 << 13
SEEN = 1 << 20


# --- sets ---------------------------------------------------------------------


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after another, offsets)."""
    words, first = word_hashes(texts, lower=True)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), size)
    hashes, owners = [], []
    if len(words) >= n:
        inside = owner[: len(words) - n + 1] == owner[n - 1 :]
        hashes.append(window_hashes(words, n)[inside])
        owners.append(owner[: len(words) - n + 1][inside])
    for k in range(1, n):
        few = np.flatnonzero(size == k)
        if len(few):
            hashes.append(window_hashes(words, k)[first[few]])
            owners.append(few)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _loads(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for frame in frames:
            for part in text_chunks(frame):
                total += np.bincount(_bucket(shingles(part["text"].tolist(), n)[0]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype("int32"), "n": total[at]})

    return run


def _nodes(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit name of each non-empty set; 0 for an empty one."""
    size = np.diff(cut)
    some = np.flatnonzero(size)
    out = np.zeros(len(size), dtype=np.uint64)
    if len(some):
        out[some] = scramble(np.add.reduceat(scramble(h + np.uint64(99)), cut[:-1][some]) + size[some].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def _prefixes(n: int, threshold: int, load: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            for part in text_chunks(frame):
                h, cut = shingles(part["text"].tolist(), n)
                size = np.diff(cut)
                node = _nodes(h, cut)
                owner = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((h, load[_bucket(h)], owner))
                keep = size - -(-threshold * size // 100) + 1
                keys = h[order].view(np.int64)
                rows = []
                for k, name in enumerate(node.tolist()):
                    fresh = name and name not in seen
                    if len(seen) < SEEN:  # saves rows; repeated ones are dropped later
                        seen.add(name)
                    rows.append(keys[cut[k] : cut[k] + keep[k]] if fresh else keys[:0])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n": size, "node": node, "keys": rows})

    return run


def _vector(h: np.ndarray) -> bytes:
    """Counts of the groups in a byte each; 255 stands for that or more."""
    return np.minimum(np.bincount((scramble(h) >> np.uint64(55)).astype(np.int64), minlength=GROUPS), 255).astype("u1").tobytes()


def _counts(vectors) -> np.ndarray:
    """Rows of counts; where one is cut off, a number that bounds nothing stands instead."""
    out = np.stack([np.frombuffer(v, "u1") for v in vectors])
    if (out == 255).any():
        out = out.astype(np.int32)
        out[out == 255] = 1 << 21
    return out


def _overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x, y).sum(1, dtype=np.int64)


def _points(n: int):
    """node, size and count vector of the sets of the rows; a repeated doc_id may bring another text, whose node then differs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame):
                h, cut = shingles(part["text"].tolist(), n)
                out = pd.DataFrame({"node": part["node"].to_numpy(), "n": np.diff(cut), "vector": [_vector(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]})
                yield out[_nodes(h, cut) == out["node"].to_numpy()]

    return run


def _members(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame):
                h, cut = shingles(part["text"].tolist(), n)
                out = pd.DataFrame({"node": part["node"].to_numpy(), "members": [h[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})
                yield out[_nodes(h, cut) == out["node"].to_numpy()]

    return run


# --- the R-tree ---------------------------------------------------------------


def rtree_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a packed R-tree: sort-tile by size and then by the widest coordinates."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = points[rows]
        totals = own.sum(1, dtype=np.int64)
        spread = own.max(0).astype(np.int64) - own.min(0)
        by = totals if totals.max() - totals.min() > spread.max() else own[:, spread.argmax()]
        rows = rows[np.argsort(by, kind="stable")]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) with first <= second for all pairs of members of each of the groups that follow one another."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    first = np.arange(len(ends))
    n = ends - first
    return np.repeat(first, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def _sums_of(bound, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([bound(x[k : k + BATCH_PAIRS], y[k : k + BATCH_PAIRS]) for k in range(0, len(x), BATCH_PAIRS)]) if len(x) else np.zeros(0, np.int64)


def rtree_pairs(points: np.ndarray, sizes: np.ndarray, component: np.ndarray, threshold: int, side: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components whose summed coordinate minima admit a link.

    side: if given, pairs of different sides only. group: if given (sorted), a tree and its pairs for each of the groups.
    """
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(points)])) if group is not None and len(points) else np.array([0, len(points)])
    leaves, trees = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = [np.arange(a, b)] if b - a <= LEAF else [a + rows for rows in rtree_leaves(points[a:b])]
        leaves += own
        trees.append(len(own))
    # rows by leaf, and what bounds a leaf
    rows = np.concatenate(leaves)
    size = np.array([len(x) for x in leaves])
    start = np.cumsum(size) - size
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top, least = np.maximum.reduceat(points[rows], start), np.minimum.reduceat(sizes[rows], start)
    # leaf against leaf: no two points of them overlap by more than this
    a, b = pairs_within(np.array(trees))
    apart = np.flatnonzero(a != b)
    far = (100 + threshold) * _sums_of(lambda x, y: _overlap(top[x], top[y]), a[apart], b[apart]) < threshold * (least[a[apart]] + least[b[apart]])
    near = np.delete(np.arange(len(a)), apart[far])
    a, b = a[near], b[near]
    left, right, n = [], [], size[a] * size[b]
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // BATCH_PAIRS)) + 1
    for own in np.split(np.arange(len(a)), cuts):
        place = np.arange(n[own].sum()) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        wide = np.repeat(size[b[own]], n[own])
        x, y = np.repeat(start[a[own]], n[own]) + place // wide, np.repeat(start[b[own]], n[own]) + place % wide
        ok = (x < y) | np.repeat(a[own] != b[own], n[own])
        x, y = rows[x[ok]], rows[y[ok]]
        ok = (component[x] != component[y]) & (100 * sizes[y] >= threshold * sizes[x]) & (100 * sizes[x] >= threshold * sizes[y])
        if side is not None:
            ok &= (side[x] < 0) | (side[x] != side[y])
        x, y = x[ok], y[ok]
        ok = (100 + threshold) * _overlap(points[x], points[y]) >= threshold * (sizes[x] + sizes[y])
        left.append(x[ok]), right.append(y[ok])
    return np.concatenate(left), np.concatenate(right)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], least: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, `least` rows or more but for the last, of rows that come sorted by the keys."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n < least:
            continue
        rows = pd.concat(held, ignore_index=True)
        own = rows[keys].to_numpy()
        change = np.flatnonzero((own[1:] != own[:-1]).any(1))
        cut = change[-1] + 1 if len(change) else 0
        if cut:
            yield rows.iloc[:cut]
        held, n = [rows.iloc[cut:]], len(rows) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def _tile_pairs(threshold: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["key", "band", "i", "j"]):
            own = frame[["key", "band", "i", "j"]].to_numpy()
            group = np.concatenate(([0], np.cumsum((own[1:] != own[:-1]).any(1))))
            side = np.where(frame["i"] == frame["j"], -1, frame["tile"])
            node = frame["node"].to_numpy()
            x, y = rtree_pairs(_counts(frame["vector"]), frame["n"].to_numpy(), frame["component"].to_numpy(), threshold, side, group)
            yield pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])}).drop_duplicates()

    return run


def _verified(threshold: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = np.zeros(len(frame), dtype=bool)
            for k, (x, y) in enumerate(zip(frame["set_a"], frame["set_b"], strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield frame.loc[keep, ["a", "b"]]

    return run


def _links(pairs: DataFrame, own: DataFrame, firsts: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that the sets verify. Only sets of nodes that the bound left in a pair are made."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(firsts, "node")
    picked = sized(materialize(nodes, "nodes"))
    sets = materialize(own.join(picked, "doc_id").select("node", "text").mapInPandas(_members(n), "node long, members binary"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInPandas(_verified(threshold), "a long, b long").distinct()


def _bounded(pairs: DataFrame, points: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose summed minima of the count vectors admit a link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                ok = (100 + threshold) * _overlap(_counts(frame["va"]), _counts(frame["vb"])) >= threshold * (frame["na"] + frame["nb"]).to_numpy()
                yield frame.loc[ok, ["a", "b"]]

    left = points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
    right = points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "va", "vb").mapInPandas(run, "a long, b long")


# --- the join -----------------------------------------------------------------


def _classes(docs: DataFrame, n: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """own (doc_id, text), base (doc_id, n, node) and the classes (node, component, first, component_id)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    load = np.zeros(BUCKETS, dtype=np.int64)
    for r in own.select("text").mapInPandas(_loads(n), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        load[r["bucket"]] = r["n"]  # BUCKETS rows at most
    base = materialize(own.mapInPandas(_prefixes(n, threshold, load), "doc_id long, n long, node long, keys array<long>"), "prefixes")
    nodes = base.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("first"))

    # blocks: (key, node) rows of keys with two nodes or more
    keyed = base.select(F.explode("keys").alias("key"), "node")
    common = materialize(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), "common")
    blocks = materialize(keyed.join(common, "key").distinct(), "blocks")
    degree = materialize(blocks.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degree")
    firsts = materialize(degree.join(nodes, "node").where("first IS NOT NULL").select("node", F.col("first").alias("doc_id")), "firsts")
    points = materialize(own.join(sized(firsts), "doc_id").select("node", "text").mapInPandas(_points(n), "node long, n long, vector binary"), "points")

    # first tries: each node of a block against the block's most shared node
    hubs = materialize(blocks.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub")), "hubs")
    tries = blocks.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tries = materialize(tries, "tries")
    able = materialize(_bounded(tries, points, threshold).distinct(), "able")
    links = materialize(_links(able, own, firsts, n, threshold), "links")
    component = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(able, hubs, degree, common)

    # blocks that hold more than one component, each set of nodes once
    placed = blocks.join(component, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    mixed = materialize(mixed.where("lo < hi AND m > 2").groupBy("who", "m").agg(F.min("key").alias("key")).select("key", "m"), "mixed")
    rows = placed.join(mixed, "key").join(points, "node").select("key", "node", "component", "n", "vector", "m")
    tiled = ["key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "band", "tile", "node", "component", "n", "vector"]
    hot = rows.where(F.col("m") > TILE).withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / threshold))).cast("int"))
    hot = hot.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    wide = hot.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("t"))
    hot = hot.join(wide, ["key", "band"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("t")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    none = F.lit(0).cast("int")
    rows = rows.where(F.col("m") <= TILE).select("key", none.alias("i"), none.alias("j"), none.alias("band"), none.alias("tile"), "node", "component", "n", "vector").unionByName(hot.select(*tiled))
    rest = rows.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j").mapInPandas(_tile_pairs(threshold), "a long, b long")
    rest = materialize(rest.distinct().join(tries, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(_links(rest, own, firsts, n, threshold))
    # rows that repeat an id are one document: their sets are reachable from each other
    several = base.where("node <> 0").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("hi")).where("u < hi AND doc_id IS NOT NULL").select("doc_id", "u")
    same = base.where("node <> 0").join(several, "doc_id").where("node <> u").select("u", F.col("node").alias("v")).distinct()
    component = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same))

    named = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("node", "component", "first"), "named")
    discard(points, blocks, mixed, rest, tries, firsts)
    smallest = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    return own, base, materialize(named.join(smallest, "component"), "classes")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of x, the sizes of its intersections with the sets of y."""
    h = np.concatenate(y)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], np.repeat(np.arange(len(y)), [len(s) for s in y])[order]
    for s in x:
        a, b = np.searchsorted(h, s, "left"), np.searchsorted(h, s, "right")
        size = b - a
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield np.bincount(owner[at], minlength=len(y))


def _tile_links(threshold: int, counted: bool):
    """Links of a pair of tiles of one component: (a, b), or if counted the documents that each node links to here."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        same = frame["i"].iloc[0] == frame["j"].iloc[0]
        left, right = frame[frame["tile"] == frame["i"].iloc[0]], frame[frame["tile"] == frame["j"].iloc[0]]
        sets = [[np.frombuffer(m, "<u8") for m in f["members"]] for f in (left, right)]
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        size, weights = np.array([len(s) for s in sets[1]], dtype=np.int64), (left["docs"].to_numpy(), right["docs"].to_numpy())
        of_a, of_b, links = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
        for k, both in enumerate(_overlaps(*sets) if len(a) and len(b) else ()):
            hit = 100 * both >= threshold * (len(sets[0][k]) + size - both)
            hit[: k + 1] &= not same
            to = np.flatnonzero(hit)
            of_a[k] += weights[1][to].sum()
            of_b[to] += weights[0][k]
            if not counted and len(to):
                links.append(pd.DataFrame({"a": np.minimum(a[k], b[to]), "b": np.maximum(a[k], b[to])}))
        if counted:
            return pd.DataFrame({"node": np.concatenate([a, b]), "links": np.concatenate([of_a, of_b])})
        return pd.concat(links) if links else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return run


def _tiles(own: DataFrame, classes: DataFrame, docs_of: DataFrame, n: int) -> DataFrame:
    """The sets of all components with two nodes or more, for each pair of tiles (component, i, j)."""
    many = classes.where("first IS NOT NULL").groupBy("component").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    nodes = materialize(classes.join(many, "component").join(docs_of, "node").select("node", "component", "m", "docs", F.col("first").alias("doc_id")), "linked")
    sets = own.join(sized(nodes.select("node", "doc_id")), "doc_id").select("node", "text").mapInPandas(_members(n), "node long, members binary").dropDuplicates(["node"])
    t = F.ceil(F.col("m") / TILE).cast("int")
    rows = materialize(sets, "members").join(nodes, "node").withColumn("t", t).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    return rows.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "docs", "members")


def _docs_of(base: DataFrame) -> DataFrame:
    return materialize(base.where("node <> 0").groupBy("node", "doc_id").agg(F.lit(1).alias("x")).groupBy("node").agg(F.count("doc_id").alias("docs")), "docs")


def jaccard_links(docs: DataFrame, n: int = 4, threshold: int = 85) -> DataFrame:
    """doc_a, doc_b (the smallest ids with either set) of every link between different sets, each once."""
    own, base, classes = _classes(docs, n, threshold)
    links = _tiles(own, classes, _docs_of(base), n).groupBy("component", "i", "j").applyInPandas(_tile_links(threshold, False), "a long, b long")
    first = [classes.select(F.col("node").alias(c), F.col("first").alias(f"doc_{c}")) for c in "ab"]
    out = links.join(first[0], "a").join(first[1], "b")
    return out.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))


def jaccard_components(docs: DataFrame, n: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and n_links (other documents it links with) for each row of docs."""
    own, base, classes = _classes(docs, n, threshold)
    docs_of = _docs_of(base)
    counts = _tiles(own, classes, docs_of, n).groupBy("component", "i", "j").applyInPandas(_tile_links(threshold, True), "node long, links long")
    counts = materialize(counts.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    of_node = materialize(docs_of.join(classes, "node").join(counts, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("docs")).alias("links")), "of_node")
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
    n_links = F.coalesce(F.col("links") - F.col("doc_id").isNotNull().cast("long"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), n_links.alias("n_links"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component (five words, 0.8) the document with the smallest id stays, with all its rows."""
    _, base, classes = _classes(docs, 5, 80)
    gone = materialize(base.join(classes, "node").where("component_id <> doc_id").select("doc_id"), "gone")
    kept = docs.join(sized(gone), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    return kept.select(*(docs[c] for c in docs.columns))
