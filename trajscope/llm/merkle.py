"""A Merkle manifest of a table: roots by group, a proof for every row, folds that show tampering.

A row is a leaf, the digest of its columns. Leaves of a group (`lang`) ascend by
doc_id, every RUN consecutive nodes become one digest, level by level, until one
is left: the group's subroot. The subroots, in order of their groups, give the
root the same way.

Blocks of RUN**BLOCK_LEVELS leaves are reduced by executors, round after round,
until TOP_NODES nodes or fewer are left. This top tree goes to the driver, which
builds it and broadcasts the paths from its nodes to the root; its size is
checked, so both are bounded. Executors reduce their blocks once more, and finish
each row's proof and fold. A node knows the number of nodes of its group (`n`),
which tells whether its group goes on. When all groups are down to one node and
there are still too many of them, they go on as nodes of the tree of subroots.

Defined cases: a null column is `-` in the leaf, an empty text `0:`; a null
doc_id comes first and is not tampered with; a null group is a group of its own;
rows that repeat a doc_id are leaves each, ordered by their digest; very long
texts are hashed before anything is shuffled; an empty table has no rows and no
root; columns beyond the hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .ranks import ranked

RUN = 8
BLOCK_LEVELS = 4
#: Nodes of the tree that the driver builds. A path holds at most RUN - 1 digests a level, and the tree has about six, so the paths of all take under 32 MB.
TOP_NODES = 1 << 13
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From a node to the root: the digests before and after it in its run, level by level.
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row with the columns HASHED; `text` may stand in for the column text."""
    columns = [text if c == "text" and text is not None else F.col(c) for c in HASHED]
    return F.sha2(F.concat(*map(_field, columns)), 256)


def levels_of(nodes: list[str], whole: bool, most: int) -> list[list[str]]:
    """Levels above and including `nodes`: to a single node if they are the whole tree, else `most` levels up."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= most:
        last = out[-1]
        out.append([digest("".join(last[k : k + RUN])) for k in range(0, len(last), RUN)])
    return out


def path_in(levels: list[list[str]], at: int) -> Path:
    out = []
    for nodes in levels[:-1]:
        begin = at - at % RUN
        out.append(("".join(nodes[begin:at]), "".join(nodes[at + 1 : begin + RUN])))
        at //= RUN
    return out


def fold(node: str, path: Path) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _build_top(nodes: Iterable[tuple[str | None, int, str]], subroots: bool) -> tuple[str, dict[tuple[str | None, int], tuple[str, Path]]]:
    """(root, {(group, pos): (subroot, path)}) of a small tree of (group, pos, digest); subroots: all are nodes of the tree above the groups."""
    groups: dict[str | None, list[str]] = {}
    for group, _, node in sorted(nodes, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])):
        groups.setdefault(group, []).append(node)
    if not groups:
        return "", {}
    trees = {g: levels_of(own, True, 0) for g, own in groups.items()}
    if subroots:
        (tree,) = trees.values()
        return tree[-1][0], {(g, k): ("", path_in(tree, k)) for g in groups for k in range(len(groups[g]))}
    upper = levels_of([tree[-1][0] for tree in trees.values()], True, 0)
    out = {}
    for k, (g, tree) in enumerate(trees.items()):
        above = path_in(upper, k)
        out.update({(g, i): (tree[-1][0], path_in(tree, i) + above) for i in range(len(groups[g]))})
    return upper[-1][0], out


_NODE = "group_ string, pos long, n long, node string"
_PATH = "array<struct<b:string,a:string>>"
_PATHS = f"group_ string, pos long, subroot string, root string, path {_PATH}"


def _whole(own: pd.DataFrame, block: int) -> bool:
    return int(own["n"].iloc[0]) <= block


def _reduced(nodes: DataFrame, block_levels: int, column: str = "node") -> DataFrame:
    """One node for each block of nodes."""
    block = RUN**block_levels

    def top(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        up = levels_of(own["node"].tolist(), _whole(own, block), block_levels)[-1][0]
        return pd.DataFrame({"group_": own["group_"].iloc[:1], "pos": own["pos"].iloc[:1] // block, "n": -(-own["n"].iloc[:1] // block), "node": [up]})

    own = nodes.select("group_", "pos", "n", F.col(column).alias("node"))
    return own.groupBy("group_", F.expr(f"pos div {block}L").alias("block_")).applyInPandas(top, _NODE)


def _finished(spark: SparkSession, nodes: DataFrame, above, block_levels: int, schema: str, finish) -> DataFrame:
    """finish(own, subroot, root, paths) of every block, once the paths above it are known (a small table of the driver's, or a table)."""
    block = RUN**block_levels

    def paths(own: pd.DataFrame) -> list[Path]:
        levels = levels_of(own["node"].tolist(), _whole(own, block), block_levels)
        return [path_in(levels, k) for k in range(len(own))]

    keyed = nodes.groupBy("group_", F.expr(f"pos div {block}L").alias("block_"))
    if isinstance(above, DataFrame):

        def join(own: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            own, up = own.sort_values("pos"), up.iloc[0]
            rest = [(x["b"], x["a"]) for x in up["path"]]
            return finish(own, up["subroot"], up["root"], [p + rest for p in paths(own)])

        return keyed.cogroup(above.groupBy("group_", "pos")).applyInPandas(join, schema)
    root, top = above
    sent = spark.sparkContext.broadcast(top)

    def look(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        group = own["group_"].iloc[0]
        subroot, rest = sent.value[None if pd.isna(group) else group, int(own["pos"].iloc[0]) // block]
        return finish(own, subroot, root, [p + rest for p in paths(own)])

    return keyed.applyInPandas(look, schema)


def _own_paths(own: pd.DataFrame, subroot: str, root: str, paths: list[Path]) -> pd.DataFrame:
    out = own[["group_", "pos"]].copy()
    out["subroot"], out["root"], out["path"] = subroot, root, [[{"b": b, "a": a} for b, a in p] for p in paths]
    return out


def _above(spark: SparkSession, nodes: DataFrame, block_levels: int, top_nodes: int, made: list[DataFrame], subroots: bool = False):
    """The paths above `nodes`, a written table: from the driver if they are few, else from executors, block by block."""
    n, most = nodes.agg(F.count(F.lit(1)), F.max("n")).first()
    if n <= top_nodes:
        return _build_top(((r["group_"], r["pos"], r["node"]) for r in nodes.collect()), subroots)
    if most > 1:
        parents = materialize(_reduced(nodes, block_levels), "merkle")
        made.append(parents)
        above = _above(spark, parents, block_levels, top_nodes, made, subroots)
        return _finished(spark, nodes, above, block_levels, _PATHS, _own_paths)
    # a node for each group: they are the leaves of the tree of subroots
    placed, tables = ranked(nodes.select(F.col("group_").alias("of_"), F.lit("").alias("group_"), "node"), "group_", [F.col("of_").asc_nulls_first()], "merkle")
    placed = materialize(placed, "merkle")
    made += [*tables, placed]
    parents = materialize(_reduced(placed, block_levels), "merkle")
    made.append(parents)
    above = _above(spark, parents, block_levels, top_nodes, made, True)

    def of_group(own: pd.DataFrame, _: str, root: str, paths: list[Path]) -> pd.DataFrame:
        out = _own_paths(own.assign(group_=own["of_"], pos=0), "", root, paths)
        return out.assign(subroot=own["node"].to_numpy())

    return _finished(spark, placed, above, block_levels, _PATHS, of_group)


def manifest(spark: SparkSession, leaves: DataFrame, block_levels: int = BLOCK_LEVELS, top_nodes: int = TOP_NODES) -> DataFrame:
    """Of leaves (doc_id, group_, leaf, claimed): doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `claimed` is the leaf that is folded with the siblings of the true one; null stands for the true one.
    """
    order = [F.col("group_").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    placed, made = ranked(leaves.select("doc_id", "group_", "leaf", "claimed"), "group_", order, "leaves")
    blocks = materialize(_reduced(placed, block_levels, "leaf"), "merkle")
    made.append(blocks)
    above = _above(spark, blocks, block_levels, top_nodes, made)
    kind = dict(leaves.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def rows(own: pd.DataFrame, subroot: str, root: str, paths: list[Path]) -> pd.DataFrame:
        claimed = [c if isinstance(c, str) else leaf for c, leaf in zip(own["claimed"], own["node"])]
        out = pd.DataFrame({"doc_id": own["doc_id"], "leaf": own["node"], "subroot": subroot, "root": root})
        out["proof_sha256"] = [digest("".join(b + a for b, a in p)) for p in paths]
        out["folded_root"] = [fold(c, p) for c, p in zip(claimed, paths)]
        out["verified"] = out["folded_root"] == root
        return out

    # integers with nulls would become floats on the way to pandas
    placed = placed.select("group_", "pos", "n", F.col("leaf").alias("node"), "claimed", F.col("doc_id").cast("string").alias("doc_id"))
    text = schema.replace(f"doc_id {kind}", "doc_id string", 1)
    return _finished(spark, placed, above, block_levels, text, rows).withColumn("doc_id", F.col("doc_id").cast(kind))


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, group_ (the language), leaf and claimed: rows whose crc32(doc_id) 3 divides claim a text with lower-cased A-Z."""
    claimed = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").rlike("[A-Z]"), leaf_digest(F.translate("text", UPPER, LOWER)))
    return docs.select("doc_id", F.col("lang").cast("string").alias("group_"), leaf_digest().alias("leaf"), claimed.alias("claimed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, tampered_leaves(table(spark, sf_dir, "documents")))


def _sql(deep: int = 9, deep_top: int = 4) -> str:
    """Levels written out: RUN**deep rows of a language, RUN**deep_top languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in HASHED) + ")"
    out = [
        "WITH crcs AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))",
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) AS crc, {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} AS low FROM documents, crcs)",
        "x AS (SELECT doc_id, coalesce('=' || lang, '') AS g, leaf, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "l0 AS (SELECT g, i, leaf AS h FROM x)",
    ]

    def tree(level: str, run: str, levels: int) -> None:
        for k in range(levels):
            out.append(f"{run}{k} AS (SELECT g, i // {RUN} AS i, list(h ORDER BY i) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {level}{k}) GROUP BY g, i // {RUN})")
            out.append(f"{level}{k + 1} AS (SELECT g, i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {run}{k})")

    tree("l", "r", deep)
    out.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS of FROM l{deep})")
    tree("t", "s", deep_top)
    out.append("y0 AS (SELECT x.*, x.claimed AS f, '' AS proof FROM x)")
    step = "CASE WHEN r.n > 1 THEN sha256(array_to_string(r.hs[1:j], '') || f || array_to_string(r.hs[j + 2:], '')) ELSE f END AS f, CASE WHEN r.n > 1 THEN proof || array_to_string(r.hs[1:j], '') || array_to_string(r.hs[j + 2:], '') ELSE proof END AS proof"
    for k in range(deep):
        out.append(f"y{k + 1} AS (SELECT y.doc_id, y.g, y.leaf, y.i // {RUN} AS i, {step} FROM (SELECT *, i % {RUN} AS j FROM y{k}) y JOIN r{k} r ON r.g = y.g AND r.i = y.i // {RUN})")
    out.append(f"z0 AS (SELECT y.doc_id, y.leaf, t.h AS subroot, t.i, y.f, y.proof FROM y{deep} y JOIN t0 t ON t.of = y.g)")
    for k in range(deep_top):
        out.append(f"z{k + 1} AS (SELECT y.doc_id, y.leaf, y.subroot, y.i // {RUN} AS i, {step} FROM (SELECT *, i % {RUN} AS j FROM z{k}) y JOIN s{k} r ON r.i = y.i // {RUN})")
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM z{deep_top}, t{deep_top} t"


OP13_SQL = _sql()
