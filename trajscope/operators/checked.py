"""Joins with coverage checks, merges and differences of tables keyed by id or cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_report(plan: DataFrame, predictions: DataFrame, key: str = "query_id") -> DataFrame:
    """key, status: ok, missing (planned only), extra (predicted only), duplicate or wrong_op.

    Duplicates are found by a partial count of keys, so a join of the two sides
    never multiplies rows.
    """
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("op").alias("low"), F.max("op").alias("high"))
    both = plan.select(key, F.col("op").alias("planned")).join(p, key, "full_outer")
    status = (
        F.when(F.col("planned").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
        .when((F.col("low") != F.col("planned")) | (F.col("high") != F.col("planned")), "wrong_op").otherwise("ok")
    )
    return both.select(key, status.alias("status"))


def join_checked(plan: DataFrame, predictions: DataFrame, key: str = "query_id", ignore_extra: bool = False) -> DataFrame:
    """plan with score, after a check that every query has one prediction of its op and there are no others; an error names three of each kind."""
    bad = join_report(plan, predictions, key).where(F.col("status") != "ok")
    if ignore_extra:
        bad = bad.where(F.col("status") != "extra")
    counts = {r["status"]: r["n"] for r in bad.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        named = {status: [r[key] for r in bad.where(F.col("status") == status).orderBy(key).limit(3).collect()] for status in sorted(counts)}
        raise ValueError("predictions do not cover the plan: " + ", ".join(f"{counts[k]} {k} (e.g. {', '.join(map(str, v))})" for k, v in named.items()))
    return plan.join(predictions.drop("op"), key)


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_cells(old: DataFrame, new: DataFrame, cell: Sequence[str] = ("domain", "task")) -> DataFrame:
    """old without the cells that new brings, and new; equal rows once."""
    kept = old.join(new.select(*cell).distinct(), list(cell), "left_anti")
    return kept.unionByName(new).distinct()


def union_parts(parts: Sequence[DataFrame], key: str = "query_id") -> DataFrame:
    """All parts, after a check that no key is in two of them or twice in one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = out.groupBy(key).count().where("count > 1").select(F.count(F.lit(1)), F.min(key)).first()
    if twice[0]:
        raise ValueError(f"{twice[0]} keys occur in two parts, e.g. {twice[1]}")
    return out


def missing_cells(requested: DataFrame, published: DataFrame, cell: Sequence[str] = ("domain", "task")) -> DataFrame:
    """Requested cells that are not published; a cell published under another fingerprint is an error."""
    both = requested.join(published.select(*cell, F.col("fingerprint").alias("known")), list(cell), "left")
    changed = both.where(F.col("known").isNotNull() & (F.col("known") != F.col("fingerprint"))).select(*cell).first()
    if changed:
        raise ValueError(f"cell {tuple(changed)} was published from other inputs")
    return both.where(F.col("known").isNull()).drop("known")


def differences(saved: DataFrame, computed: DataFrame, keys: Sequence[str], value: str = "score", tolerance: float = 1e-9) -> DataFrame:
    """Rows of either side that the other lacks, or whose values differ by more than the tolerance."""
    both = saved.select(*keys, F.col(value).alias("saved")).join(computed.select(*keys, F.col(value).alias("computed")), list(keys), "full_outer")
    return both.where(F.col("saved").isNull() != F.col("computed").isNull()).unionByName(both.where(F.abs(F.col("saved") - F.col("computed")) > tolerance))


def expected_coverage(plan: DataFrame) -> DataFrame:
    """metric, domain, n_queries, tasks (sorted, joined by commas)."""
    return plan.groupBy("metric", "domain").agg(F.count(F.lit(1)).alias("n_queries"), F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"))


def fingerprint(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, fingerprint: SHA-256 over digests of buckets of the rows' digests, each in order.

    A row's digest is that of its JSON; its first three digits name its bucket, so
    a group's digests meet in 4096 lists and not in one.
    """
    keys = list(keys)
    digest = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns))), 256)
    small = rows.select(*keys, digest.alias("h")).groupBy(*keys, F.substring("h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return small.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def digest(*parts: str | Column) -> Column:
    """SHA-256 of the parts as one JSON object: the identity of a query's payload."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
