"""Saved and recomputed stages of a result, compared row by row: which stage is the first that differs, and where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checked

ROWS = "place int, stage string, key string, digest string, number double"


def stage(place: int, name: str, rows: DataFrame, keys: Sequence[str], exact: Sequence[str] = (), number: str | None = None) -> DataFrame:
    """ROWS of one stage: `exact` columns are compared by their digest, `number` within a tolerance (sums may come in any order)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    digest = checked.digest(*exact) if exact else F.lit("")
    value = F.col(number).cast("double") if number else F.lit(None).cast("double")
    return rows.select(F.lit(place).alias("place"), F.lit(name).alias("stage"), key.alias("key"), digest.alias("digest"), value.alias("number"))


def differences(saved: DataFrame, computed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """place, stage, key and difference (missing: saved only; extra: computed only; changed; repeated), of ROWS of all stages in one join.

    Equal keys are counted before the join, so repeated rows cannot multiply.
    """
    side = lambda df, n: df.groupBy("place", "stage", "key").agg(F.count(F.lit(1)).alias(f"n_{n}"), F.min("digest").alias(f"d_{n}"), F.max("number").alias(f"v_{n}"))
    both = side(saved, "s").join(side(computed, "c"), ["place", "stage", "key"], "full_outer")
    apart = (F.col("v_s").isNull() != F.col("v_c").isNull()) | (F.abs(F.col("v_s") - F.col("v_c")) > tolerance)
    difference = (
        F.when(F.col("n_c").isNull(), "missing").when(F.col("n_s").isNull(), "extra").when((F.col("n_s") > 1) | (F.col("n_c") > 1), "repeated")
        .when((F.col("d_s") != F.col("d_c")) | F.coalesce(apart, F.lit(False)), "changed")
    )
    return both.select("place", "stage", "key", difference.alias("difference")).where("difference IS NOT NULL")


def summary(found: DataFrame) -> DataFrame:
    """place, stage, difference, n and the first key, of differences; the first row in order of place is where things went wrong."""
    counts = found.groupBy("place", "stage", "difference").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("example"))
    return counts.orderBy("place", "difference")
