"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import statistics
from .sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, base: bool = True):
    """Register a query under its function's name; base puts the trajectory views before the SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {td.SQL}{sql}" if base else sql
        return f

    return register


def rounded(column, name: str | None = None):
    """Rounded to nine places, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, 9) + F.lit(0.0)
    return out.alias(name or column) if isinstance(column, str) or name else out


def macro(scores: DataFrame) -> DataFrame:
    return statistics.macro_mean(scores).select("level", "domain", "task", rounded("score"))


#: Macro means of the rows (domain, task, score) of the view s.
MACRO = """,
ta AS (SELECT domain, task, avg(score) AS score FROM s GROUP BY ALL), da AS (SELECT domain, avg(score) AS score FROM ta GROUP BY ALL)
SELECT 'task' AS level, domain, task, round(score, 9) + 0.0 AS score FROM ta UNION ALL SELECT 'domain', domain, '*', round(score, 9) + 0.0 FROM da
UNION ALL SELECT 'overall', '*', '*', round(avg(score), 9) + 0.0 FROM da"""
