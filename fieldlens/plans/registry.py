"""How queries are registered: a name, a function of (spark, sf_dir), and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lcs_cte(pairs: str) -> str:
    """CTEs whose `lcs` has (id, a, b, lcs) for a query of (id, a, b): rows of counts, each the running maximum of what a
    letter can add."""
    return f"""
    RECURSIVE pairs AS ({pairs}),
    dp AS (
      SELECT id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM pairs
      UNION ALL
      SELECT id, a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN r[k] + 1 ELSE r[k + 1] END)))) FROM dp WHERE i < length(a)),
    lcs AS (SELECT id, a, b, r[length(b) + 1]::INT AS lcs FROM dp WHERE i = length(a))"""
