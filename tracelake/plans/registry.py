"""Where the query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def uncut(name: str, *cuts: tuple[str, str]) -> str:
    """The SQL of a query over a subset with its filters replaced, for the same job over whole tables."""
    sql = SQL[name]
    for cut, instead in cuts:
        if cut not in sql:
            raise ValueError(f"{name} has no {cut}")
        sql = sql.replace(cut, instead)
    return sql


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with SQL that gives the same rows if there is such."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put
