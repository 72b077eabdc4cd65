"""Named queries over the given tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from quaycheck.plans import queries_files, queries_gate, queries_review, queries_runs  # noqa: F401

    return QUERIES, SQL
