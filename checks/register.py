"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _plain_counts(sql: str) -> str:
    """``count_if(x)`` as ``count(*) filter (where x)``, whose type is a plain 64-bit integer."""
    while (start := sql.find("count_if(")) >= 0:
        depth, end = 1, start + len("count_if(")
        while depth:
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
        inner = sql[start + len("count_if(") : end - 1]
        sql = f"{sql[:start]}count(*) filter (where {inner}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must return the same rows where there is one."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = _plain_counts(sql)
        return function

    return add
