"""Registered queries: each operator over the given tables, with an SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its SQL twin."""
    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


def load_all() -> None:
    from riskloom.checks import calendar, changes, rules, scan, scalars, sources, streams, threats  # noqa: F401
