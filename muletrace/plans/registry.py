"""Registry pairing each query with the SQL that checks it.

Queries are registered with :func:`query`; the check SQL may use the shared views of ``plans.sqlviews`` by name and
is completed with exactly those it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return wrap
