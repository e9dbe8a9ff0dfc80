"""All registered queries."""

from __future__ import annotations

from muletrace.plans import registry, sqlviews
from muletrace.plans import account_queries, case_queries, export_queries, geo_queries, graph_queries, model_queries, ring_queries, serve_queries, whole_queries  # noqa: F401


def all_queries() -> dict[str, registry.QueryFn]:
    return dict(registry.QUERIES)


def all_check_sql() -> dict[str, str]:
    return {n: sqlviews.complete(s) for n, s in registry.CHECK_SQL.items()}
