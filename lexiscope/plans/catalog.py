"""All queries of the library and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from lexiscope.plans import corpus_queries, metrics_queries, more_queries, record_queries, text_queries

_MODULES = (metrics_queries, text_queries, more_queries, record_queries, corpus_queries)


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
