"""Query registry: each query is a function ``(spark, sf_dir) -> DataFrame``
with, where SQL can state it, the DuckDB SQL that must give the same rows.

Conventions shared by both forms: integers are BIGINT, doubles are rounded
(6 places unless stated), every computed column has the same alias.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin (None: rows only)."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return wrap


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    # Importing the modules registers their queries.
    from glossa.plans import (  # noqa: F401
        q_analysis, q_corpus, q_embed, q_retrieval, q_sae, q_sinks, q_sources, q_streaming, q_sweep,
    )
