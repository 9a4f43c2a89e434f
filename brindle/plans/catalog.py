"""Every query of the engine itself, by name, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "hybrid_rrf"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` states the same result for DuckDB."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from brindle.plans import base_queries, engine_queries, graph_queries, search_queries, text_queries  # noqa: F401


_load()
