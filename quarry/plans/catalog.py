"""Registry of named queries: Spark builder plus its DuckDB oracle SQL.

Each ``@query`` function takes ``(spark, sf_dir)`` and returns a DataFrame
whose column names equal the oracle's. ``sql=None`` marks a query that SQL
cannot express; ``tests/`` then holds it against literal cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from quarry.plans import (  # noqa: F401
        q_ingest, q_definitions, q_resolve, q_runs, q_retrieval, q_scalars,
    )
