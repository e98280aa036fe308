"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is its DuckDB oracle (omit for rows-only checks)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from flowlens.plans import (  # noqa: F401
        q_quality,
        q_stats,
        q_prepare,
        q_eval,
        q_attr,
        q_score,
        q_model,
        q_select,
        q_io,
    )
