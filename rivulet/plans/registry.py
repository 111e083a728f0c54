"""Registry of named queries: ``(spark, sf_dir) -> DataFrame`` plus oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(name: str, sql: str | None = None):
    """Register a query builder; ``sql`` is its DuckDB twin (None = rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import every module that registers queries."""
    from rivulet.plans import (  # noqa: F401
        q_flow, q_sources, q_sinks, q_transform, q_routing, q_control, q_sql, q_functions,
        q_history, q_streaming, q_hard, q_scale,
    )
