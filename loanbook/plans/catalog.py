"""Registry of named queries and their oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` that reads the
driver tables (through the loan-book view or directly) and applies one
operator. ``oracle`` holds the DuckDB SQL twin where the operator is
expressible in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"loanbook.plans.{mod}")


MODULES = ["monitoring_queries", "capital_queries", "cleaning_queries",
           "pricing_queries", "sampling_queries", "review_queries",
           "model_queries", "woe_queries", "selection_queries",
           "source_queries", "dirty_queries"]
