"""Name -> (plan, oracle text) tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellset.sources.surrogates import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan ``fn(tables)``; ``sql`` may use the surrogate view names, which become leading CTEs."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def r6(expression: str) -> str:
    """Oracle text for a value compared at six digits (adding 0.0 turns -0.0 into 0.0)."""
    return f"(round(cast({expression} as double), 6) + 0.0)"
