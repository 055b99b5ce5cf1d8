"""Registered queries: each pairs a Spark plan built from the operators with an equivalent DuckDB text."""

from __future__ import annotations

import importlib

from cellset.catalog.registry import ORACLES, QUERIES

MODULES = ("rows", "joins", "aggregates", "windows", "setops", "selection", "metrics", "checks", "storage", "streams",
           "inference")


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"cellset.catalog.{module}")
    return QUERIES, ORACLES
