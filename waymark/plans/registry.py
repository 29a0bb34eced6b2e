"""Decorator that registers a query with its DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ["clouds", "joins", "windows", "rasters", "estimates", "documents", "streams", "composites", "graphs", "registrations", "inertia", "acceptance"]


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(views) as a query; sql is what DuckDB runs on the same tables and views."""

    def register(f: Callable[[Views], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    for m in MODULES:
        importlib.import_module(f"waymark.plans.{m}")
