"""Registry of the engine's own queries and their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules of millrace.plans that register queries.
PLANS = ["detection", "json_rows", "lines", "changes", "texts_and_requests", "compress", "rules_and_scores", "protection", "reports", "payloads", "rendering", "streams"]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    """Add one query; sql is None where SQL cannot express it."""
    _QUERIES[name] = run
    if sql:
        _ORACLES[name] = sql


def _load() -> None:
    """Import the plans; each registers its queries."""
    for name in PLANS:
        importlib.import_module(f"millrace.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["array_field_stats"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
