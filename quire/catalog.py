"""Registry of the queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query, and the DuckDB SQL that returns the same rows, under a name."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def load() -> None:
    """Import the modules that register queries."""
    importlib.import_module("quire.plans.queries")
    importlib.import_module("quire.plans.structure")
    importlib.import_module("quire.plans.pages")
