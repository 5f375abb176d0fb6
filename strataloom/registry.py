"""Named queries with their DuckDB oracles.

A module of ``plans`` registers a query with ``@query(name, oracle)``; the
callable takes ``(spark, sf_dir)`` and returns a DataFrame over the tables
below ``sf_dir``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("catalog", "clean", "splits", "stencil", "scores", "prompts", "descriptors", "samples")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function as query ``name``."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if oracle:
            _ORACLES[name] = oracle
        return function

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"strataloom.plans.{module}")


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    _load()
    return dict(_ORACLES)
