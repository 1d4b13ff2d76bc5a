"""Registry of queries: name -> Spark callable, and the DuckDB statement with the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}
_IDS: dict[str, tuple[str, ...]] = {}


def query(*ids: str, sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Registers a query under its function name; ``ids`` are the inventory rows it covers."""

    def register(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key], _IDS[key] = fn, ids
        if sql is not None:
            _ORACLES[key] = sql
        return fn

    return register


def _import_plans() -> None:
    import searchlake.plans as plans

    for found in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        importlib.import_module(f"searchlake.plans.{found.name}")


def all_queries() -> dict[str, QueryFn]:
    _import_plans()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _import_plans()
    return dict(_ORACLES)


def covered() -> dict[str, tuple[str, ...]]:
    _import_plans()
    return dict(_IDS)
