"""Registered queries: one Spark query per operator row, each bound to the
driver's tables, with the DuckDB SQL that must return the same rows.

Each query module calls :func:`register`; ``__spark_entry__`` only reads
:data:`REGISTRY`.
"""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

_MODULES = ("demand", "cleaning", "quality", "calendar", "joins", "reshape", "carbon",
            "ledger", "forecasting", "geo", "network", "graph", "routes", "models", "streams", "sources",
            "ledger_events", "feeds", "mapfeed", "deliveries")


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    for m in _MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    return REGISTRY
