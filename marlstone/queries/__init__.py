"""Every registered query with the DuckDB SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("tpch", "relational", "aggregates", "windows", "scalars", "views", "datasets", "sources", "spatial", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} comes twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
