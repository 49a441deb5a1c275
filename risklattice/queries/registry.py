"""Name → query and name → SQL maps, filled by the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "slice_zero", "sources", "projections", "filters", "joins", "imputation", "aggregates",
    "windows", "episodes", "evaluation", "reports", "diagnostics", "models", "boosting", "logit", "sets", "plans",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")
