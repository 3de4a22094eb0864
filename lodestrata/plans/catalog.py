"""Registry of the named queries and their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

FLAGSHIP = "R01_cadence"

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Decorator that registers ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


MODULES = ("q_relational", "q_stats", "q_match", "q_state", "q_grid", "q_lines", "q_sources")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lodestrata.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
