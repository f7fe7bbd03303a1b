"""Queries by name, with the DuckDB SQL that gives the same rows where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.views import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("inventory", "relations", "statistics", "search", "scalars", "state")


def query(name: str, oracle: str | None = None):
    """Registers a function of Tables as the query `name`."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__doc__ = f.__doc__
        _QUERIES[name] = run
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"lodestrata.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
