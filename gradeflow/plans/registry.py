"""The registered queries: an operator of this package over the given tables.

Each query carries the SQL that checks it, written apart from the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gradeflow.plans.tables import Tables

_MODULES = ("scoring", "annotations", "selection", "files", "prompts", "catalog", "jobs", "models")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its name, with its check query."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"gradeflow.plans.{module}_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
