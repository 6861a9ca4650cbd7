"""Registered queries: name -> function of a bound set of tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from vintagebook.plans.bindings import Bound

_QUERIES: dict[str, Callable[[Bound], DataFrame]] = {}
_MODULES = ["series_queries", "scalar_queries", "identity_queries", "table_queries", "writeup_queries", "search_queries", "profile_queries", "store_queries"]


def query(name: str):
    def register(build: Callable[[Bound], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = build
        return build

    return register


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for module in _MODULES:
        import_module(f"vintagebook.plans.{module}")

    def bind(build):
        return lambda spark, directory: build(Bound(spark, directory))

    return {name: bind(build) for name, build in sorted(_QUERIES.items())}
