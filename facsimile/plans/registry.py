"""Named queries over the test tables, each with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def add(name: str, fn: QueryFn, sql: str | None = None) -> None:
    register(name, sql)(fn)


def load_all() -> None:
    # Importing the modules fills the registry.
    from facsimile.plans import (  # noqa: F401
        compare_queries,
        mask_queries,
        null_queries,
        profile_queries,
        source_queries,
        synth_queries,
    )
