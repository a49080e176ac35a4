"""Catalog of named queries: a Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.sqlviews import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def study(name: str, sql: str | None = None, views: str = ""):
    """Register a query; `views` names the SQL views its oracle starts from."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register


def run(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Run one study, several, or all of them by name; every value is a lazy DataFrame."""
    chosen = list(QUERIES) if names is None else names
    unknown = [n for n in chosen if n not in QUERIES]
    if unknown:
        raise KeyError(f"unknown studies: {unknown}")
    return {n: QUERIES[n](spark, folder) for n in chosen}
