"""Named queries with, where SQL can say it, the equivalent check."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CACHED: list = []


def shared(build: Callable) -> Callable:
    """Builds a plan (not data) once per query call, so a sub-plan used by several parts of a query is the same object."""
    cached = functools.lru_cache(maxsize=512)(build)
    _CACHED.append(cached)
    return cached


def forget_plans() -> None:
    """Before a query is built: its tables are listed anew, so files added since are read."""
    for cached in _CACHED:
        cached.cache_clear()

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.checks: dict[str, str] = {}

    def add(self, name: str, query: Query, check: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")

        def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
            forget_plans()
            return query(spark, sf_dir).select("*")

        self.queries[name] = fresh
        if check is not None:
            self.checks[name] = check

