"""Registry of queries: a Spark job over the logical tables and, where SQL can say it, its oracle."""
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from placeproof.sources.tables import Views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a job under a name with its oracle body (view names are expanded on request)."""
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return add


def load() -> dict[str, Query]:
    from placeproof.catalog import (aggregates, domain, evaluation, expressions,  # noqa: F401
                                    joins, quality, sets, sinks, streams, studies, timelines, windows)
    return REGISTRY
