"""Materialised stages: evidence, candidate sets and beliefs are computed once per session.

A stage is a reliable checkpoint in the shared folder, so lost executors re-read it instead of
recomputing the log, and later jobs of the same session start from it.
"""
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from placeproof.session import checkpoint

_STAGES: dict[tuple, DataFrame] = {}


def stage(v, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (v.spark.sparkContext.applicationId, v.sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = checkpoint(build())
    return _STAGES[key]


def together(spark, builds: list[Callable[[], object]]) -> None:
    """Build independent stages at the same time: their jobs share the executors instead of leaving them idle between small jobs."""
    threads = [InheritableThread(target=b, session=spark) for b in builds]
    for t in threads:
        t.start()
    for t in threads:
        t.join()


def forget() -> None:
    """Drop all stage handles (the next job recomputes)."""
    _STAGES.clear()
