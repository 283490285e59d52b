"""Queries over the test data: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def everything() -> dict[str, tuple[Query, str | None]]:
    from . import arms, batch, evals, gates, graphs, metrics, more, passes, recall, reversal, scalar, sinks, streams, tables, times

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (tables, times, scalar, recall, graphs, batch, metrics, more, sinks, gates, arms, passes, reversal, evals, streams):
        found |= module.QUERIES
    return found
