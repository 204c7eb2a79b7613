"""Registered queries: a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Registers the decorated function under its own name."""

    def add(run: Run) -> Run:
        if run.__name__ in QUERIES:
            raise ValueError(f"duplicate query {run.__name__}")
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add
