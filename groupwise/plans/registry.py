"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_to

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked, and the tests compare it with brute force."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def big(c: str | Column, name: str | None = None) -> Column:
    """Integer output column."""
    out = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    return out.alias(name or c) if isinstance(c, str) or name else out


def r6(c: str | Column, name: str | None = None) -> Column:
    """Double output column rounded to 6 places."""
    out = round_to(c, 6)
    return out.alias(name or c) if isinstance(c, str) or name else out


def r(expr: str, name: str | None = None) -> str:
    """The SQL counterpart of :func:`r6`."""
    return f"round({expr}, 6) + 0.0" + (f" AS {name}" if name else "")
