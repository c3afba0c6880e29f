"""Collects the registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the equivalent DuckDB statement."""

    def keep(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines that add in different orders."""

    def column(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        return F.round(value, digits).alias(field.name) if isinstance(field.dataType, T.DoubleType) else value

    return df.select(*[column(f) for f in df.schema.fields])
