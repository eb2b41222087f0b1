"""Registered queries: the Spark job and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyview.session import table_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without SQL it is checked by a unit test instead."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def r6(value: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def q6(expr: str) -> str:
    """The same in SQL."""
    return f"round(({expr})::DOUBLE, 6) + 0.0::DOUBLE"
