"""How queries are registered: a function and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2026-10-04 04:30:00'"


def query(sql: str | None = None):
    """Registers a query with its SQL, if it has any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a SELECT over one of the tables."""
    columns, rest = sql.removeprefix("SELECT ").replace("{", "{{").replace("}", "}}").rsplit(" FROM ", 1)
    name, _, where = rest.partition(" WHERE ")
    return spark.sql(f"SELECT {columns} FROM {{t}}" + (f" WHERE {where}" if where else ""), t=table(spark, sf_dir, name))


def now() -> Column:
    return F.expr(NOW)


def flat(a: Column) -> Column:
    """An array as text, for results that are compared as values."""
    return F.array_join(a, "|")
