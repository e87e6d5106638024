"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """``t.orders`` reads one table of a folder; only the columns that a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(name: str, sql: str | None = None):
    """Registers ``f(tables)`` under ``name``, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def dealt(values: list) -> Column:
    """One of ``values`` for each order, by its key."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
