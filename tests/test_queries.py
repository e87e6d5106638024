"""Every query of the library against its SQL in DuckDB: columns, types and rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from quarryline.plans import catalogue

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    expected = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    rows = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    near = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert Counter(near(r) for r in df.select(*columns).collect()) == Counter(map(near, rows))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    run = catalogue.queries()[name]
    first = Counter(map(tuple, run(spark, SF).collect()))
    assert first and first == Counter(map(tuple, run(spark, SF).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["split_integrity_kept"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    plan = catalogue.queries()["benchmark_leak_gate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
