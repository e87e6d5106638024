"""Queries on tables that hold what the given ones don't: more rows of a class, values around zero, larger groups."""

from __future__ import annotations

from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quarryline.functions import ids
from quarryline.operators import dedup, fetching, lookups
from quarryline.plans import catalogue
from quarryline.streaming import journal


def both(spark, folder, name, table):
    """Rows of a query and of its SQL over one table of a folder."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    expected = con.sql(catalogue.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in df.columns])
    return Counter(map(tuple, df.collect())), Counter(expected.fetchall())


def test_units_that_reach_the_cap_say_why_they_ended(spark, tmp_path):
    row = F.col("id")
    price = F.when(row % 200_000 < 120_000, 70_000.0).otherwise(10.0)
    orders = spark.range(400_000).select(row.alias("o_orderkey"), F.when(row < 200_000, 2).otherwise(F.when(row < 200_100, 7).otherwise(1)).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), price.alias("o_totalprice"), F.lit("5-LOW").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got, expected = both(spark, tmp_path, "fetch_outcomes", "orders")
    assert got == expected and ("c2", 200_000, 120_000, 80_000, 0, "end_of_records", 200_000, True) in got
    few = spark.createDataFrame([("u", True), ("u", False)], "unit string, ok boolean")
    told = fetching.outcomes(few, ["unit"], F.col("ok"), F.lit("x"), 1, F.lit("end_of_records")).first()
    assert (told.shortfall, told.exhausted_reason, told.licensed) == (0, None, None)


def test_places_around_zero(spark, tmp_path):
    balances = [-0.51, -0.5, -0.3, -0.01, 0.0, 0.01, 0.5, 1.5, -1.5, 57.995, -99.0]
    rows = [(i, f"Customer#{i}", b, "FURNITURE") for i, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got, expected = both(spark, tmp_path, "geo_grid_key", "customer")
    assert got == expected and (2, "grid:FURNITURE:customer#2:-0.00:2.00", True) in got
    place = spark.createDataFrame([(-0.003, 0.003, "c"), (0.003, -0.003, "c"), (1.0, 1.0, None)], "lat double, lon double, c string")
    keys = [r.k for r in place.select(ids.grid_key(F.col("c"), F.lit("p"), F.col("lat"), F.col("lon")).alias("k")).collect()]
    assert keys == ["grid:c:p:0.00:0.00"] * 2 + [None]


def test_an_owners_journal_costs_two_calls_of_state_a_batch():
    class Value:
        calls, held = 0, None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    value = Value()
    handle = type("Handle", (), {"getValueState": lambda self, name, schema: value})()
    newest = journal.Newest(6)
    newest.init(handle)
    first = list(newest.handleInputRows(("a",), iter([("a", f"i{n % 40}", n, f"p{n}") for n in range(400)]), None))
    assert value.calls == 2 and {r.seq for r in first} == set(range(394, 400)) and all(r.live for r in first)
    again = list(newest.handleInputRows(("a",), iter([("a", "i39", 400, None), ("a", "i1", 3, "late")]), None))
    assert value.calls == 4 and [tuple(r) for r in again] == [("a", "i39", 400, None, False)]


def test_split_makes_windows_of_texts_once_and_sends_those_of_the_benchmark(spark):
    plan = catalogue.queries()["split_leak_free"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ReadSchema: struct<doc_id:bigint,text:string" not in plan
    plan = catalogue.queries()["benchmark_leak_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    large = lookups.sent(spark.range(11).withColumn("k", F.col("id")), 10)
    assert "broadcast" not in large._jdf.queryExecution().logical().toString().lower()


def test_hashing_remembers_a_bounded_number_of_words(monkeypatch):
    made = Counter()

    def digest(word):
        made[word] += 1
        return int(word)

    monkeypatch.setattr(dedup, "MOST_KNOWN", 100)
    texts = [" ".join(str(50 * i + j) for j in range(50)) for i in range(5)] + ["0 0 1", "", None, " ".join(map(str, range(5000)))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["n", "text"])
    (out,) = dedup._hashed(iter([batch]), str.split, digest)
    expected = []
    for t in texts:
        words = [int(w) for w in (t or "").split()]
        expected.append(sum(1 << i for i in range(64) if 2 * sum(w >> i & 1 for w in words) > len(words)) if words else None)
    assert out.column("hash").to_pylist() == expected and out.schema.names == ["n", "hash"]
    assert made["0"] == 3  # once, once more after the others had filled the table, and once with the last text
