"""Decisions in order: a row is kept unless an earlier *kept* row meets it on a key.

Rows and keys are joined, never rows with rows, so a key that many rows hold
costs one row each. In a round every open row that is the first of all that it
meets is kept, and what meets a row kept now is dropped. Rounds follow the
longest chain of decisions that hang on each other; after a few of them, what
is still open falls into groups, and a group of a bounded size is walked
through inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, components

#: Rounds before groups are walked through, and between two attempts to do so.
ROUNDS = 5
#: Rows of a group that a task walks through at most.
MOST_LOCAL = 200_000


def walked(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group in order: ``keys`` of each row, and ``reach``, the keys that it bars once it is kept."""
    barred: set[str] = set()
    kept = []
    for keys, reach in zip(pdf["keys"], pdf["reach"]):
        free = barred.isdisjoint(keys)
        kept.append(free)
        if free:
            barred.update(reach)
    return pd.DataFrame({"row": pdf["row"], "kept": kept})


def _spread(of_key: DataFrame, near: DataFrame | None, value: str) -> DataFrame:
    """The least ``value`` of each key and of the keys near to it."""
    if near is None:
        return of_key
    others = near.join(of_key.withColumnRenamed("key", "other"), "other").select("key", value)
    return of_key.select("key", value).union(others).groupBy("key").agg(F.min(value).alias(value))


def settled(holds: DataFrame, near: DataFrame | None = None, rounds: int = ROUNDS, most_local: int = MOST_LOCAL) -> DataFrame:
    """``row, kept`` of every row of ``holds(row, place, key)``.

    ``place`` orders the rows and differs between them; a row of several keys
    stands there once for each. Two rows meet if they share a key, or hold two
    keys of ``near(key, other)``, which lists each such pair both ways.
    """
    left = checkpointed(holds.select("row", "place", "key").distinct())
    done, n = None, 0
    while not left.isEmpty():
        n += 1
        if n % (rounds + 1) == 0:
            new = checkpointed(_by_groups(left, near, most_local))
        else:
            least = left.groupBy("key").agg(F.min("place").alias("least"))
            first = left.join(_spread(least, near, "least"), "key").groupBy("row").agg(F.bool_and(F.col("least") == F.col("place")).alias("first"))
            kept = checkpointed(first.where("first").select("row"))
            barred = left.join(kept, "row", "left_semi").select("key").distinct()
            if near is not None:
                barred = barred.union(near.join(barred.withColumnRenamed("key", "other"), "other").select("key")).distinct()
            lost = left.join(barred, "key", "left_semi").select("row").distinct().join(kept, "row", "left_anti")
            new = checkpointed(kept.withColumn("kept", F.lit(True)).union(lost.withColumn("kept", F.lit(False))))
        done = new if done is None else checkpointed(done.union(new))
        left = checkpointed(left.join(new, "row", "left_anti"))
    return done if done is not None else holds.select("row", F.lit(True).alias("kept")).limit(0)


def _by_groups(left: DataFrame, near: DataFrame | None, most_local: int) -> DataFrame:
    """Decisions of all rows in groups of at most ``most_local`` rows."""
    least = left.groupBy("key").agg(F.min("row").alias("least"))
    links = left.join(least, "key").select(F.col("row").alias("a"), F.col("least").alias("b"))
    if near is not None:
        ends = near.join(least, "key").select("other", F.col("least").alias("a")).join(least.select(F.col("key").alias("other"), F.col("least").alias("b")), "other")
        links = links.union(ends.select("a", "b"))
    group = components(links)
    rows = left.select("row", "place").distinct().join(group, F.col("row") == F.col("node"), "left").select("row", "place", F.coalesce("label", "row").alias("group"))
    small = rows.groupBy("group").count().where(F.col("count") <= most_local).select("group")
    chosen = rows.join(small, "group", "left_semi")
    keys = left.groupBy("row").agg(F.collect_set("key").alias("keys"))
    if near is None:
        reach = keys.withColumn("reach", F.col("keys"))
    else:
        around = left.select("row", "key").union(left.join(near, "key").select("row", F.col("other").alias("key")))
        reach = keys.join(around.groupBy("row").agg(F.collect_set("key").alias("reach")), "row")
    placed = chosen.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("place"))).join(reach, "row")

    def walk(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        return walked(groups.sort_values("n"))

    kind = left.schema["row"].dataType.simpleString()
    return placed.select("group", "n", "row", "keys", "reach").groupBy("group").applyInPandas(walk, f"row {kind}, kept boolean")
