"""Splits without leaks: whole components go to train, val or test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .ordering import marked_rows, running_sums

SPLITS = ("train", "val", "test")


def hashed_split(component: Column, val: float = 0.15, test: float = 0.15, salt: str = "") -> Column:
    """A split from the component's digest alone: no order, no state, the same on any cluster."""
    place = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), component.cast("string")), 256), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return F.when(place < test, "test").when(place < test + val, "val").otherwise("train")


def split_components(df: DataFrame, label: str, component: str, blocked: Column, val: float = 0.15, test: float = 0.15, seed: int = 0) -> DataFrame:
    """Adds ``split``: whole components go to test, then to val, up to the class's shares, and the rest to train.

    A component belongs to the first of its classes. Within a class components
    come in the order of a seeded digest. Those that aren't blocked are taken
    for test while less than the class's share of rows is, then the others for
    val; either leaves a row of the class to the splits after it. A class of
    fewer than three components goes to train whole. A null ``blocked`` doesn't
    block; rows without a component share one of their own.

    Shares are running sums over range-sorted components (``running_sums``), so
    no class has to fit one task and nothing passes through the driver.
    """
    name = F.coalesce(F.col(component).cast("string"), F.lit(""))
    parts = df.groupBy(name.alias("_c")).agg(F.coalesce(F.min(F.col(label).cast("string")), F.lit("")).alias("_class"), F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or(blocked), F.lit(False)).alias("_blocked"))
    parts = checkpointed(parts.withColumn("_place", F.sha2(F.concat(F.lit(f"{seed}:"), "_class", F.lit(":"), "_c"), 256)))
    totals = parts.groupBy(F.col("_class").alias("_of")).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_parts"))
    first = running_sums(parts, ["_class"], {"_before": "_n"}, "_blocked", "_place", "_c").join(totals, F.col("_class") == F.col("_of"))
    many = F.col("_parts") >= 3
    in_test = many & ~F.col("_blocked") & (F.col("_before") < F.bround(F.col("_rows") * test)) & (F.col("_before") + F.col("_n") < F.col("_rows"))
    marked = first.withColumn("_test", in_test)
    rest = running_sums(marked.where("NOT _test"), ["_class"], {"_later": "_n"}, "_place", "_c")
    left = F.sum("_n").alias("_left")
    lefts = marked.where("NOT _test").groupBy(F.col("_class").alias("_of2")).agg(left)
    in_val = many & (F.col("_later") < F.bround(F.col("_rows") * val)) & (F.col("_later") + F.col("_n") < F.col("_left"))
    others = rest.join(lefts, F.col("_class") == F.col("_of2")).select("_c", F.when(in_val, "val").otherwise("train").alias("split"))
    table = marked.where("_test").select("_c", F.lit("test").alias("split")).unionByName(others)
    return df.withColumn("_key", name).join(table, F.col("_key") == F.col("_c")).drop("_key", "_c")


def broken(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split: empty when nothing leaks."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def held_out_of_place(df: DataFrame, held_out: Column, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """The rows without held-out ones outside test, and those."""
    bad = F.coalesce(held_out, F.lit(False)) & (F.col(split) != "test")
    return df.where(~bad), df.where(bad)


class LeakingSplit(ValueError):
    """A test row that holds a key of the reference."""


def assigned(df: DataFrame, label: str, component: str, keys: str, reference: DataFrame, key: str = "key", val: float = 0.15, test: float = 0.15, seed: int = 0) -> DataFrame:
    """``split_components`` in which a component with a row that holds a ``key`` of the reference never goes to test, checked afterwards.

    ``keys`` is an array column. A test row with a reference key fails the
    whole assignment: the check doesn't trust how the split came about.
    """
    known = reference.select(F.col(key).alias("_key")).distinct()
    held = marked_rows(df, "_at")
    hit = held.select("_at", F.explode(keys).alias("_key")).join(known, "_key", "left_semi").select("_at").distinct().withColumn("_hit", F.lit(True))
    out = checkpointed(split_components(held.join(hit, "_at", "left"), label, component, F.col("_hit"), val, test, seed))
    leaks = out.where("split = 'test'").select(F.explode(keys).alias("_key")).join(known, "_key", "left_semi").limit(5).collect()
    if leaks:
        raise LeakingSplit(f"keys of the reference in test: {[r[0] for r in leaks]}")
    return out.drop("_at", "_hit")
