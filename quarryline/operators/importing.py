"""Rows from outside: nested media, ordered rejects, conflicts of label, winners, and the merge with what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text, urls
from .graph import linked_rows
from .ordering import marked_rows
from .reports import first_reason


def media_rows(df: DataFrame, media: str, accepted: Column, key: str) -> DataFrame:
    """A row per accepted still image of a nested list: ``key, ordinal, url, creator, licence``, and what its URL fails on.

    ``accepted`` judges the column ``m``, a struct of ``type, url, licence`` and
    the four credit fields, of which the first that isn't blank is taken.
    """
    each = df.select(key, F.posexplode(media).alias("ordinal", "m")).where((F.col("m.type") == "StillImage") & (names.first_text(F.col("m.url")) != "") & accepted)
    credit = names.first_text(*[F.col(f"m.{c}") for c in ("creator", "rights_holder", "recorded_by", "publisher")])
    return each.select(
        key, "ordinal", F.trim("m.url").alias("url"), text.printable(credit).alias("creator"), F.trim("m.licence").alias("licence"), urls.url_problem(F.trim("m.url")).alias("problem")
    )


def judged(df: DataFrame, rules: list[tuple[str, Column]], silent: Column | None = None) -> DataFrame:
    """Adds ``reason``, the first rule that rejects a row; null for a kept one.

    Where ``silent`` holds a rejected row leaves no trace in the report: its
    reason is empty.
    """
    reason = first_reason(rules)
    if silent is not None:
        reason = F.when(reason.isNotNull() & F.coalesce(silent, F.lit(False)), "").otherwise(reason)
    return df.withColumn("reason", reason)


def without_label_conflicts(df: DataFrame, keys: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows none of whose ``keys`` stands under two labels, and the keys that do with their labels."""
    held = marked_rows(df)
    pairs = held.select(F.explode(keys).alias("key"), F.col(label).alias("label")).distinct()
    bad = pairs.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("labels")).where("size(labels) > 1")
    hit = held.select("_row", F.explode(keys).alias("key")).join(bad, "key", "left_semi").select("_row").distinct()
    return held.join(hit, "_row", "left_anti").drop("_row"), bad


def winners(df: DataFrame, row: str, keys: str, label: str, rank: str) -> DataFrame:
    """Every row with its ``verdict``: ``conflict``, ``kept`` or ``duplicate``.

    Keys under two labels go first, with all rows that hold them. The others
    are grouped by shared keys; a group that joins two labels through a chain
    of keys is a conflict too. Of each group the row of the highest rank stays,
    the first of equals.
    """
    clean, _ = without_label_conflicts(df, keys, label)
    parts = linked_rows(clean, row, keys)
    own = clean.join(parts, row)
    w = Window.partitionBy("component")
    several = F.min(label).over(w) != F.max(label).over(w)
    n = F.row_number().over(w.orderBy(F.desc(rank), row))
    told = own.select(row, F.when(several, "conflict").when(n == 1, "kept").otherwise("duplicate").alias("verdict"))
    return df.select(row).join(told, row, "left").withColumn("verdict", F.coalesce("verdict", F.lit("conflict")))


def appended(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """All rows of both; those of ``new`` continue the order where ``existing`` ends."""
    last = existing.agg(F.coalesce(F.max(order), F.lit(0)).alias("_last"))  # one row
    moved = new.join(F.broadcast(last)).withColumn(order, F.col(order) + F.col("_last")).drop("_last")
    return existing.unionByName(moved, allowMissingColumns=True)


def ordered_limit(df: DataFrame, group: list[str], item: str, per_item: int, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows of a group in order, of each item at most ``per_item``."""
    each = F.row_number().over(Window.partitionBy(*group, item).orderBy(*order))
    all_ = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_k", each).where(F.col("_k") <= per_item).withColumn("_n", all_).where(F.col("_n") <= limit).drop("_k", "_n")


def tagged(parsed: Column, kinds: list[str]) -> Column:
    """The candidates of a decision whose id isn't blank and whose score is a number, best first; ``kind`` falls back to the last of ``kinds``."""
    good = F.filter(parsed["candidates"], lambda c: (names.first_text(c["id"]) != "") & c["score"].isNotNull())
    ordered = F.array_sort(good, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    kind = F.when(parsed["kind"].isin(*kinds), parsed["kind"]).otherwise(kinds[-1])
    return F.struct(kind.alias("kind"), F.coalesce(ordered, F.array()).alias("candidates"))
