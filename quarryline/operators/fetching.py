"""Accounts of fetching: outcomes that add up, reports per class, upgrades of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import marked_rows


def outcomes(df: DataFrame, unit: list[str], ok: Column, reason: Column, cap: int, ended: Column, told_at_cap: bool = False) -> DataFrame:
    """Of each unit: selected, accepted and failed rows, the shortfall of a unit that ended below the cap, and why.

    ``reason`` of a row that isn't ``ok`` falls back to ``other``. A unit that
    stopped for its budget has no licensed count; ``balanced`` tells that the
    counts add up. With ``told_at_cap``, a unit that ended at its cap or above
    it has no shortfall, but why it ended and its licensed count are told too.
    """
    good = F.coalesce(ok, F.lit(False))
    marked = df.withColumn("_ok", good).withColumn("_why", F.when(~good, F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit("other")))).withColumn("_end", ended)
    one = marked.groupBy(*unit).agg(F.count(F.lit(1)).alias("selected"), F.count_if("_ok").alias("accepted"), F.count("_why").alias("failed"), F.max("_end").alias("_end"))
    exhausted = F.col("_end").isNotNull() & (F.col("accepted") < cap)
    told = F.col("_end").isNotNull() if told_at_cap else exhausted
    return one.select(
        *unit, "selected", "accepted", "failed",
        F.when(exhausted, F.lit(cap) - F.col("accepted")).otherwise(0).alias("shortfall"),
        F.when(told, F.col("_end")).alias("exhausted_reason"),
        F.when(told & (F.col("_end") != "replacement_budget"), F.col("selected")).alias("licensed"),
        (F.col("selected") == F.col("accepted") + F.col("failed")).alias("balanced"),
    )


def histogram(df: DataFrame, unit: list[str], reason: Column) -> DataFrame:
    """Rows per unit and reason; rows without a reason aren't counted."""
    return df.select(*unit, reason.alias("reason")).where("reason IS NOT NULL AND reason <> ''").groupBy(*unit, "reason").agg(F.count(F.lit(1)).alias("n"))


def combined(df: DataFrame, unit: list[str], priority: DataFrame) -> DataFrame:
    """Sums of the parts of a unit; of their reasons the one of the highest ``priority(exhausted_reason, rank)``."""
    ranked = df.join(priority, "exhausted_reason", "left")
    return ranked.groupBy(*unit).agg(
        F.sum("selected").alias("selected"), F.sum("accepted").alias("accepted"), F.sum("failed").alias("failed"), F.max_by("exhausted_reason", "rank").alias("exhausted_reason")
    )


def class_report(df: DataFrame, label: str, regional: Column, taxon: Column) -> DataFrame:
    """Of each class: rows, regional and other rows, distinct taxa that aren't blank."""
    near = F.coalesce(regional, F.lit(False))
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(near).alias("regional"), F.count_if(~near).alias("worldwide"), F.count_distinct(F.nullif(F.trim(taxon), F.lit(""))).alias("taxa")
    )


def examples(df: DataFrame, label: str, order: str, value: Column, most: int = 5) -> DataFrame:
    """Of each class: how many rows there are, and the first ``most`` values in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    first = df.select(label, order, value.alias("_v")).withColumn("_n", n).where(F.col("_n") <= most)
    lists = first.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]).alias("examples"))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(lists, label)


def upgraded(df: DataFrame, columns: list[str], verified: DataFrame, resource: Column, url: str) -> DataFrame:
    """Rewrites http URLs that ``verified(host, path)`` vouches for: all of a row's columns or none.

    Adds ``reason`` of a row that keeps an http URL. ``resource`` gives the
    struct of host and path of the column named ``url``.
    """
    out = marked_rows(df)
    long = out.select("_row", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(url)) for c in columns])).alias("_c")).select("_row", "_c.*")
    http = long.where(F.lower(F.trim(url)).startswith("http://")).withColumn("_k", resource)
    known = verified.select(F.col("host").alias("_h"), F.col("path").alias("_p")).distinct()
    met = http.join(known, (F.col("_k.host") == F.col("_h")) & (F.col("_k.path") == F.col("_p")), "left")
    verdict = met.groupBy("_row").agg(F.bool_and(F.col("_h").isNotNull()).alias("_all"))
    joined = out.join(verdict, "_row", "left")
    all_ok = F.coalesce("_all", F.lit(True))
    new = {c: F.when(all_ok, F.regexp_replace(F.col(c), r"^\s*(?i:http)://", "https://")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).withColumn("reason", F.when(~all_ok, "https_not_verified_for_url")).drop("_row", "_all")


def dropped_per_class(dropped: DataFrame, label: str) -> DataFrame:
    """Dropped rows of each class; those without one count under a blank name."""
    return dropped.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias(label)).agg(F.count(F.lit(1)).alias("n"))
