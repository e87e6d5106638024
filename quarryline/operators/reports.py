"""Counts, shares, digests and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breakdown(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ``a``, by ``b``, by both and in all, told apart by ``level`` (grouping id)."""
    return df.groupingSets([[a], [b], [a, b], []], a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def zero_filled(dimension: DataFrame, keys: list[str], df: DataFrame, name: str = "n") -> DataFrame:
    """Counts for every row of ``dimension``, 0 where there is none; other keys are ignored."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return dimension.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does; a null condition doesn't hold."""
    out = None
    for name, holds in rules:
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def content_digest(df: DataFrame, line: Column, *keys: str) -> DataFrame:
    """SHA-256 of the sorted lines: the same for any order of rows.

    Lines are first reduced to a digest per range of their hash, so no group
    gathers the lines themselves; the digests of 65,536 ranges meet in the end.
    """
    digest = F.sha2(line, 256)
    ranges = df.select(*keys, digest.alias("_d")).groupBy(*keys, F.substring("_d", 1, 4).alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_list("_d")), "\n").alias("_l"))
    parts = ranges.select(*keys, "_r", "_n", F.sha2("_l", 256).alias("_p"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_p"))), lambda x: x["_p"]), "\n"), 256).alias("digest"))


def largest_share(df: DataFrame, label: str, component: str, limit: float, acknowledged: DataFrame | None = None) -> DataFrame:
    """Of each class: rows, largest component with its share, and ``ok``, ``blocker`` (acknowledged) or ``stop``."""
    if not 0 < limit <= 0.20:
        raise ValueError("the limit lies in (0, 0.20]")
    sizes = df.groupBy(label, component).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.groupBy(label).agg(F.sum("_n").alias("rows"), F.max(F.struct(F.col("_n"), (-F.col(component)).alias("_k"), F.col(component).alias("_c"))).alias("_t"))
    out = top.select(label, "rows", F.col("_t._c").alias("largest"), F.col("_t._n").alias("largest_rows"), (F.col("_t._n") / F.col("rows")).alias("share"))
    known = F.lit(False)
    if acknowledged is not None:
        out = out.join(acknowledged.select(label).distinct().withColumn("_ack", F.lit(True)), label, "left")
        known = F.coalesce("_ack", F.lit(False))
    out = out.withColumn("status", F.when(F.col("share") <= limit, "ok").when(known, "blocker").otherwise("stop"))
    return out.drop("_ack")


def gate(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """``seq, metric, value, passed`` of rules ``(seq, metric, op, bound)``; a missing or non-finite metric fails."""
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    holds = F.when(F.col("op") == ">=", v >= F.col("bound")).when(F.col("op") == "<=", v <= F.col("bound")).when(F.col("op") == "=", v == F.col("bound"))
    return rules.join(metrics, "metric", "left").select("seq", "metric", v.alias("value"), F.coalesce(holds, F.lit(False)).alias("passed"))


def class_weights(df: DataFrame, label: str, cap: float = 10.0) -> DataFrame:
    """Inverse-frequency weights, total / (classes present * count), at most ``cap``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # a row per class
    total, present = F.sum("n").over(w), F.count(F.lit(1)).over(w)
    return counts.withColumn("weight", F.least(F.lit(cap), total / (present * F.col("n"))))


def accuracy(df: DataFrame, truth: str, order: str, labels: DataFrame) -> DataFrame:
    """Support, top-1 and top-3 rate of every class; rates are null without support."""
    own = df.select(truth, (F.element_at(order, 1) == F.col(truth)).alias("_1"), F.array_contains(F.slice(order, 1, 3), F.col(truth)).alias("_3"))
    got = own.groupBy(truth).agg(F.count(F.lit(1)).alias("support"), F.avg(F.col("_1").cast("double")).alias("top1"), F.avg(F.col("_3").cast("double")).alias("top3"))
    return labels.join(got, truth, "left").withColumn("support", F.coalesce("support", F.lit(0)))


def confusions(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Directed pairs of true and guessed class with their share of the true class."""
    pairs = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(truth))
    return pairs.withColumn("rate", F.col("n") / total).where(F.col(truth) != F.col(guess))


def keep_threshold(df: DataFrame, value: str, rate: float = 0.97, least: int = 8) -> DataFrame:
    """``n`` and the ceil(rate * n)-th smallest value as ``threshold``; null for fewer than ``least`` rows.

    The order statistic comes from an aggregate over (value, count) pairs, so
    rows are combined before they are shuffled.
    """
    exact = F.expr(f"percentile_disc({rate}) WITHIN GROUP (ORDER BY {value})")
    return df.agg(F.count(value).alias("n"), exact.alias("threshold")).withColumn("threshold", F.when(F.col("n") >= least, F.col("threshold")))


def bootstrap(df: DataFrame, successes: str, total: str, name: str, draws: int = 1000) -> DataFrame:
    """5th and 95th percentile of a binomial bootstrap, seeded by the checksum of the row's name."""
    @F.pandas_udf("lower double, upper double")
    def bounds(s: pd.Series, n: pd.Series, seed: pd.Series) -> pd.DataFrame:
        out = []
        for k, m, x in zip(s, n, seed):
            rates = np.random.default_rng(int(x)).binomial(int(m), k / m, size=draws) / m if m else np.full(2, np.nan)
            out.append((float(np.quantile(rates, 0.05)), float(np.quantile(rates, 0.95))))
        return pd.DataFrame(out, columns=["lower", "upper"])

    return df.withColumn("_b", bounds(successes, total, F.crc32(F.col(name).cast("binary")))).select("*", "_b.lower", "_b.upper").drop("_b")
