"""Evaluation of decisions: outcomes, rates with bounds, buckets of expected names, long metrics and their deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import wilson


def safe(d: Column) -> Column:
    """Rejected, or a candidate list that warns: of low confidence or a dangerous group."""
    return (d["status"] == "rejected") | ((d["status"] == "candidates") & (d["low_confidence"] | d["dangerous"]))


def confident(d: Column, names: list[str]) -> Column:
    """The first candidate is one of ``names`` and nothing warns."""
    return F.coalesce(strict_top(d, names) & ~d["dangerous"], F.lit(False))


def strict_top(d: Column, names: list[str]) -> Column:
    """The first candidate is one of ``names`` and the result isn't of low confidence, whatever else is warned of."""
    return F.coalesce((d["status"] == "candidates") & ~d["low_confidence"] & F.get(d["top3"], 0).isin(*names), F.lit(False))


def rate(holds: Column) -> Column:
    """The share of rows that hold; null on no rows."""
    return F.avg(F.coalesce(holds, F.lit(False)).cast("double"))


def buckets(df: DataFrame, name: str, expected: DataFrame, counts: dict[str, Column], bound: str) -> DataFrame:
    """Support and counts of every expected name, with zeros, and of names that weren't expected; with bounds of the rate of ``bound``.

    ``expected`` has the column ``name``. Bounds are null without support.
    """
    got = df.groupBy(name).agg(F.count(F.lit(1)).alias("support"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in counts.items()])
    out = expected.select(name).distinct().withColumn("expected", F.lit(True)).join(got, name, "full_outer").withColumn("expected", F.coalesce("expected", F.lit(False)))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("support", *counts)})
    low, high = wilson(F.col(bound), F.greatest("support", F.lit(1)))
    return out.withColumn("lower", F.when(F.col("support") > 0, low)).withColumn("upper", F.when(F.col("support") > 0, high))


def steal_rates(df: DataFrame, truth: str, guess: str, stolen: Column, classes: DataFrame) -> DataFrame:
    """For every class: support, rows taken away from it by a guess that ``stolen`` names, and their rate; null on support 0."""
    got = df.groupBy(truth).agg(F.count(F.lit(1)).alias("support"), F.count_if(stolen).alias("taken"))
    out = classes.select(truth).distinct().join(got, truth, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("support", "taken")})
    return out.withColumn("rate", F.try_divide("taken", "support"))


def metrics(one: DataFrame) -> DataFrame:
    """A frame of one row of numbers as long ``metric, value``."""
    return one.select(*[F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value")


def delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """``metric, delta`` of two long reports, right minus left; null unless both are finite."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    both = left.select("metric", F.col("value").alias("a")).join(right.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    return both.select("metric", (finite("b") - finite("a")).alias("delta"))


def every(df: DataFrame, holds: Column) -> DataFrame:
    """One row: ``complete`` is true if all rows hold; false on none."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(holds, F.lit(False))), F.lit(False)).alias("complete"))


def strict_sum(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Sums that are null if any input isn't a whole count."""
    return df.groupBy(*keys).agg(F.when(F.bool_and(value.isNotNull()), F.sum(value)).alias("total"))


def attributed(unverified: Column, licence: Column, text: Column, url: Column, creator: Column, image_url: Column, source_url: Column) -> Column:
    """Whether a row's credit is complete: verified, an exact id that may be trained on, a creator, and, but for the restricted set, an image and a source.

    Non-commercial and share-alike ids also need text and https URL of that
    very licence and version. An unversioned or unknown id isn't exact.
    """
    from ..functions import licences

    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    family = licences.family(licence)
    strict = (licences.photo_decision(F.coalesce(F.nullif(text, F.lit("")), licence), url) == "") & (licences.parsed(F.coalesce(F.nullif(text, F.lit("")), licence), url) == licence)
    placed = (licence == "df20") | ((~family.isin("cc-by-nc", "cc-by-sa") | strict) & filled(image_url) & filled(source_url))
    return F.coalesce(~F.coalesce(unverified, F.lit(False)) & licences.usage(licence).isNotNull() & (F.trim(creator) != "") & placed, F.lit(False))


def unknown_metrics(df: DataFrame, unknown: Column, known: Column, found: Column, taken: Column, name: str, relation: str, label: str, watched: list, least: int = 10) -> DataFrame:
    """``metric, name, support, rate`` of how unknown kinds are met: one pass over the rows.

    ``unknown`` marks held-out rows, ``found`` those whose first guess is the
    hidden class, ``known`` rows of shown classes, and ``taken`` those that a
    decision gives to the hidden class. Rates: recall of held-out rows, over
    all, by taxon of ``least`` rows or more and by relation; known rows taken,
    over all and of each ``watched`` label. A rate without support is null;
    watched labels without rows keep theirs; a blank taxon is none.
    """
    rows = df.select(unknown.alias("u"), known.alias("k"), found.alias("f"), taken.alias("t"), F.col(name).cast("string").alias("taxon"), F.col(relation).cast("string").alias("relation"), F.col(label).cast("string").alias("label"))
    cases = {
        "held_out_recall": (F.col("u"), F.lit(""), F.col("f")), "taxon_recall": (F.col("u") & (F.col("taxon") != ""), F.col("taxon"), F.col("f")),
        "relation_recall": (F.col("u"), F.col("relation"), F.col("f")), "known_taken": (F.col("k"), F.lit(""), F.col("t")),
        "watched_taken": (F.col("k") & F.col("label").isin(*map(str, watched)), F.col("label"), F.col("t")),
    }
    each = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(m).alias("metric"), n.alias("name"), hit.alias("hit"))) for m, (test, n, hit) in cases.items()]))
    got = rows.select(F.explode(each).alias("x")).select("x.*").groupBy("metric", "name").agg(F.count(F.lit(1)).alias("support"), rate(F.col("hit")).alias("rate"))
    spark = df.sparkSession
    expected = spark.createDataFrame([("held_out_recall", ""), ("known_taken", ""), *(("watched_taken", str(w)) for w in watched)], "metric string, name string")
    out = expected.join(got, ["metric", "name"], "full_outer").withColumn("support", F.coalesce("support", F.lit(0)))
    return out.where((F.col("metric") != "taxon_recall") | (F.col("support") >= least))
