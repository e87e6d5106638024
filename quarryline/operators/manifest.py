"""A manifest of a dataset: counts, and digests that can be carried on when rows are added.

A row's line is canonical JSON of its fields: sorted keys, no spaces, blank
ones left out. The digest of a set of rows is made of the sums of the words of
the lines' SHA-256 digests, so that it doesn't depend on order or partitions,
repeated rows count, and the sums of two halves add up to those of the whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that identify a row of the dataset.
FIELDS = (
    "class_id", "taxon_name", "license", "license_normalized", "image_url", "source_url", "file", "prepared_file", "sha256", "inat_observer", "author", "creator",
    "recorded_by", "recordedBy", "photographer_rightsHolder", "inat_photo_id", "inat_observation_id", "mo_observation_id", "observationID", "observation_id",
    "ImageUniqueID", "occurrence_key", "gbifID", "commons_file", "licence_note",
)
WORDS = [f"w{i}" for i in range(8)]


def canonical_line(fields: list[str], **more: Column) -> Column:
    """Canonical JSON of ``fields`` and ``more``: keys in order, null and empty values left out, control characters escaped in lower case."""
    values = {**{f: F.col(f"`{f}`") for f in fields}, **more}
    filled = {k: F.when(v.cast("string") != "", v) for k, v in values.items()}
    line = F.to_json(F.struct(*[filled[k].alias(k) for k in sorted(filled)]))
    lower = line
    for digit in "ABCDEF":
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(line.contains("\\u00"), lower).otherwise(line)


def sums(df: DataFrame, line: Column, *keys: str) -> DataFrame:
    """``keys, n, w0 .. w7``: rows and the sums of the 32-bit words of their lines' digests; exact for any number of rows."""
    digest = F.sha2(line, 256)
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)").alias(w) for i, w in enumerate(WORDS)]
    return df.select(*keys, *words).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).cast("decimal(38,0)").alias(w) for w in WORDS])


def merged(parts: list[DataFrame], *keys: str) -> DataFrame:
    """The sums of the union of disjoint sets of rows, from their sums."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(w).cast("decimal(38,0)").alias(w) for w in WORDS])


def digest() -> Column:
    """SHA-256 of the count and the sums modulo 2**64, in decimal and with commas between."""
    wide = F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.sha2(F.concat_ws(",", F.col("n"), *[(F.col(w) % wide).cast("decimal(20,0)").cast("string") for w in WORDS]), 256)


def manifest(state: DataFrame, split: str, label: str, splits: list[str], salt: str, config: str, withheld: DataFrame) -> DataFrame:
    """``part, split, label, n, digest``: the manifest as rows.

    ``state`` holds sums by split and label. ``class``: every split with every
    label, zeros included; ``split``: totals; ``content``: all rows.
    ``salt`` and ``config`` give only digests, the salt's eight hex digits
    long. ``withheld``: rows of ``withheld(label, reason)`` by label and
    reason, the reason in place of a split.
    """
    none = F.lit(None).cast("string")
    row = lambda df, part, s, c: df.select(F.lit(part).alias("part"), s.alias("split"), c.alias("label"), "n", "digest")
    labels = state.select(label).distinct().withColumn(split, F.explode(F.array(*map(F.lit, splits))))
    each = labels.join(state.withColumn("digest", digest()).select(split, label, "n", "digest"), [split, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = merged([state.select(split, "n", *WORDS)], split).withColumn("digest", digest())
    whole = merged([state.select("n", *WORDS)]).withColumn("n", F.coalesce("n", F.lit(0))).na.fill(0, WORDS).withColumn("digest", digest())
    kept_back = withheld.groupBy(F.coalesce("label", F.lit("")).alias("label"), "reason").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", none)
    one = whole.select(F.lit(0).cast("long").alias("n"))
    out = [
        row(each, "class", F.col(split), F.col(label)), row(total, "split", F.col(split), none), row(whole, "content", none, none),
        row(one.withColumn("digest", F.left(F.sha2(F.lit(salt), 256), F.lit(8))), "salt", none, none),
        row(one.withColumn("digest", F.sha2(F.lit(config), 256)), "config", none, none),
        row(kept_back, "withheld", F.col("reason"), F.col("label")),
    ]
    return reduce(DataFrame.union, out)
