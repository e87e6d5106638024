"""Duplicates by identity: conflicts of label over two kinds of key, the strictest copy, and observations that are there already.

Photo keys say that two rows are one photo, so they close transitively.
Observation keys say that two rows are of one event; rows share one or they
don't, and nothing follows for a third row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, linked_rows
from .settling import settled


def _keys(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != ""))


def label_conflicts(df: DataFrame, row: str, photos: str, observations: str, label: str) -> DataFrame:
    """``row, labels`` of the rows whose photo, by any chain of photo keys, or one of whose observations stands under several labels.

    ``labels`` unites, in order, the labels of all of the row's conflicts. Of
    a photo or observation only its distinct labels are gathered.
    """
    own = df.select(F.col(row).alias("row"), _keys(photos).alias("photos"), _keys(observations).alias("observations"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    own = checkpointed(own)
    photo = own.join(linked_rows(own, "row", "photos"), "row").select("row", "label", F.col("component").cast("string").alias("key"))
    seen = own.select("row", "label", F.explode("observations").alias("key"))
    found = None
    for held in (photo, seen):
        several = held.select("key", "label").distinct().groupBy("key").agg(F.collect_set("label").alias("labels")).where("size(labels) > 1")
        hit = held.join(several, "key").select("row", "labels")
        found = hit if found is None else found.union(hit)
    return found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))


def resolved(df: DataFrame, row: str, photos: str, observations: str, label: str, rank: str, rounds: int | None = None) -> DataFrame:
    """``row, verdict, labels`` of every row; ``row`` numbers the rows in their order.

    ``class_conflict``: see ``label_conflicts``; all rows concerned go, with
    their ``labels`` (else null). Of the others, rows of one photo leave the
    one of the highest ``rank``, the first of equals: ``looser_license`` and
    ``duplicate_photo_id`` name what the rest lost to. What is left is gone
    through in order: a row without any photo key goes
    (``duplicate_observation_id``) if a row *kept* before it shares an
    observation with it. All others are ``kept``. Null and blank keys count as
    none, a null rank as 0.
    """
    own = checkpointed(
        df.select(
            F.col(row).alias("row"), _keys(photos).alias("photos"), _keys(observations).alias("observations"),
            F.col(label).alias("label"), F.coalesce(F.col(rank), F.lit(0)).alias("rank"),
        )
    )
    bad = checkpointed(label_conflicts(own, "row", "photos", "observations", "label"))
    rest = checkpointed(own.join(bad, "row", "left_anti"))
    placed = checkpointed(rest.join(linked_rows(rest, "row", "photos"), "row"))
    best = placed.groupBy("component").agg(F.min(F.struct((-F.col("rank")).alias("r"), "row")).alias("best"))
    told = placed.join(best, "component").withColumn(
        "verdict", F.when(F.col("best.row") == F.col("row"), "kept").when(F.col("rank") < -F.col("best.r"), "looser_license").otherwise("duplicate_photo_id")
    )
    told = checkpointed(told.select("row", "photos", "observations", "verdict"))
    winners = told.where("verdict = 'kept'").select("row", (F.size("photos") > 0).alias("photo"), F.explode("observations").alias("key"))
    # a winner with a photo stays whatever came before, so what it bars is known at once
    barred = winners.where("photo").groupBy("key").agg(F.min("row").alias("first"))
    bare = winners.where("NOT photo").select("row", "key")
    lost = checkpointed(bare.join(barred, "key").where("first < row").select("row").distinct())
    holds = bare.join(lost, "row", "left_anti").select("row", F.col("row").alias("place"), "key")
    also = settled(holds, **({} if rounds is None else {"rounds": rounds})).where("NOT kept").select("row")
    again = lost.union(also).withColumn("again", F.lit(True))
    verdicts = told.join(again, "row", "left").select("row", F.when(F.col("again"), "duplicate_observation_id").otherwise(F.col("verdict")).alias("verdict"))
    out = own.select("row").join(bad, "row", "left").join(verdicts, "row", "left")
    return out.select(F.col("row").alias(row), F.coalesce("verdict", F.lit("class_conflict")).alias("verdict"), "labels")
