"""Connected components over shared keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready_checkpoints(spark: SparkSession) -> None:
    """Makes sure ``checkpoint()`` has a folder: the cluster's own setting, or a temporary one for a local master."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarryline-"))


def checkpointed(df: DataFrame) -> DataFrame:
    ready_checkpoints(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an edge list: ``node`` and ``label``, the smallest node it reaches.

    Each round takes the smallest label among a node's neighbours, then that
    label's own label, so the rounds follow the logarithm of the longest path.
    Every round is cut by a checkpoint.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        after = lower.join(own, lower["label"] == own["at"], "left")
        after = checkpointed(after.select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        moved = after.where("label <> old").limit(1).count()
        labels = after.drop("old")
        if not moved:
            return labels


def linked_rows(df: DataFrame, row: str, keys: str) -> DataFrame:
    """Component of every row by shared keys: ``row`` and ``component``, its smallest row.

    ``keys`` is an array column. Only rows of several keys link anything, so
    the components are sought among their keys; any row then has that of its
    least key. A key that many rows hold costs one row each. Rows without keys
    are alone.
    """
    held = df.select(F.col(row).alias("_row"), F.explode(keys).alias("_key")).where("_key IS NOT NULL")
    own = checkpointed(held.groupBy("_row").agg(F.collect_set("_key").alias("_keys")).withColumn("_first", F.array_min("_keys")))
    links = own.where("size(_keys) > 1").select("_first", F.explode("_keys").alias("_key")).distinct()
    named = components(links, "_first", "_key")
    parts = own.join(named, own["_first"] == named["node"], "left").select("_row", F.coalesce("label", "_first").alias("_part"))
    found = parts.join(parts.groupBy("_part").agg(F.min("_row").alias("_least")), "_part").select("_row", "_least")
    return df.select(row).join(found, df[row] == found["_row"], "left").select(row, F.coalesce("_least", row).alias("component"))


def hashed_name(parts, salt: str):
    """HMAC-SHA256 of a text column under ``salt``, from SHA-2 alone."""
    key = salt.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(parts, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)
