"""Exact, near and identity duplicates."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from .lookups import first_per
from .settling import settled

def keep_largest(df: DataFrame, keys: list[str], size: str, position: str) -> DataFrame:
    """Of each key the largest row, the first of equals; ``slot`` is where the key was first seen."""
    w = Window.partitionBy(*keys)
    return (
        df.withColumn("slot", F.min(position).over(w))
        .withColumn("_n", F.row_number().over(w.orderBy(F.desc(size), position)))
        .where("_n = 1")
        .drop("_n")
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_hashes(df: DataFrame, row: str, bucket: list[str], hash: str) -> DataFrame:
    """Pairs ``(a, b)``, a before b, of one bucket whose hashes differ in one or two bits; one row per bucket and hash is expected.

    Each hash stands in its own group and in those of its 64 neighbours at
    distance 1, so no group has more than 65 hashes and all that meet are near.
    """
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    own = df.select(F.struct(*[F.col(c) for c in bucket], F.lit(0)).alias("_b"), F.col(row).alias("_row"), F.explode(F.transform(flips, lambda x: F.col(hash).bitwiseXOR(x))).alias("_h"))
    left, right = own.withColumnRenamed("_row", "a"), own.withColumnRenamed("_row", "b")
    return left.join(right, ["_b", "_h"]).where("a < b").select("a", "b").distinct()


def near_classes(df: DataFrame, row: str, bucket: list[str], hash: str) -> DataFrame:
    """For each row: ``class``, the smallest row of its bucket with the same hash, and ``links``, how many other rows are within two bits.

    Rows of equal hash are one class, and classes are linked with each other
    once, so a hash that many rows share costs a row each and no pairs. A row
    without a hash is its own class with no links.
    """
    own = checkpointed(df.select(F.col(row).alias("row"), *bucket, F.col(hash).alias("hash")))
    known = own.where("hash IS NOT NULL")
    classes = checkpointed(known.groupBy(*bucket, "hash").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("n")))
    pairs = close_hashes(classes, "class", bucket, "hash")
    sizes = classes.select(F.col("class").alias("other"), F.col("n").alias("m"))
    both = pairs.union(pairs.select("b", "a")).toDF("class", "other")
    near = both.join(sizes, "other").groupBy("class").agg(F.sum("m").alias("near"))
    linked = classes.join(near, "class", "left").select(F.struct(*bucket, "hash").alias("_k"), "class", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    joined = own.select("row", F.struct(*bucket, "hash").alias("_k")).join(linked, "_k", "left")
    return joined.select("row", F.coalesce("class", "row").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def word_bits(df: DataFrame, row: str, text: Column, *others: str) -> DataFrame:
    """``row, hash`` and ``others``: a 60-bit simhash of a text's lower-cased words of letters and digits, each occurrence counted.

    A bit is set if it is set in the digests of more than half of the words; a
    text without words has none. Texts are hashed where they are read, in
    batches, and aren't shuffled; a word's digest is remembered by the task.
    """
    own = df.select(row, *others, F.lower(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    digest = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
    return own.mapInArrow(lambda batches: _hashed(batches, re.compile("[a-z0-9à-ž]+").findall, digest), f"{kinds}, hash long")


#: Words whose digests a task remembers at most.
MOST_KNOWN = 200_000


def _hashed(batches: Iterator[pa.RecordBatch], words_of: Callable[[str], list[str]], digest: Callable[[str], int]) -> Iterator[pa.RecordBatch]:
    """Batches with ``hash`` in place of ``text``: a bit is set if it is in the digests of most words, each occurrence counted.

    One text at a time is a Python string, so a task holds no more than a
    batch, a text's words and the digests of ``MOST_KNOWN`` words.
    """
    import numpy as np

    known: dict[str, int] = {}
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text in batch.column(at):
            words = Counter(words_of(text.as_py() or ""))
            if len(known) > MOST_KNOWN:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            h = np.fromiter(map(known.__getitem__, words), dtype="<u8", count=len(words))
            n = np.fromiter(words.values(), dtype=np.float64, count=len(words))
            ones = np.zeros(64)
            for i in range(0, len(h), 1024):  # bits of a long text's words in stretches; whole numbers add up exactly
                ones += n[i : i + 1024] @ np.unpackbits(h[i : i + 1024].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            out.append(int(np.packbits(2 * ones > n.sum(), bitorder="little").view("<i8")[0]) if words else None)
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.int64())], [*rest.schema.names, "hash"])


def greedy_drop(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Rows dropped because an earlier *kept* row is near: ``row`` and ``near``, the first such row.

    ``order(row, position)`` ranks all rows. A row near only to dropped rows is
    kept. In each round the rows without an earlier open neighbour are kept and
    their neighbours dropped, so there are as many rounds as the longest chain
    of such decisions; no cluster has to fit one task.
    """
    a, b = F.struct(F.col("pa").alias("p"), F.col("a").alias("row")), F.struct(F.col("pb").alias("p"), F.col("b").alias("row"))
    placed = (
        pairs.where("a <> b")
        .join(order.select(F.col("row").alias("a"), F.col("position").alias("pa")), "a")
        .join(order.select(F.col("row").alias("b"), F.col("position").alias("pb")), "b")
        .select(F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))
    )
    edges = checkpointed(placed.select(F.col("first.row").alias("first"), F.col("first.p").alias("p"), F.col("last.row").alias("last")).distinct())
    live, dropped = edges.select("first", "last"), None
    while live.limit(1).count():
        later = live.select(F.col("last").alias("first")).distinct()
        kept = live.select("first").distinct().join(later, "first", "left_anti")
        gone = checkpointed(live.join(kept, "first", "left_semi").select("last").distinct())
        as_first = gone.select(F.col("last").alias("first"))
        dropped = as_first if dropped is None else checkpointed(dropped.union(as_first))
        live = checkpointed(live.join(gone, "last", "left_anti").join(as_first, "first", "left_anti"))
    by_kept = edges if dropped is None else edges.join(dropped, "first", "left_anti")
    return by_kept.groupBy(F.col("last").alias("row")).agg(F.min(F.struct("p", "first"))["first"].alias("near"))


def greedy_drop_hashes(df: DataFrame, row: str, bucket: list[str], hash: str, position: str) -> DataFrame:
    """``greedy_drop`` of rows within two bits of one ``hash``.

    Rows of equal hash have the same neighbours, so only the first of them is
    compared; the others are dropped for it, or for the row it is dropped for.
    """
    rows = checkpointed(df.select(F.col(row).alias("row"), *bucket, F.col(hash).alias("hash"), F.col(position).alias("position")).where("hash IS NOT NULL"))
    first = F.min(F.struct("position", "row"))
    firsts = checkpointed(rows.groupBy(*bucket, "hash").agg(first.alias("_first")).select(*bucket, "hash", F.col("_first.row").alias("row"), F.col("_first.position").alias("position")))
    lost = checkpointed(greedy_drop(close_hashes(firsts, "row", bucket, "hash"), firsts.select("row", "position")))
    near = firsts.join(lost, "row", "left").select(F.struct(*bucket, "hash").alias("_k"), F.col("row").alias("_rep"), "near")
    copies = rows.select("row", F.struct(*bucket, "hash").alias("_k")).join(near, "_k")
    return copies.where((F.col("row") != F.col("_rep")) | F.col("near").isNotNull()).select("row", F.coalesce("near", "_rep").alias("near"))


def pooled_bucket(label: str, taxon: str, pooled: str) -> Column:
    """The bucket of near-duplicates: the label, but of the one ``pooled`` label each taxon that isn't blank by itself."""
    name = F.coalesce(F.col(taxon).cast("string"), F.lit(""))
    return F.when((F.col(label) == pooled) & (name != ""), F.concat(label, F.lit("\n"), name)).otherwise(F.col(label))


def greedy_drop_either(df: DataFrame, row: str, bucket: list[str], hashes: list[str], order: list[str], rounds: int | None = None) -> DataFrame:
    """``row, near``: rows dropped because an earlier *kept* row of the bucket is within two bits on any of ``hashes``, and the first such row.

    ``order`` ranks the rows, ties by ``row``. A null hash is compared with
    none; rows without any hash are kept and compared with nobody. Rows that
    agree in all hashes have the same neighbours, so the first stands for
    them. Rows meet on values: each hash value of a bucket is a key, near
    values are found once among the distinct ones, and a value that many rows
    share costs one row each, no pairs.
    """
    within = F.to_json(F.struct(*bucket)) if bucket else F.lit("")
    rows = df.select(F.col(row).alias("row"), F.struct(*order, row).alias("place"), within.alias("bucket"), *[F.col(h).cast("long").alias(f"h{i}") for i, h in enumerate(hashes)])
    own = [f"h{i}" for i in range(len(hashes))]
    rows = checkpointed(rows.where(F.coalesce(*own).isNotNull()))
    kinds = checkpointed(rows.groupBy("bucket", *own).agg(F.min_by("row", "place").alias("row"), F.min("place").alias("place")))
    name = lambda i: F.when(F.col(f"h{i}").isNotNull(), F.concat_ws(":", F.lit(i), f"h{i}", "bucket"))
    holds = checkpointed(kinds.select("row", "place", F.explode(F.array_compact(F.array(*[name(i) for i in range(len(hashes))]))).alias("key")))
    near = None
    for i in range(len(hashes)):
        values = kinds.where(f"h{i} IS NOT NULL").select(name(i).alias("key"), "bucket", f"h{i}").distinct()
        pairs = close_hashes(values, "key", ["bucket"], f"h{i}")
        pairs = pairs.union(pairs.select("b", "a")).toDF("key", "other")
        near = pairs if near is None else near.union(pairs)
    near = checkpointed(near)
    told = checkpointed(settled(holds, near, **({} if rounds is None else {"rounds": rounds})))
    kept = holds.join(told.where("kept"), "row", "left_semi").groupBy("key").agg(F.min("place").alias("first"))
    spread = kept.union(near.join(kept.withColumnRenamed("key", "other"), "other").select("key", "first"))
    reasons = holds.join(told.where("NOT kept"), "row", "left_semi").join(spread, "key").groupBy("row").agg(F.min("first")[row].alias("near"))
    same = [rows[c].eqNullSafe(kinds[c]) for c in ("bucket", *own)]
    copies = rows.join(kinds.withColumnRenamed("row", "rep").drop("place"), same).select(rows["row"], "rep")
    judged = copies.join(reasons.withColumnRenamed("row", "rep"), "rep", "left").where("row <> rep OR near IS NOT NULL")
    return judged.select("row", F.coalesce("near", "rep").alias("near"))


def text_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Simhashes of whole texts as 64-bit patterns: a bit is set if it is in the hashes of most words, each occurrence counted; null for a text without words."""
    word = re.compile(r"\w+")
    return _hashed(batches, lambda text: word.findall(text.lower()), lambda w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label, and the labels in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels")).where(F.size("labels") > 1)


def strictest(df: DataFrame, component: str, rank: str, position: str) -> DataFrame:
    """Every row with its verdict: ``kept``, ``looser_license`` or ``duplicate_photo_id``."""
    w = Window.partitionBy(component)
    top = F.max(rank).over(w)
    n = F.row_number().over(w.orderBy(F.desc(rank), position))
    return df.withColumn("verdict", F.when(n == 1, "kept").when(F.col(rank) < top, "looser_license").otherwise("duplicate_photo_id"))


def hash_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Average, difference and DCT hashes of 8x8, 8x9 and 32x32 grey images, as 64-bit patterns; a batch of images is one array."""
    import numpy as np

    n = np.arange(32)
    matrix = np.cos(np.pi / 32 * (n[None, :] + 0.5) * n[:8, None])
    edges = np.arange(10) * 32 // 9
    packed = lambda flags: np.packbits(flags.reshape(len(flags), 64), axis=1).view(">i8").ravel().astype(np.int64)

    for pdf in batches:
        image = np.array([np.asarray(g, dtype=float) for g in pdf["grey"]]).reshape(-1, 32, 32)
        small = image.reshape(-1, 8, 4, 8, 4).mean(axis=(2, 4))
        wide = np.stack([image[:, :, a:b].mean(axis=2) for a, b in zip(edges, edges[1:])], axis=2).reshape(-1, 8, 4, 9).mean(axis=2)
        low = (matrix @ image @ matrix.T).reshape(-1, 64)
        yield pd.DataFrame({
            "row": pdf["row"], "average": packed(small >= small.mean(axis=(1, 2), keepdims=True)),
            "difference": packed(wide[:, :, 1:] > wide[:, :, :-1]), "perceptual": packed(low > np.sort(low, axis=1)[:, 31:32]),
        })


def first_seen(df: DataFrame, key: str, *order) -> DataFrame:
    """One row per key, the first in ``order``."""
    return first_per(df, [key], *order)
