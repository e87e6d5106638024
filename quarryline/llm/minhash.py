"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Every document becomes its set of 5-word shingles, a key of that set, and a
   signature of min-hashes of which one byte each is kept. Documents with
   equal sets are one class from here on.
2. Bands of signature bytes are buckets. The class of the smallest id leads
   its bucket, and every other class is compared with its leaders: signatures
   in batches, and after each batch a pair is dropped when the posterior
   probability that its similarity reaches the threshold is below ``miss``.
   Survivors are verified on their full sets. A bucket of m classes costs
   m - 1 pairs so far, and most groups of copies are connected by them.
3. Where classes of one bucket are still in different components, their
   signatures are compared with each other, across components only and in a
   pair's first common band only. Survivors are joined into clusters, and the
   full sets of a cluster are verified block against block, again across
   components only; a block tells the links that connect it, never all pairs.
4. Verified links give the components.

Pairs with a leader are verified as stars: the sets of its partners are dealt
to blocks, and each block streams past the leader's own set.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._common import checkpointed, components, written
from .words import mixed, shingle_set

#: Bytes of a band.
ROWS = 6
#: Probability at most that a pair at the threshold shares no band; for 0.85 that takes 28 bands, since (1 - 0.85**6)**28 < 2e-6.
NO_BAND = 2e-6
#: Hashes compared between two looks at the posterior.
BATCH = 42
#: Probability at which a pair that reaches the threshold may be pruned.
MISS = 1e-6
#: Classes of a bucket compared by one task, classes and shingles of a cluster's block.
BLOCK_CLASSES, BLOCK_SETS, BLOCK_SHINGLES = 2048, 512, 1_000_000
#: Shared shingles that a block counts at once.
COUNTED = 8192
#: Rows of pairs that are broadcast to the texts at most (under 100 bytes each).
MOST_BROADCAST = 300_000


def bands_for(percent: int) -> int:
    """Bands that keep the chance of missing a pair at the threshold below NO_BAND."""
    if not 60 <= percent <= 100:
        raise ValueError("the threshold lies between 60 and 100 per cent")
    return max(1, math.ceil(math.log(NO_BAND) / math.log1p(-min((percent / 100) ** ROWS, 1 - 1e-9))))


@functools.cache
def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    a = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, hashes, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, hashes: int) -> bytes:
    """One byte of each of the min-hashes of a set."""
    a, b = _coefficients(hashes)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 2048):
        low = np.minimum(low, (h[i : i + 2048] * a + b).min(axis=1))
    low ^= low >> np.uint32(15)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


@functools.cache
def least_matches(threshold: float, miss: float, hashes: int) -> dict[int, int]:
    """For each count of compared hashes, the fewest matches at which a pair is kept.

    The prior of the similarity is uniform. Bytes of different min-hashes
    agree with probability 1/256, so a similarity s shows as s + (1 - s)/256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = {}
    for n in batch_ends(hashes):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() >= miss * w.sum():
                out[n] = m
                break
    return out


def batch_ends(hashes: int) -> list[int]:
    return [min(at + BATCH, hashes) for at in range(0, hashes, BATCH)]


def features(docs: DataFrame, id_col: str, text_col: str, hashes: int) -> DataFrame:
    """``doc_id, n_shingles, key_a, key_b, sig`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py())
                n.append(len(s))
                a.append(int(s.sum(dtype=np.uint64)) - (1 << 63))
                b.append(int(mixed(s + np.uint64(len(s))).sum(dtype=np.uint64)) - (1 << 63))
                sig.append(signature(s, hashes) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "key_a", "key_b", "sig"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, sig binary")


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint8).reshape(len(sigs), -1)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = (1 << (8 * np.arange(ROWS, dtype=np.int64)))[None, None, :]
    for batch in batches:
        n = batch.num_rows
        if n:
            sig = _matrix(batch.column(1)).reshape(n, -1, ROWS)
            bands = sig.shape[1]
            bucket = (sig.astype(np.int64) * weight).sum(axis=2) + (np.arange(bands, dtype=np.int64) << (8 * ROWS))
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(rep)], ["bucket", "rep"])


def _alike(threshold: float, miss: float):
    """Of pairs with both signatures those that pass all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))
            need = least_matches(threshold, miss, a.shape[1])
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            at = np.flatnonzero(np.minimum(n, m) >= np.floor(threshold * np.maximum(n, m) - 1e-9))
            seen, start = np.zeros(len(at), dtype=np.int64), 0
            for end in batch_ends(a.shape[1]):
                seen = seen + (a[at, start:end] == b[at, start:end]).sum(axis=1)
                keep = seen >= need[end]
                at, seen, start = at[keep], seen[keep], end
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([kept.column("centre"), kept.column("other"), kept.column("n_b")], ["centre", "other", "n"])

    return run


def survivors(band: int, size: np.ndarray, own: np.ndarray, label: np.ndarray, sig: np.ndarray, across: bool, threshold: float, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """For members sorted by set size: the later partners of each that pass all batches, the likeliest first.

    Members of one component aren't compared, and ``across`` compares members
    of different blocks only.
    """
    hashes = sig.shape[1]
    need = least_matches(threshold, miss, hashes)
    last = np.searchsorted(size, np.floor(size / threshold + 1e-9), side="right")
    for i in range(len(size) - 1):
        at = np.arange(i + 1, last[i])
        at = at[label[at] != label[i]]
        if across:
            at = at[own[at] != own[i]]
        if not len(at):
            continue
        alike = sig[at] == sig[i]
        if band:
            fresh = ~alike[:, : band * ROWS].reshape(len(at), band, ROWS).all(axis=2).any(axis=1)
            at, alike = at[fresh], alike[fresh]
        seen, start = np.zeros(len(at), dtype=np.int64), 0
        for end in batch_ends(hashes):
            seen = seen + alike[:, start:end].sum(axis=1)
            keep = seen >= need[end]
            at, alike, seen, start = at[keep], alike[keep], seen[keep], end
            if not len(at):
                break
        if len(at):
            yield i, at[np.argsort(-seen, kind="stable")]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal ``keys`` from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _is_across(t: pa.Table) -> bool:
    return t.column("side")[0].as_py() == 0 or t.column("lo")[0].as_py() != t.column("hi")[0].as_py()


def _compare(threshold: float, miss: float):
    """The survivors of a block as a forest: ``a`` and ``b``, a row for each class but one of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["bucket", "side", "lo", "hi"]):
            if t.num_rows < 2:
                continue
            rep, size, own, label = (t.column(c).to_numpy() for c in ("rep", "n_shingles", "own", "label"))
            sig = _matrix(t.column("sig").combine_chunks())
            order = np.lexsort((rep, size))
            rep, size, own, label, sig = rep[order], size[order], own[order], label[order], sig[order]
            band = int(t.column("bucket")[0].as_py() >> (8 * ROWS))
            forest, edges = Forest(len(rep)), []
            for i, at in survivors(band, size, own, label, sig, _is_across(t), threshold, miss):
                edges += [(i, j) for j in at.tolist() if forest.join(i, j)]
            if edges:
                i, j = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["a", "b"])

    return run


def _verify_blocks(percent: int):
    """Links across components between the sets of a block, as many as connect what reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["bucket", "side", "lo", "hi"]):
            n = t.num_rows
            if n < 2:
                continue
            rep, own, label = (t.column(c).to_numpy() for c in ("rep", "own", "label"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            size = np.array([len(x) for x in sets])
            _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row, shared = np.repeat(np.arange(n), size), count[place] > 1
            row, place = row[shared], (np.cumsum(count > 1) - 1)[place[shared]]
            order = np.argsort(place, kind="stable")
            row, place = row[order], place[order]
            both = np.zeros((n, n), np.float32)
            for start in range(0, int((count > 1).sum()), COUNTED):
                a, b = np.searchsorted(place, [start, start + COUNTED])
                part = np.zeros((n, COUNTED), np.float32)
                part[row[a:b], place[a:b] - start] = 1
                both += part @ part.T
            both = both.astype(np.int64)
            near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            near &= (label[:, None] != label[None, :]) & (rep[:, None] != rep[None, :]) & (size > 0)[:, None]
            if _is_across(t):
                near &= own[:, None] != own[None, :]
            forest = Forest(n)
            found = [(i, j) for i, j in zip(*np.nonzero(np.triu(near))) if forest.join(int(i), int(j))]
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["a", "b"])

    return run


def _shingle_rows(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                sets = [shingle_set(t.as_py()).tobytes() for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(sets, pa.binary())], [*keep, "shingles"])

    return run


def _verify(percent: int):
    """Links of centres with the partners that stream past them; the rows of a centre come first in each block."""

    def reaches(a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b):
            return False
        both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leads = None, []
        for batch in batches:
            links = []
            columns = [batch.column(c).to_pylist() for c in ("centre", "block", "lead", "node")]
            for centre, block, lead, node, raw in zip(*columns, batch.column("shingles").to_pylist()):
                own = np.frombuffer(raw, dtype=np.uint64)
                if (centre, block) != now:
                    now, leads = (centre, block), []
                if lead:
                    leads.append(own)
                elif any(reaches(x, own) for x in leads):
                    links.append((centre, node))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class _Search:
    """The steps of ``near_duplicates`` over one table of texts (``node, text``)."""

    def __init__(self, texts: DataFrame, classes: DataFrame, percent: int, miss: float, block_classes: int, block_sets: int, block_shingles: int):
        self.texts, self.classes = texts, classes
        self.percent, self.miss = percent, miss
        self.block_classes, self.block_sets, self.block_shingles = block_classes, block_sets, block_shingles
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        """Verifies ``pairs(centre, other, n)`` on full sets and joins what is linked."""
        blocks = F.ceil(F.sum("n") / F.lit(self.block_shingles)).cast("long").alias("blocks")
        blocks_of = pairs.groupBy("centre").agg(blocks)
        others = pairs.join(blocks_of, "centre").select(
            "centre", F.pmod(F.xxhash64("other"), F.col("blocks")).alias("block"), F.lit(False).alias("lead"), F.col("other").alias("node")
        )
        centres = blocks_of.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("lead"), F.col("centre").alias("node"))
        rows = checkpointed(others.union(centres))
        found = (
            self.with_sets(rows, ["centre", "block", "lead", "node"], "centre long, block long, lead boolean, node long")
            .repartition("centre", "block")
            .sortWithinPartitions("centre", "block", F.desc("lead"))
            .mapInArrow(_verify(self.percent), "a long, b long")
        )
        self.linked(found)

    def with_sets(self, rows: DataFrame, columns: list[str], schema: str) -> DataFrame:
        """``rows`` with the shingles of the text of each ``node``. Few rows go to the texts, more are joined."""
        few = rows.count() <= MOST_BROADCAST
        return self.texts.join(F.broadcast(rows) if few else rows, "node").mapInArrow(_shingle_rows(columns), f"{schema}, shingles binary")

    def linked(self, found: DataFrame) -> None:
        found = checkpointed(found.distinct())
        if found.limit(1).count():
            self.links = found if self.links is None else self.links.union(found)
            self.labels = components(self.links)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components by now."""
        if self.labels is None:
            return pairs
        a, b = self.labels.toDF("centre", "_a"), self.labels.toDF("other", "_b")
        both = pairs.join(a, "centre", "left").join(b, "other", "left")
        return both.where(F.coalesce("_a", "centre") != F.coalesce("_b", "other")).drop("_a", "_b")

    def leaders(self, shared: DataFrame) -> None:
        """Compares each class with the leaders of its buckets: first with the smallest, then with those of other components."""
        sig = self.classes.select("rep", "n_shingles", "sig")
        pairs = shared.where("rep <> leader").select(F.col("leader").alias("centre"), F.col("rep").alias("other")).distinct()
        both = pairs.join(sig.toDF("other", "n_b", "sig_b"), "other").join(sig.toDF("centre", "n_a", "sig_a"), "centre")
        found = written(both.mapInArrow(_alike(self.percent / 100, self.miss), "centre long, other long, n long"), "minhash-leaders")
        first = found.groupBy("other").agg(F.min_by(F.struct("centre", "n"), "centre").alias("s")).select("s.centre", "other", "s.n")
        self.verify(first)
        self.verify(self.apart(found))

    def tagged(self, members: DataFrame) -> DataFrame:
        """``members(.., rep)`` with ``label``, the component of each by now."""
        if self.labels is None:
            return members.withColumn("label", F.col("rep"))
        return members.join(self.labels.toDF("rep", "_l"), "rep", "left").withColumn("label", F.coalesce("_l", "rep")).drop("_l")

    def rest(self, shared: DataFrame) -> None:
        """Compares the other classes of each bucket across components, and verifies the clusters of survivors."""
        members = self.tagged(shared.where("rep <> leader").select("bucket", "rep"))
        sig = self.classes.select("rep", "n_shingles", "sig")
        compared = (
            _in_blocks(members, self.block_classes).join(sig, "rep")
            .repartition("bucket", "side", "lo", "hi")
            .sortWithinPartitions("bucket", "side", "lo", "hi")
            .mapInArrow(_compare(self.percent / 100, self.miss), "a long, b long")
        )
        edges = checkpointed(compared.distinct())
        if not edges.limit(1).count():
            return
        sizes = self.classes.groupBy("rep").agg(F.max("n_shingles").alias("n"))
        clusters = self.tagged(components(edges).toDF("rep", "bucket")).join(sizes, "rep")
        rows = checkpointed(_in_blocks(clusters, self.block_sets, self.block_shingles).withColumnRenamed("rep", "node"))
        columns = ["bucket", "side", "lo", "hi", "own", "node", "label"]
        sets = self.with_sets(rows, columns, "bucket long, side int, lo long, hi long, own long, node long, label long")
        at_place = sets.withColumnRenamed("node", "rep").repartition("bucket", "side", "lo", "hi").sortWithinPartitions("bucket", "side", "lo", "hi")
        self.linked(at_place.mapInArrow(_verify_blocks(self.percent), "a long, b long"))


def _in_blocks(members: DataFrame, most: int, most_shingles: int | None = None) -> DataFrame:
    """``bucket, side, lo, hi, own, rep, label``: a row for each task that a member of a bucket with several labels belongs to.

    A bucket of at most ``most`` members (and ``most_shingles`` in all, by
    their ``n``) is one task. In a larger one the members of its largest
    component (side 0, blocks ``lo``) meet the blocks ``hi`` of all others, and
    the blocks of the others meet each other (side 1); the largest component
    isn't compared with itself.
    """
    weight = F.sum("n" if most_shingles else F.lit(0)).alias("w")
    counts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"), weight)
    top = F.max(F.struct("k", "label", "w")).alias("top")
    sums = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("k").alias("k"), F.sum("w").alias("w"), top).where("labels > 1")
    blocks = lambda k, w: F.greatest(F.lit(1), F.ceil(k / F.lit(most)), F.ceil(w / F.lit(most_shingles or 1))).cast("long")
    cut = sums.select(
        "bucket", F.col("top.label").alias("top"), (blocks(F.col("k"), F.col("w")) > 1).alias("large"),
        blocks(F.col("top.k"), F.col("top.w")).alias("tops"), blocks(F.col("k") - F.col("top.k"), F.col("w") - F.col("top.w")).alias("others"),
    )
    zero = F.lit(0).cast("long")
    upto = lambda n: F.sequence(zero, n - 1)
    task = lambda side, lo, hi, own: F.struct(F.lit(side).alias("side"), lo.alias("lo"), hi.alias("hi"), own.alias("own"))
    in_top, at = F.pmod(F.xxhash64("rep"), "tops"), F.pmod(F.xxhash64("rep"), "others")
    tasks = (
        F.when(~F.col("large"), F.array(task(1, zero, zero, zero)))
        .when(F.col("label") == F.col("top"), F.transform(upto(F.col("others")), lambda j: task(0, in_top, j, zero)))
        .otherwise(
            F.concat(
                F.transform(upto(F.col("tops")), lambda i: task(0, i, at, F.lit(1).cast("long"))),
                F.transform(upto(F.col("others")), lambda j: task(1, F.least(at, j), F.greatest(at, j), at)),
            )
        )
    )
    placed = members.select("bucket", "rep", "label").join(cut, "bucket")
    return placed.select("bucket", "rep", "label", F.explode(tasks).alias("t")).select("bucket", "t.*", "rep", "label")


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Components of documents linked by shingle-set similarity of ``percent`` or more.

    Returns one row per document: ``doc_id, n_shingles, component_id`` (the
    smallest id it reaches) and ``kept`` (it is that id). A link needs
    100 * intersection >= percent * union, on the full sets.

    Null, empty and blank texts have no shingles and are linked with nothing;
    texts of any length enter whole. Rows that share an id are one document
    with all their sets. A null id is linked with nothing: its component is
    null and it is kept. An empty table gives an empty one. Other columns are
    ignored, whatever their names.

    A pair of different sets that reaches the threshold is missed only if it
    shares no band (NO_BAND) or is pruned (``miss`` at each look), and then its
    documents may still be connected by others.
    """
    hashes = ROWS * bands_for(percent)
    feat = written(features(docs, id_col, text_col, hashes), "minhash-features")
    usable = feat.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        usable.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")),
        "minhash-classes",
    )
    bands = classes.select("rep", "sig").mapInArrow(_band_rows, "bucket long, rep long")
    heads = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where("n > 1")
    shared = written(bands.join(heads.drop("n"), "bucket"), "minhash-bands")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    search = _Search(texts, classes, percent, miss, block_classes, block_sets, block_shingles)
    search.leaders(shared)
    search.rest(shared)
    same_id = usable.join(classes, ["key_a", "key_b", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = checkpointed(same_id.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b <> c").select("b", "c").toDF("a", "b"))
    named = search.labels
    if several.limit(1).count():
        named = components(several if search.links is None else search.links.union(several))
    component = F.col("rep")
    if named is not None:
        classes, component = classes.join(named, classes["rep"] == named["node"], "left"), F.coalesce("label", "rep")
    of_class = classes.select("key_a", "key_b", "n_shingles", component.alias("component"))
    return (
        feat.drop("sig")
        .join(of_class, ["key_a", "key_b", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, one row per id, and those without an id.

    Null, empty and blank texts are linked with nothing and stay. Of rows that
    share a kept id one stays. An empty table gives an empty one. All columns
    are kept, whatever their names.
    """
    name = "kept_id"
    while name in docs.columns:
        name += "_"
    kept = near_duplicates(docs, id_col=id_col, **how).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col).cast("long") == F.col(name), "left_semi")
    return named.dropDuplicates([id_col]).union(docs.where(F.col(id_col).isNull()))
