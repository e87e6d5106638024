"""Content-addressed store of token-id streams.

Ids of a document are cut into chunks where a rolling hash of the last ids
says so, so an edit moves few cuts. A chunk's address is the digest of its
bytes; each distinct chunk is stored once. A document is a recipe of
addresses, sealed by the root of a Merkle tree over them. The manifest has a
row per part of 65,536 documents: how many they are, their ids, the first
place of the part, and the root of a Merkle tree over its recipes, each leaf
made of a recipe's number, document, place, length and root. Reading verifies
all of it: a chunk by its address, a document by its root, and by the
manifest that no recipe is missing, altered or out of place.

Layout below the store's path::

    blocks/kind=chunk    address, ids (little-endian, 2 bytes each if the vocabulary's ids all fit, else 4), width, n
    blocks/kind=recipe   as written by the tasks, before numbering
    recipes              row, doc_id, start, n_tokens, addresses, root - in ascending doc_id order
    manifest             part, documents, tokens, start, root
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import running_start
from .minhash import grouped
from .tokens import encoder, id_width, vocabulary

#: Ids in the rolling hash; a cut falls after one in AVERAGE places between LEAST and MOST ids.
ROLL, AVERAGE, LEAST, MOST = 16, 512, 128, 4096
#: Documents of a part of the manifest.
PART = 1 << 16
#: Addresses that a task remembers having sent.
MOST_SENT = 200_000
DIGEST = 16

BLOCKS = "place binary, kind string, ids binary, width int, n long, doc_id long, addresses binary, root binary"


def rolling(ids: np.ndarray) -> np.ndarray:
    """For each place, a hash of the ROLL ids up to it (of fewer at the start)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    reach, factor = 1, 0xBF58476D1CE4E5B9
    while reach < ROLL:
        later = h.copy()
        later[reach:] += h[:-reach] * np.uint64(factor)
        h, reach, factor = later, 2 * reach, factor * factor % (1 << 64)
    return h


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash allows a cut. Several documents may be laid end to end: a chunk
    has LEAST ids or more, so no cut is decided by ids of the document before."""
    return np.flatnonzero((rolling(ids) >> np.uint64(40)) % np.uint64(AVERAGE) == 0) + 1


def cuts(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids; the last is ``n``. ``marks`` are in order."""
    ends, at = [], 0
    while n - at > LEAST:
        i = bisect_left(marks, at + LEAST)
        at = min(marks[i] if i < len(marks) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; leaves and inner nodes are told apart by a prefix, an odd node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves] or [hashlib.blake2b(b"\0", digest_size=DIGEST).digest()]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=DIGEST).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def _blocks(path: str, lower: bool, end_id: int):
    width = id_width(path)
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, lower, width).encode
        sent: OrderedDict[bytes, None] = OrderedDict()
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raws = [encode(text) + end for text in part.column(1).to_pylist()]
                sizes = [len(raw) // width for raw in raws]
                marks = marks_of(np.frombuffer(b"".join(raws), dtype=f"<u{width}")).tolist()
                out: list[tuple] = []
                low = base = 0
                for doc, raw, n in zip(part.column(0).to_pylist(), raws, sizes):
                    high = bisect_left(marks, base + n, low)
                    own = [m - base for m in marks[low:high]] if n > LEAST else []
                    low, base = high, base + n
                    at, addresses = 0, []
                    for stop in cuts(n, own):
                        ids = raw[width * at : width * stop]
                        addresses.append(key := address(ids))
                        if key not in sent:
                            sent[key] = None
                            if len(sent) > MOST_SENT:
                                sent.popitem(last=False)
                            out.append((key, "chunk", ids, width, stop - at, None, None, None))
                        at = stop
                    made += 1  # recipes are spread by document, not by content
                    out.append((struct.pack("<Q", made), "recipe", None, None, n, doc, b"".join(addresses), merkle_root(addresses)))
                yield _block_batch(out)

    return run


_TYPES = (pa.binary(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops chunks that repeat the address before them; rows come sorted by address within their kind."""
    last = None
    for batch in batches:
        keep = []
        for place, kind in zip(batch.column("place").to_pylist(), batch.column("kind").to_pylist()):
            keep.append(kind != "chunk" or place != last)
            last = place if kind == "chunk" else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, end_id: int = 2, vocabulary_path: str | None = None, lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises every document and writes the store below ``path``.

    A null or empty text is its end id alone; a very long one is many chunks.
    Repeated rows and ids, null ids too (they come first), are documents of
    their own; an empty table makes an empty store; other columns are
    ignored, whatever their names.

    Texts are tokenised once. A task sends each chunk once, chunks are dealt
    by address, and the writer keeps the first of each; so a chunk that a
    third of all documents share arrives once per task, not once per document.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = own.mapInArrow(_blocks(vocabulary_path or vocabulary("byte_bpe_50k.json"), lower, end_id), BLOCKS)
    dealt = blocks.repartition("place").sortWithinPartitions("kind", "place").mapInArrow(_once, BLOCKS)
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/blocks")
    raw = _read_blocks(spark, path, "recipe").select("doc_id", F.col("n").alias("n_tokens"), "addresses", "root")
    placed = running_start(raw, "n_tokens", F.col("doc_id").asc_nulls_first(), "root")
    placed.select("row", "doc_id", "start", "n_tokens", "addresses", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _sealed(spark.read.parquet(f"{path}/recipes")).drop("gapless").write.parquet(f"{path}/manifest")


MANIFEST = "part long, documents long, tokens long, start long, root binary, gapless boolean"


def _sealed(recipes: DataFrame) -> DataFrame:
    """The manifest's row of each part, made from its recipes, and whether they follow each other without a gap.

    A part is 65,536 documents by row number and less than 7 MB, so no task gathers more than that at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["part"]):
            row, start, n = (t.column(c).to_pylist() for c in ("row", "start", "n_tokens"))
            leaves = [
                struct.pack("<q?qqq", r, d is None, d or 0, s, k) + root
                for r, d, s, k, root in zip(row, t.column("doc_id").to_pylist(), start, n, t.column("root").to_pylist())
            ]
            part = row[0] // PART
            gapless = row == list(range(part * PART, part * PART + len(row))) and all(a + k == b for a, k, b in zip(start, n, start[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([len(row)]), pa.array([sum(n)]), pa.array([start[0]]), pa.array([merkle_root(leaves)], pa.binary()), pa.array([gapless])],
                [x.split()[0] for x in MANIFEST.split(", ")],
            )

    parts = recipes.select(F.expr(f"row div {PART}").alias("part"), "row", "doc_id", "start", "n_tokens", "root")
    return parts.repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, MANIFEST)


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose recipes aren't those that the manifest seals, as ``part, fault``: ``lost``, ``unknown`` or ``altered``.

    A part is ``altered`` too when a recipe of it is missing, or when it doesn't start where the part before it ends.
    """
    own = spark.read.schema(MANIFEST.removesuffix(", gapless boolean")).parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per 65,536 documents
    expected = own.select("part", F.struct("documents", "tokens", "start", "root").alias("sealed"), before.alias("before"))
    found = _sealed(spark.read.parquet(f"{path}/recipes")).select("part", F.struct("documents", "tokens", "start", "root").alias("read"), "gapless")
    same = F.col("gapless") & (F.col("sealed") == F.col("read")) & (F.col("sealed.start") == F.col("before"))
    fault = F.when(F.col("read").isNull(), "lost").when(F.col("sealed").isNull(), "unknown").when(~same, "altered")
    return expected.join(found, "part", "full").select("part", fault.alias("fault")).where("fault IS NOT NULL")


def _read_blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("kind") == kind)


def _split(recipes: DataFrame) -> DataFrame:
    """A row per chunk of a recipe, in order as ``i``."""
    n = F.expr(f"cast(octet_length(addresses) / {DIGEST} as int)")
    return recipes.select(
        "*", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("addresses", i * DIGEST + 1, F.lit(DIGEST))))
    ).withColumnsRenamed({"pos": "i", "col": "place"})


def _unpacked(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if width == 2 else ids


@functools.cache
def _combine_tables() -> np.ndarray:
    """For k = 0..39: tables that move a crc32 past 2**k zero bytes, a table for each of its four bytes."""
    def times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for bit in range(32):
            out ^= np.where((v >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
        return out

    one = np.array([0xEDB88320, *(1 << i for i in range(31))], dtype=np.uint32)  # past one zero bit
    matrix = one
    for _ in range(3):  # a byte
        matrix = times(matrix, matrix)
    out = np.empty((40, 4, 256), dtype=np.uint32)
    for k in range(40):
        for b in range(4):
            out[k, b] = times(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * b))
        matrix = times(matrix, matrix)
    return out


def crc_moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a piece with checksum ``crc`` and ``after`` bytes behind it adds (by xor) to the checksum of the whole."""
    tables, v = _combine_tables(), crc.astype(np.uint32)
    for k in range(40):
        on = (after >> k) & 1 == 1
        if on.any():
            t = tables[k]
            moved = t[0][v & 255] ^ t[1][(v >> np.uint32(8)) & 255] ^ t[2][(v >> np.uint32(16)) & 255] ^ t[3][v >> np.uint32(24)]
            v = np.where(on, moved, v)
    return v


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksum and length of each chunk as read, and whether its address is the digest of its ids."""
    for batch in batches:
        crc, n, good = [], [], []
        for place, ids, width in zip(batch.column("place").to_pylist(), batch.column("ids").to_pylist(), batch.column("width").to_pylist()):
            raw = _unpacked(ids, width)
            crc.append(zlib.crc32(raw))
            n.append(len(raw) // 4)
            good.append(address(ids) == place)
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(good, pa.bool_())], ["place", "crc", "n", "good"]
        )


class DamagedStore(ValueError):
    """A store whose recipes don't agree with its manifest."""


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Reads a store back and checks it: ``doc_id, start, n_tokens, ids_crc32, verified, row``.

    First the recipes are held against the manifest: a part that is lost,
    altered or out of place raises ``DamagedStore``, so ``start`` is what the
    manifest seals and no document is missing. Then every chunk file is read
    and every chunk's ids are hashed again. Checksums of whole documents come
    from those of their chunks as read, moved to their places, so no ids are
    shuffled. ``verified`` tells that all chunks are there and sound, that
    they add up to the recipe's length and that the recipe's root is that of
    its addresses. To rebuild the ids themselves, see ``read_documents``.

    An empty store gives no rows. Null and repeated ids are told apart by
    ``row``; documents of any length are read a chunk at a time.
    """
    if bad := damaged_parts(spark, path).limit(10).collect():
        raise DamagedStore(f"{path}: " + ", ".join(f"part {r.part} {r.fault}" for r in bad))
    chunks = _read_blocks(spark, path, "chunk").select("place", "ids", "width").mapInArrow(_checked, "place binary, crc long, n long, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                merkle_root([a[i : i + DIGEST] for i in range(0, len(a), DIGEST)]) == r
                for a, r in zip(batch.column("addresses").to_pylist(), batch.column("root").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("addresses"), pa.array(ok, pa.bool_())], ["row", "addresses", "sealed"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = crc_moved(batch.column("crc").to_numpy(zero_copy_only=False), 4 * batch.column("after").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(v.astype(np.int64)), batch.column("good")], ["row", "n", "part", "good"])

    parts = _split(recipes.select("row", "addresses", "root").mapInArrow(sound, "row long, addresses binary, sealed boolean")).drop("addresses")
    joined = parts.join(chunks, "place", "left").select("row", "i", "sealed", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(False)).alias("good"))
    behind = F.coalesce(F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = (
        joined.select("row", "crc", "n", (F.col("good") & F.col("sealed")).alias("good"), behind.alias("after"))
        .mapInArrow(moved, "row long, n long, part long, good boolean")
        .groupBy("row")
        .agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n").alias("read"), F.min("good").alias("good"))
    )
    return recipes.drop("addresses", "root").join(summed, "row").select(
        "doc_id", "start", F.col("read").alias("n_tokens"), "ids_crc32", (F.col("good") & (F.col("read") == F.col("n_tokens"))).alias("verified"), "row"
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The ids of every document, rebuilt from its chunks: ``row, doc_id, start, ids`` (little-endian, 4 bytes each).

    A document with a missing chunk fails the read. An empty store gives no
    rows; null and repeated ids are told apart by ``row``.
    """
    chunks = _read_blocks(spark, path, "chunk").select("place", "ids", "width")
    parts = _split(spark.read.parquet(f"{path}/recipes").select("row", "doc_id", "start", "addresses")).drop("addresses").join(chunks, "place", "left")
    lists = parts.groupBy("row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("i", "ids", "width"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(_unpacked(p["ids"], p["width"]) for p in ps) for ps in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.binary())], ["row", "doc_id", "start", "ids"])

    return lists.mapInArrow(run, "row long, doc_id long, start long, ids binary")
