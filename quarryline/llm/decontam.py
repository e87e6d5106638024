"""Benchmark passages in documents by Aho-Corasick automata.

Questions and answers are normalised to lower-case words with single spaces;
every run of 10 words of an item is a pattern (an item of fewer words is one
pattern). Each document is normalised the same way and scanned once; matches
are mapped back to words and to characters of the original text.

One automaton holds all patterns as long as the items' texts fit in its
memory. A larger benchmark is cut into shards of that size, each with an
automaton of its own, and the texts are scanned by one after the other.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import running_start, whole_row, written

#: Bytes of item texts that one automaton takes. It was measured at 330 to 420 bytes of memory for each, so 160 MB at most.
MOST_ITEM_BYTES = 400_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to lower case, other ASCII that isn't part of a word to a space.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_NORMAL).split() if raw else []


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """The distinct patterns of an item, with a space on either side of each word."""
    runs = [words] if 0 < len(words) < size else [words[i : i + size] for i in range(len(words) - size + 1)]
    return list(dict.fromkeys(b" " + b" ".join(r) + b" " for r in runs))


Items = tuple[tuple[int, str], ...]


@functools.lru_cache(maxsize=1)
def automaton(items: Items, size: int) -> tuple:
    """The automaton of a worker process, with the words and the items of each pattern; a match gives the pattern's number."""
    import ahocorasick

    owners: dict[bytes, set[int]] = {}
    for item, text in items:
        for p in windows_of(words_of(text.encode()), size):
            owners.setdefault(p, set()).add(item)
    if not owners:
        return None, [], []
    found = ahocorasick.Automaton()
    for i, p in enumerate(owners):
        found.add_word(p.decode("latin-1"), i)
    found.make_automaton()
    return found, [p.count(b" ") - 1 for p in owners], [tuple(sorted(x)) for x in owners.values()]


def merged(runs) -> list[tuple[int, int]]:
    """Runs (first, end) joined where they meet."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def scan(raw: bytes | None, machine, lengths: list[int]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Count of words, hit runs of words as (first, end), and the patterns that occur."""
    words = words_of(raw)
    if not words or machine is None:
        return len(words), [], set()
    joined = b" " + b" ".join(words) + b" "
    matches = list(machine.iter(joined.decode("latin-1")))
    if not matches:
        return len(words), [], set()
    spaces, at = [], -1
    for w in words:  # the space before each word
        at += 1
        spaces.append(at)
        at += len(w)
    ends = [(bisect_left(spaces, e), p) for e, p in matches]
    return len(words), merged((end - lengths[p], end) for end, p in ends), {p for _, p in matches}


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<struct<start:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_item_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    Returns one row per document: ``doc_id, n_words, n_hit, n_items`` (items
    with occurring windows), ``items_sha256, contaminated``, the ``items``
    themselves and ``spans`` of hit runs in code points of the original text.
    Null, empty and wordless texts have no words and no hits; texts of any
    length are scanned whole. Items without words, or with a null id, have no
    windows; rows of one item id are one item. Rows may repeat. Without items
    nothing is contaminated. An empty table gives an empty one. Other columns
    are ignored, whatever their names.

    Texts are scanned where they are read, and with a benchmark of at most
    ``most_item_bytes`` nothing is shuffled. A larger one is scanned shard by
    shard (see ``_hits``), and the hits of the shards are joined to the texts.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = list(_shards(_items(benchmark, item_id, item_text), size, most_item_bytes))
    if len(shards) > 1:
        return _combined(own, shards, size)
    items = _collected(shards[0]) if shards else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, lengths, of = automaton(items, size)
        for batch in batches:
            rows = []
            for raw in batch.column(1).cast(pa.binary()):
                raw = raw.as_py()
                n, hit, found = scan(raw, machine, lengths)
                rows.append(_row(raw, n, hit, {i for p in found for i in of[p]}))
            yield _batch(batch.column(0), rows)

    return own.mapInArrow(run, SCHEMA)


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).dropna()


def _shards(items: DataFrame, size: int, most: int) -> Iterator[DataFrame]:
    """The items in shards of about ``most`` bytes; of a longer item, pieces that hold all its windows."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= most:
        if total:
            yield items
        return

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text.encode())
                step = max(1, most // 16)
                for i in range(0, max(1, len(words) - size + 1), step):
                    out.append((item, b" ".join(words[i : i + step + size - 1]).decode()))
            item, text = zip(*out) if out else ((),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(text, pa.string())], ["item", "text"])

    cut = items.mapInArrow(pieces, "item long, text string").withColumn("bytes", F.octet_length("text").cast("long"))
    placed = written(running_start(cut, "bytes", "item", "text").select("item", "text", F.expr(f"start div {most}").alias("shard")), "benchmark")
    for r in placed.select("shard").distinct().orderBy("shard").collect():  # as many as the benchmark has shards
        yield placed.where(F.col("shard") == r.shard).select("item", "text")


def _collected(shard: DataFrame) -> Items:
    return tuple(sorted(map(tuple, shard.collect())))


def _key(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _hits(texts: DataFrame, shards: list[DataFrame], size: int) -> DataFrame:
    """``key, runs, items`` of each of ``texts(key, text)`` with a hit, a row for each shard that hits it.

    The driver and the tasks hold the items of one shard at a time: its hits
    are written before the next shard is taken up.
    """
    out = None
    for shard in shards:
        items = _collected(shard)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            machine, lengths, of = automaton(items, size)
            for batch in batches:
                rows = []
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                    _, hit, found = scan(raw.as_py(), machine, lengths)
                    if hit:
                        rows.append((key, [{"first": a, "end": b} for a, b in hit], sorted({i for p in found for i in of[p]})))
                key, runs, own = zip(*rows) if rows else ((),) * 3
                run_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(runs, run_type), pa.array(own, pa.list_(pa.int64()))], ["key", "runs", "items"])

        hits = written(texts.mapInArrow(run, "key string, runs array<struct<first:long,end:long>>, items array<long>"), "contamination")
        out = hits if out is None else out.union(hits)
    return out


def _combined(own: DataFrame, shards: list[DataFrame], size: int) -> DataFrame:
    """The rows of ``contamination`` from the hits of several shards; equal texts are scanned once."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, runs, items in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = raw.as_py()
                rows.append(_row(raw, len(words_of(raw)), merged((r["first"], r["end"]) for r in runs or ()), set(items or ())))
            yield _batch(batch.column(0), rows)

    keyed = own.withColumn("key", _key("text"))
    hits = _hits(keyed.select("key", "text").dropDuplicates(["key"]), shards, size)
    found = hits.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return keyed.join(found, "key", "left").select("doc_id", "text", "runs", "items").mapInArrow(finish, SCHEMA)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_item_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs.

    Null, empty and wordless texts stay; repeated rows share their fate; an
    empty table gives an empty one, and without items all rows stay. All
    columns are kept, whatever their names, since a row travels as one value.
    """
    shards = list(_shards(_items(benchmark, item_id, item_text), size, most_item_bytes))
    frame = docs.select(whole_row(docs).alias("row"), F.col(text_col).cast("string").alias("text"))
    if len(shards) > 1:
        keyed = frame.withColumn("key", _key("text"))
        bad = _hits(keyed.select("key", "text").dropDuplicates(["key"]), shards, size).select("key").distinct()
        return keyed.join(bad, "key", "left_anti").select("row.*")
    items = _collected(shards[0]) if shards else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, lengths, _ = automaton(items, size)
        for batch in batches:
            good = [not scan(raw.as_py(), machine, lengths)[1] for raw in batch.column("text").cast(pa.binary())]
            rows = batch.column("row").filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(rows.flatten(), [f.name for f in rows.type])

    return frame.mapInArrow(run, docs.schema)


def _row(raw: bytes | None, n: int, hit: list[tuple[int, int]], items: set[int]) -> tuple:
    spans = []
    if hit:
        at = [m.span() for m in WORD.finditer(raw.lower().decode())]  # bytes.lower changes A-Z only
        spans = [{"start": at[first][0], "end": at[end - 1][1]} for first, end in hit]
    return n, sum(end - first for first, end in hit), len(items), digest(items), bool(hit), sorted(items), spans


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, hit, count, sha, bad, items, spans = zip(*rows) if rows else ((),) * 7
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [
        ids, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()),
        pa.array(bad, pa.bool_()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, span),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])
