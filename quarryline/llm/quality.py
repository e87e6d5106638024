"""Quality rules and cross-document line frequency.

Lines are normalised (lower case, single spaces) and hashed. For each host the
distinct documents that hold a line are counted; lines above the host's limit
are boilerplate and are removed, and a document that loses too much of itself
is rejected.

Documents are distinct by their text: copies of one text count once. Counted
one by one, a group of copies would turn each of its own lines into
boilerplate, and the last copy would be rejected together with the others;
copies are the business of the near-duplicate stage, which keeps one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._common import checkpointed, few_rows, whole_row, with_texts, written
from .words import windows, word_hashes

_WHITE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"

#: Rows of line counts that are broadcast at most (24 bytes each); more are joined by key.
MOST_BROADCAST = 1_000_000

SCHEMA = (
    "row long, doc_id long, source string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, lines array<long>, line_words array<int>"
)


def repeated_words(hashes: np.ndarray, size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included."""
    if len(hashes) < size + 1:
        return 0
    _, inverse, counts = np.unique(windows(hashes, size), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    hit = np.zeros(len(hashes), dtype=bool)
    for i in range(size):
        hit[starts + i] = True
    return int(hit.sum())


def line_hashes(text: str | None, host: str | None) -> list[int]:
    """Hashes of host and normalised line, of each line of a text in order; None for a blank line."""
    lead = b"" if host is None else host.encode() + b"\n"
    return [xxhash.xxh3_64_intdigest(lead + b" ".join(own)) - (1 << 63) if (own := line.lower().split()) else None for line in (text or "").encode().split(b"\n")]


def measure(text: str | None, host: bytes) -> tuple:
    """The base figures of a text, the hashes of its distinct normalised lines and the words of each."""
    raw = (text or "").encode()
    words = raw.split()
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        own = line.lower().split()
        if own:
            dup += line in seen
            seen.add(line)
            h = xxhash.xxh3_64_intdigest(host + b" ".join(own)) - (1 << 63)
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _WHITE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(words), chars, symbols, dup, repeated_words(word_hashes(words)), list(lines), list(lines.values())


def features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            hosts, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = [measure(t, b"" if h is None else h.encode() + b"\n") for h, t in zip(hosts, texts)]
            n, chars, symbols, dup, repeat, lines, counts = zip(*rows) if rows else ((),) * 7
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [long(range(at, at + len(texts))), batch.column(0), batch.column(1), batch.column(3), long(n), long(chars), long(symbols), long(dup), long(repeat),
                 pa.array(lines, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                ["row", "doc_id", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )
            at += len(texts)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, SCHEMA)


def _bounded(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``df``, materialised, and broadcast if its count of rows allows; and whether it does."""
    kept = checkpointed(df)
    few = kept.count() <= most
    return F.broadcast(kept) if few else kept, few


def frequent_lines(feat: DataFrame, least_docs: int, host_percent: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``line, n``: line hashes (of host and line) that more distinct texts of their host hold than the limit allows.

    ``feat`` has ``source, text_hash, lines``. Rows are counted first, on the
    map side; only lines that reach the limit so are counted by text.
    """
    lines = feat.select("source", "text_hash", F.explode("lines").alias("line"))
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")).where(F.col("n") > least_docs)
    hosts = feat.select("source", "text_hash").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    over = lambda df: df.join(hosts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host"))).where(
        (F.col("n") > least_docs) & (100 * F.col("n") > host_percent * F.col("docs"))
    )
    suspects = _bounded(over(often).select("line"), most_broadcast)[0]
    distinct = lines.join(suspects, "line").groupBy("line", "text_hash").agg(F.first("source").alias("source"))
    return over(distinct.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"))).select("line", "n")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def judge(
    docs: DataFrame, least_docs: int = 20, host_percent: int = 10, depleted_percent: int = 50,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Base figures and verdict of every document.

    Returns ``doc_id, source, text_hash, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, removed_words`` and
    ``removed_lines`` (hashes of the lines above the limit). A line is above
    the limit of its host when more than ``least_docs`` documents and more
    than ``host_percent`` per cent of the host's documents with different
    texts hold it. A document is rejected when the base rules fail or when
    such lines hold ``depleted_percent`` per cent of its words or more.

    Null, empty and blank texts have no words, fail the base rules and have no
    lines. Texts of any length are measured whole. A null source is a host of
    its own. Repeated rows and ids are rows of their own. An empty table gives
    an empty one. Other columns are ignored, whatever their names.

    Texts aren't shuffled: the tasks send line hashes, summed on the map side,
    and the frequent lines come back to the figures of the documents.
    """
    feat = written(features(docs, id_col, text_col, host_col), "quality-features")
    frequent = _bounded(frequent_lines(feat, least_docs, host_percent, most_broadcast), most_broadcast)[0]
    lost = (
        feat.select("row", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
        .select("row", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
        .join(frequent, "line")
        .groupBy("row")
        .agg(F.sum("words").alias("removed_words"), F.array_sort(F.collect_list("line")).alias("removed_lines"))
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    lost_words = F.coalesce("removed_words", F.lit(0))
    return (
        feat.drop("lines", "line_words")
        .join(lost, "row", "left")
        .select(
            "doc_id", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & (100 * lost_words < depleted_percent * F.col("n_words"))).alias("kept"),
            lost_words.alias("removed_words"),
            F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        )
    )


def _line_features(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """``source, text_hash, lines`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in few_rows(batches):
            lines = [list({h for h in line_hashes(t, s) if h is not None}) for s, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.int64()))], ["source", "text_hash", "lines"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(host_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "source string, text_hash long, lines array<long>")


def _verdict(text: str | None, host: str | None, frequent, depleted_percent: int) -> tuple[bool, str | None]:
    """Whether a document is kept, and its text without the frequent lines."""
    raw = (text or "").encode()
    words = raw.split()
    if len(words) < 50 or 100 * repeated_words(word_hashes(words)) > 50 * len(words):
        return False, text
    lines = text.split("\n")
    gone = [h is not None and h in frequent for h in line_hashes(text, host)]
    if not any(gone):
        return True, text
    lost = sum(len(line.encode().split()) for line, g in zip(lines, gone) if g)
    return 100 * lost < depleted_percent * len(words), "\n".join([line for line, g in zip(lines, gone) if not g])


def cleaned(
    docs: DataFrame, least_docs: int = 20, host_percent: int = 10, depleted_percent: int = 50,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """The documents that ``judge`` keeps, without the lines above their host's limit.

    Has the columns of ``docs``; a length in ``n_chars`` follows a text that
    loses lines. Null, empty and blank texts are rejected, as in ``judge``, and
    texts of any length are taken whole. Repeated rows are judged alike and
    each kept; an empty table gives an empty one; columns may have any names,
    since a row travels as one value.

    Each text is judged where it is read, against the frequent lines as a
    broadcast of a checked size; beyond it the frequent lines of each text are
    joined to it by its hash and host.
    """
    text, host = F.col(text_col).cast("string"), F.col(host_col).cast("string")
    feat = written(_line_features(docs, text_col, host_col), "quality-lines")
    lines, few = _bounded(frequent_lines(feat, least_docs, host_percent, most_broadcast), most_broadcast)
    frame = docs.select(whole_row(docs).alias("row"), text.alias("text"), host.alias("host"), F.xxhash64(text).alias("hash"))
    known: frozenset = frozenset()
    if few:
        known = frozenset(r[0] for r in lines.select("line").collect())
    else:
        held = feat.select("source", "text_hash", F.explode("lines").alias("line")).distinct().join(lines, "line")
        own = held.groupBy("source", F.col("text_hash").alias("own_hash")).agg(F.collect_list("line").alias("lines"))
        frame = frame.join(own, (frame["hash"] == own["own_hash"]) & frame["host"].eqNullSafe(own["source"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in few_rows(batches):
            texts, hosts = batch.column("text").to_pylist(), batch.column("host").to_pylist()
            frequent = [known] * len(texts) if few else [frozenset(x or ()) for x in batch.column("lines").to_pylist()]
            out = [_verdict(t, h, f, depleted_percent) for t, h, f in zip(texts, hosts, frequent)]
            kept = pa.array([k for k, _ in out], pa.bool_())
            yield with_texts(batch.column("row"), [c for _, c in out], [t != c for t, (_, c) in zip(texts, out)], text_col).filter(kept)

    return frame.mapInArrow(run, docs.schema)
