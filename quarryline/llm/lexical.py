"""Ranked lexical search: the best documents for each item of a set of queries.

The texts are read once. What is kept of a document is its length and how
often it holds each query term: the postings, a small table. Sums over it give
the number of documents, their length and each term's documents. Then each
task goes through its postings in windows of document ids. In a window the
postings are turned round, term by term, and every query adds its terms' scores
into one array with a place for each document of the window; a bitset marks
the places that were touched, and only these are harvested into the query's
heap. The heaps of all tasks meet once, a few rows for each query.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import running_start, written

#: A-Z to lower case, other ASCII to a space but digits: terms are runs of letters, digits and characters beyond ASCII.
_TERMS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: Document ids of a window, and documents that its array has places for: 64 kB of scores.
WINDOW = 8192
#: Terms of all queries that are answered in one pass over the texts; more queries are dealt to several passes.
MOST_TERMS = 500_000
#: Fixed values of the contract: the parts of a score.
LENGTH_SHARE, LENGTH_FACTOR, WEIGHT_SCALE, TF_SCALE = 25, 12, 1000, 1_000_000_000
#: Ranks after every id.
_LAST = np.iinfo(np.int64).max


def terms_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TERMS).split() if raw else []


def query_terms(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, terms``: each item's distinct terms with their ``times``; rows that share an id are one item, those without one are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, t.decode(), n) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())) for t, n in Counter(terms_of(raw.as_py())).items()]
            item, term, times = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.string()), pa.array(times, pa.int64())], ["item", "term", "times"])

    own = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).dropna()
    each = own.mapInArrow(run, "item long, term string, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))
    return each.groupBy("item").agg(F.collect_list(F.struct("term", "times")).alias("terms"))


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs``: each document's length, the terms of the vocabulary that it holds (by place there) and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t.encode(): i for i, t in enumerate(vocabulary)}
        for batch in batches:
            n, terms, tfs = [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                words = terms_of(raw.as_py())
                n.append(len(words))
                held = Counter(words)
                known = held.keys() & place.keys()
                terms.append(np.fromiter((place[w] for w in known), np.int32, len(known)))
                tfs.append(np.fromiter((held[w] for w in known), np.int64, len(known)))
            ends = np.zeros(len(n) + 1, np.int32)
            np.cumsum([len(t) for t in terms], out=ends[1:])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.empty(0, kind)]).astype(kind))) for x, kind in ((terms, np.int32), (tfs, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Heaps:
    """The best documents of each query so far, as ``(score, -id)``."""

    def __init__(self, queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.queries, self.weights, self.n_docs, self.n_terms, self.top = queries, weights, n_docs, n_terms, top
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]
        self.scores, self.touched = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)

    def window(self, ids: np.ndarray, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Scores the documents of a window, at most WINDOW of them, in the order of their ids."""
        places = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        terms, places, tfs = terms[order], places[order], tfs[order]
        length = 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.n_docs // self.n_terms
        gain = self.weights[terms] * (TF_SCALE * tfs // (1000 * tfs + LENGTH_FACTOR * length[places]))
        for best, (_, own, times) in zip(self.best, self.queries):
            first, end = np.searchsorted(terms, own, "left"), np.searchsorted(terms, own, "right")
            for a, b, r in zip(first.tolist(), end.tolist(), times.tolist()):
                if a < b:
                    at = places[a:b]
                    self.scores[at] += r * gain[a:b]
                    self.touched[at] = True
            at = np.flatnonzero(self.touched)
            self.touched[at] = False
            found = self.scores[at]
            self.scores[at] = 0
            least = best[0][0] if len(best) == self.top else 1
            at, found = at[found >= least], found[found >= least]
            if len(at) > self.top:
                some = np.argsort(-found, kind="stable")[: self.top]
                at, found = at[some], found[some]
            for score, doc in zip(found.tolist(), ids[at].tolist()):
                (heapq.heappush if len(best) < self.top else heapq.heappushpop)(best, (score, -doc))


def scored(held: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``item_id, doc_id, score``: each task's best documents for each query ``(item, terms, times)``, from its postings in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, rest = Heaps(queries, weights, n_docs, n_terms, top), None
        for got in chain(batches, [None]):
            new = [] if got is None else [pa.Table.from_batches([got])]
            if not (tables := ([rest] if rest is not None else []) + new):
                continue
            table = pa.concat_tables(tables).combine_chunks()
            ids = table.column("doc_id").fill_null(_LAST).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids // WINDOW)) + 1).tolist(), len(ids)]
            cuts = sorted({*cuts, *(c for a, b in zip(cuts, cuts[1:]) for c in range(a, b, WINDOW))})  # rows may share an id
            if got is not None:
                rest = table.slice(cuts[-2]) if len(ids) else None  # the last window may go on
                cuts.pop()
            for a, b in zip(cuts, cuts[1:]):
                terms, tfs = (table.column(c).slice(a, b - a).combine_chunks() for c in ("terms", "tfs"))
                starts = terms.offsets.to_numpy()
                heaps.window(ids[a:b], table.column("n").to_numpy()[a:b], starts - starts[0], terms.flatten().to_numpy(), tfs.flatten().to_numpy())
        rows = [(item, None if doc == -_LAST else -doc, score) for best, (item, *_) in zip(heaps.best, queries) for score, doc in best]
        item, doc, score = zip(*rows) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return held.where("n > 0 AND size(terms) > 0").sortWithinPartitions(F.col("doc_id").asc_nulls_last()).mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 20, most_terms: int = MOST_TERMS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents with the highest scores for each item: ``item_id, rank, doc_id, score``.

    A score above 0 is needed; equal scores are ranked by id. Null, empty and
    wordless texts have no terms and are never found; texts of any length are
    searched whole. Rows that share an id are documents of their own and may
    take several ranks; rows without an id come after all others of their
    score. Rows of one item id are one item; items without id or terms find
    nothing. Empty tables give an empty result; other columns are ignored,
    whatever their names.

    The driver and the tasks hold the terms of at most ``most_terms`` queries'
    terms at a time, or of one longer item; for more, the texts are read once
    for each such block of items.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = written(query_terms(items, item_id, item_text), "query-terms")
    spark, out = docs.sparkSession, None
    for block in _blocks(asked, most_terms):
        vocabulary = sorted({t.term for row in block for t in row.terms})
        held = written(postings(own, vocabulary), "postings")
        n_docs, n_terms = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for term, count in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per query term
            df[term] = count
        weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        place = {t: i for i, t in enumerate(vocabulary)}
        queries = [(row.item, np.array([place[t.term] for t in row.terms], np.int32), np.array([t.times for t in row.terms], np.int64)) for row in block]
        best = scored(held, queries, weights, n_docs, max(1, n_terms), top)
        out = best if out is None else out.union(best)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _blocks(asked: DataFrame, most: int) -> Iterator[list]:
    """The items in blocks of at most ``most`` terms, or of one item; a block at a time is on the driver."""
    sized = running_start(asked.withColumn("size", F.size("terms").cast("long")), "size", "item")
    placed = written(sized.select("item", "terms", F.expr(f"start div {most}").alias("block")), "query-blocks")
    for r in placed.select("block").distinct().orderBy("block").collect():  # as many as there are blocks
        yield placed.where(F.col("block") == r.block).orderBy("item").collect()
