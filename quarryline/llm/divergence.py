"""How far the sources of a language differ in their terms.

Counts of terms are taken once, per language, source and term. A term that a
source lacks has the source's baseline share, so two sources differ by the
same amount at all terms that both lack. A pair is therefore summed from its
sparse parts: the baseline at every term, a correction for each term of one
source, and one for each term of both. Only the last looks at terms source by
source, and it is summed inside tasks.

The strongest terms of a source are ranked by radix selection: histograms over
the bits of the value find each group's k-th value, ties there are cut by
histograms over UTF-8 bytes, and no group is ever sorted whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import numbered, written

#: A-Z to lower case, other ASCII to a space: terms are runs of letters and of characters beyond ASCII.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Fixed values of the contract: what is added to each count, and the scale of shares.
ADDED, SCALE = 2, 1_000_000_000
#: Bits of a value: at most SCALE.
VALUE_BITS, DIGIT_BITS = 30, 10
#: Terms that a task holds before it sends their counts on.
MOST_HELD = 300_000
#: Pairs of sources that a task looks at in one step.
MOST_AT_ONCE = 1_000_000


def term_counts(docs: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """``lang, source, term, count, docs``: of each task, one row or more for each term of a group."""

    def rows(counts: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms, of = list(own), held[lang, source]
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                        pa.array([own[t] for t in some], pa.int64()), pa.array([of[t] for t in some], pa.int64()),
                    ],
                    ["lang", "source", "term", "count", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, seen = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = raw.as_py().translate(_TERMS).split()
                own = counts[lang, source]
                before = len(own)
                own.update(words)
                held[lang, source].update(set(words))
                seen += len(own) - before
                if seen > most_held:
                    yield from rows(counts, held)
                    counts, held, seen = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(counts, held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: str, n: str, v: str) -> Column:
    """The share of a term with ``count`` occurrences among ``n`` of ``v`` terms, in parts of SCALE; exact for any long."""
    return F.expr(f"1 + (CAST({count} + {ADDED} AS DECIMAL(20,0)) * {SCALE}BD) div (CAST({n} AS DECIMAL(20,0)) + {ADDED} * CAST({v} AS DECIMAL(19,0)))")


def apart(p: str, q: str) -> str:
    """SQL of the divergence of two shares."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _cut(hist: DataFrame, by: list[str], bucket: str, descending: bool) -> DataFrame:
    """From counts ``n`` by group and bucket, with ``need`` of the group: the bucket that holds the ``need``-th row and what is needed of it."""
    order = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*by).orderBy(order)
    run = hist.withColumn("upto", F.sum("n").over(before)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return run.select(*by, F.col(bucket).alias("cut"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("n").alias("there"))


def radix_top(rows: DataFrame, by: list[str], value: str, item: str, k: int, few: int = 64, bits: int = VALUE_BITS, digit: int = DIGIT_BITS) -> DataFrame:
    """The ``k`` rows of each group with the largest ``value`` (0 to 2**bits - 1), ties by ``item`` in UTF-8 order, and their ``rank`` from 1.

    Histograms over ``digit`` bits of the value, from the highest, narrow each
    group down to its k-th value; a group has at most 2**digit buckets a
    round. Where more than ``few`` rows tie there, histograms over two bytes
    of the item narrow the ties. What is left is at most ``k + few`` rows of a
    group. ``rows`` is read once a round and should be a written table; null
    groups are groups, items of a group must differ.
    """
    same = lambda a, b: [a[c].eqNullSafe(b[f"_{c}"]) for c in by]
    held = lambda df, *more: df.select(*[F.col(c).alias(f"_{c}") for c in by], *more)
    state, shift = None, bits
    while shift > 0:
        wide, shift = min(digit, shift), max(0, shift - digit)
        left = rows.select(*by, F.shiftright(F.col(value), shift).alias("bucket"))
        if state is None:
            left = left.withColumn("need", F.lit(k).cast("long"))
        else:
            reached = held(state, "cut", "need")
            left = left.join(reached, [*same(left, reached), F.shiftright(left["bucket"], wide) == F.col("cut")]).select(*by, "bucket", "need")
        state = written(_cut(left.groupBy(*by, "bucket", "need").agg(F.count(F.lit(1)).alias("n")), by, "bucket", True), "radix")
    all_of = held(state, F.col("cut").alias("at"), F.col("need").alias("want"), "there")
    joined = rows.join(all_of, same(rows, all_of), "left").select(*[rows[c] for c in rows.columns], "at", "want", "there")
    sure = joined.where(F.col("at").isNull() | (F.col(value) > F.col("at")) | (F.col(value) == F.col("at")) & (F.col("there") <= F.greatest("want", F.lit(few)))).select(*rows.columns)
    crowded = joined.where((F.col(value) == F.col("at")) & (F.col("there") > F.greatest("want", F.lit(few))))
    out = [sure]
    if not state.where(F.col("there") > F.greatest("need", F.lit(few))).isEmpty():
        ties = written(crowded.select(*rows.columns, F.col("want").alias("need")), "ties")
        place = 0
        while not ties.isEmpty():
            piece = F.substring(F.encode(F.col(item), "UTF-8"), 2 * place + 1, 2)
            left = ties.withColumn("piece", piece)
            cut = _cut(left.groupBy(*by, "piece", "need").agg(F.count(F.lit(1)).alias("n")), by, "piece", False)
            cut = held(cut, "cut", F.col("need").alias("want"), "there")
            told = left.join(cut, same(left, cut)).select(*[left[c] for c in rows.columns], "piece", "cut", "want", "there")
            told = written(told.where("piece <= cut"), "ties")
            done = F.col("there") <= F.greatest("want", F.lit(few))
            out.append(told.where((F.col("piece") < F.col("cut")) | done).select(*rows.columns))
            ties = told.where((F.col("piece") == F.col("cut")) & ~done).select(*rows.columns, F.col("want").alias("need"))
            place += 1
    near = out[0]
    for more in out[1:]:
        near = near.union(more)
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(item).asc())
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shared_terms(rows: DataFrame, most: int = MOST_AT_ONCE) -> DataFrame:
    """For pairs ``g < h`` of groups, the sum over their common terms of what these differ from the two one-sided corrections.

    ``rows(lang, term, g, p, p0)`` come with all rows of a term in one
    partition, in order. A task adds up the pairs of its terms in blocks of
    about ``most`` and sends one row for a pair, more only if it meets
    millions of pairs.
    """

    def blocks(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i before j, of rows of one term; ``stop[i]`` is the end of the term of row i."""
        first = 0
        reach = np.cumsum(stop - start - 1)
        while first < len(start):
            end = max(first + 1, int(np.searchsorted(reach, (reach[first - 1] if first else 0) + most, side="right")))
            i = start[first:end]
            n = stop[first:end] - i - 1
            for at in range(0, int(n.max(initial=0)), most):  # a row with more partners than a block holds is cut too
                m = np.clip(n - at, 0, most)
                left = np.repeat(i, m)
                yield left, left + 1 + at + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            first = end

    def sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, inverse, np.concatenate([s for _, s in parts]))
        return code, total

    def batch(code: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(total)], ["g", "h", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rest = [], None
        for got in chain(batches, [None]):
            last = got is None
            table = rest if last else pa.Table.from_batches([got]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([got])])
            if table is None or not len(table):
                continue
            lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
            new = np.ones(len(table), bool)
            new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            begins = np.append(np.flatnonzero(new), len(table))
            whole = len(table) if last else int(begins[-2])  # the last term may go on
            rest = None if last else table.slice(whole)
            start = np.arange(whole)
            stop = begins[np.searchsorted(begins, start, side="right")] if whole else start
            g, p, p0 = (table.column(c).to_numpy()[:whole] for c in ("g", "p", "p0"))
            for i, j in blocks(start, stop):
                value = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
                parts.append(sums([(np.minimum(g[i], g[j]) << 32 | np.maximum(g[i], g[j]), value)]))
                if sum(len(c) for c, _ in parts) > 2 * most:
                    parts = [sums(parts)]
                    if len(parts[0][0]) > most:
                        yield batch(*parts.pop())
        if parts:
            yield batch(*sums(parts))

    return rows.select("lang", "term", "g", "p", "p0").mapInArrow(run, "g long, h long, part long")


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", few: int = 64) -> DataFrame:
    """Divergence of the sources of each language, and the terms that set each source apart.

    Returns ``lang, source, part, item, value, rank``. Part ``pair``: for each
    other source of the language, the divergence summed over all kept terms.
    Part ``term``: the ``top`` terms that are more frequent in the source than
    in its language. Terms are kept if they stand in ``least_docs`` documents
    of the language.

    Null texts, languages and sources are empty ones; empty texts and texts
    without letters count as documents of their group, which is listed; a text
    of any length is counted whole; repeated rows count each; equal values are
    ranked by the item's UTF-8 bytes; an empty table gives no rows; other
    columns are ignored, whatever their names. A language of one source has no
    pairs. Numbers of groups are held in 32 bits.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    one = Window.partitionBy("lang", "term")
    # dealt by language and term at once, so that sums by source and over sources need no other exchange
    summed = term_counts(own).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    kept = summed.withColumn("held", F.sum("docs").over(one)).withColumn("total", F.sum("count").over(one))
    kept = kept.withColumn("first", (F.row_number().over(one.orderBy("source")) == 1).cast("long")).where(F.col("held") >= least_docs)
    kept = written(kept.select("lang", "term", "source", "count", "total", "first"), "terms")
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("count").alias("all_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = own.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0)
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v")).otherwise(F.lit(1)).cast("long"))
    groups = written(numbered(groups, "lang", "source", name="g")[0], "groups")

    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share("count", "n", "v").cast("long"))
    own_terms = rows.withColumn("q", share("total", "all_n", "v").cast("long")).where("p > q")
    own_terms = written(own_terms.select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value")), "own-terms")
    terms = radix_top(own_terms, ["lang", "source"], "value", "item", top, few=few)

    a, b = groups.select("lang", "g", "v", F.col("p0").alias("a0")), groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("b0"))
    both = a.join(b, "lang")
    base = both.where("g < h").select("g", "h", F.expr(f"v * {apart('a0', 'b0')}").alias("part"))
    levels = rows.groupBy("g", "p").agg(F.count(F.lit(1)).alias("times"))  # many terms share a count
    sided = both.where("g <> h").join(levels, "g").select(
        F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), F.expr(f"times * ({apart('p', 'b0')} - {apart('a0', 'b0')})").alias("part")
    )
    shared = shared_terms(rows.select("lang", "term", "g", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term"))
    parts = base.union(sided).union(shared).groupBy("g", "h").agg(F.sum("part").alias("value"))
    ways = parts.select(F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("way"), "value")
    named = ways.select("way.g", "way.h", "value").join(groups.select("g", "lang", "source"), "g").join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = named.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shape(pairs, "pair").union(shape(terms, "term"))
