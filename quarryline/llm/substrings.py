"""Removal of byte strings that repeat across documents, by suffix order.

Every string of ``length`` bytes holds an anchor: the place of its least
k-gram hash. Equal strings have equal anchors, so

1. tasks exchange packed lists of anchor hashes, which tells the anchors that
   occur in two documents or more;
2. around those, and only there, segments of text are cut that hold all
   strings with that anchor, and are dealt to shards by anchor hash; an anchor
   of very many documents is split further: each of its strings is a segment
   of its own, dealt by its hash, so the strings that cross the edges of a
   common passage spread over all shards;
3. each shard sorts the suffixes of its segments by external induced sorting
   (``induced``); runs of suffixes that share ``length`` bytes are equal
   strings, and all but those of the smallest document go;
4. the removed ranges come back to the documents.

A hash or segment that many documents of one task hold is settled there and
sent once, so what meets in one place grows with the number of tasks, not
with the number of documents that share a passage; what differs around a
passage is bounded by the split of heavy anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .induced import Store, suffix_runs
from .minhash import grouped
from .words import mixed

#: Bytes of a k-gram for strings of 50 bytes.
GRAM = 20
#: Anchors, and bytes of segments, that a task gathers before it sends them.
MOST_ANCHORS, MOST_SEGMENTS = 1_000_000, 8_000_000
#: Different texts from which an anchor is heavy and its strings are dealt one by one; of more heavy anchors than MOST_HEAVY
#: (8 bytes each in every task) only the heaviest are split. Both decide where strings meet, not which ones go.
HEAVY, MOST_HEAVY = 10_000, 1_000_000
#: Bytes of text for each bucket of anchors and each shard of segments.
BYTES_PER_BUCKET, BYTES_PER_SHARD = 16_000_000, 8_000_000

#: Bytes of segments that a shard sorts in memory; a larger one is sorted with queues, text and order on disk.
MOST_SORTED = 64_000_000

ROWS = "place int, payload binary, doc_id long, text_hash long, found binary"


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes."""
    power = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out, reach, width, rest = None, 0, 1, size
    while rest:
        if rest & 1:
            if out is None:
                out, reach = power, width
            else:
                n = len(raw) - reach - width + 1
                out = out[:n] * np.uint64(0x94D049BB133111EB) + power[reach : reach + n]
                reach += width
        rest >>= 1
        if rest:
            power = power[:-width] * np.uint64(0xBF58476D1CE4E5B9 * (2 * width + 1) % (1 << 64) | 1) + power[width:]
            width *= 2
    return mixed(out)


def anchors(raw: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last start of each run of ``length``-byte strings with one anchor."""
    least = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    window = length - gram + 1
    hashes, at, reach = least, np.arange(len(least), dtype=np.int32), 1
    while reach < window:
        step = min(reach, window - reach)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        reach += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    # least hashes crowd near 0; mixed again they are spread evenly over the buckets
    return mixed(hashes[at[first]] + np.uint64(1)), first, last


def _pack(*columns: np.ndarray) -> bytes:
    raw = b"".join(len(c).to_bytes(4, "little") + c.dtype.str[1:].encode().ljust(2) + c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(payload: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "little"), np.dtype(raw[at + 4 : at + 6].decode().strip())
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at + 6).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.empty(0, kind))
        at += 6 + size
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["place", "payload", "doc_id", "text_hash", "found"])


def _per_document(doc: np.ndarray, text_hash: np.ndarray, value: np.ndarray, places: int) -> list[tuple]:
    """A row for each document with its values, spread over the places."""
    order = np.lexsort((text_hash, doc))
    doc, text_hash, value = doc[order], text_hash[order], value[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]))) if len(doc) else []
    ends = [*new[1:], len(doc)]
    return [(int(text_hash[a] % places), None, int(doc[a]), int(text_hash[a]), value[a:b].tobytes()) for a, b in zip(new, ends)]


def _by_home(doc: np.ndarray, text_hash: np.ndarray, value: np.ndarray, homes: int) -> list[tuple]:
    """A packed row for each home place of documents, with their values."""
    home = text_hash % homes
    order = np.lexsort((value, text_hash, doc, home))
    home, doc, text_hash, value = home[order], doc[order], text_hash[order], value[order]
    used, cut = np.unique(home, return_index=True)
    rows = []
    for at, a, b in zip(used.tolist(), cut.tolist(), [*cut.tolist()[1:], len(home)]):
        d, t = doc[a:b], text_hash[a:b]
        new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
        rows.append((at, None, None, None, _pack(d[new], t[new], np.diff(np.append(new, b - a)).astype(np.int32), value[a:b])))
    return rows


def _sent_anchors(length: int, bits: int, buckets: int):
    shift = np.uint64(64 - bits)

    def settle(hashes: list, docs: list, names: list) -> list[tuple]:
        h, d = np.concatenate(hashes), np.concatenate(docs)
        doc = np.array([n[0] for n in names], np.int64)
        text = np.array([n[1] for n in names], np.int64)
        order = np.lexsort((doc[d], h))
        h, d = h[order], d[order]
        keep = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[keep], d[keep]
        first = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(h)) - 1
        several = doc[d[starts]] != doc[d[ends]]
        held = (ends - starts + 1).astype(np.uint32)
        # two texts of one document: both must be told, so they count as settled only if other documents agree
        own = several[group]
        rows = _by_home(doc[d[own]], text[d[own]], h[own], buckets)
        alone = ~own
        extra = alone & ~first
        h1, d1 = h[starts], d[starts]
        cut = np.searchsorted(h1, (np.arange(buckets + 1, dtype=object) * (1 << bits) // buckets).astype(np.uint64) if bits < 64 else np.array([min(i * (1 << 64) // buckets, (1 << 64) - 1) for i in range(buckets + 1)], np.uint64))
        cut[-1] = len(h1)
        for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            if cut[b] < cut[b + 1]:
                part = slice(cut[b], cut[b + 1])
                used, index = np.unique(d1[part], return_inverse=True)
                rows.append((b, _pack(np.diff(h1[part], prepend=np.uint64(0)), index.astype(np.uint32 if len(used) >> 16 else np.uint16), several[part].astype(np.uint8), doc[used], text[used], held[part]), None, None, None))
        for i in np.flatnonzero(extra):  # further texts of one document, rare
            b = int(np.searchsorted(cut, np.searchsorted(h1, h[i]), side="right") - 1)
            rows.append((b, _pack(h[i : i + 1], np.zeros(1, np.uint16), np.zeros(1, np.uint8), doc[d[i : i + 1]], text[d[i : i + 1]], np.zeros(1, np.uint32)), None, None, None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, names, held = [], [], [], 0
        for batch in batches:
            for doc, text_hash, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                found = np.unique(anchors(raw.as_py(), length)[0] >> shift)
                hashes.append(found)
                docs.append(np.full(len(found), len(names), np.int32))
                names.append((doc, text_hash))
                held += len(found)
                if held > MOST_ANCHORS:
                    yield _rows(settle(hashes, docs, names))
                    hashes, docs, names, held = [], [], [], 0
        if names:
            yield _rows(settle(hashes, docs, names))

    return run


def _shared_anchors(homes: int, heavy: int):
    """Anchor hashes of each document that occur in another one too; what tasks settled passes through.

    A row without ``found`` names a heavy anchor in ``doc_id`` and the number of its documents in ``text_hash``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["place"]):
            at = t.column("place")[0].as_py()
            told = [(at, None, None, None, f) for f in t.column("found").to_pylist() if f is not None]
            lists = [_unpack(p) for p in t.column("payload").to_pylist() if p is not None]
            if lists:
                h = np.concatenate([np.cumsum(x[0]) for x in lists])
                settled = np.concatenate([x[2] for x in lists]) > 0
                doc = np.concatenate([x[3][x[1]] for x in lists])
                text = np.concatenate([x[4][x[1]] for x in lists])
                order = np.lexsort((doc, h))
                held = np.concatenate([x[5] for x in lists])[order]
                h, settled, doc, text = h[order], settled[order], doc[order], text[order]
                starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                in_all = np.add.reduceat(held, starts, dtype=np.int64)
                most = np.flatnonzero(in_all >= heavy)
                told += [(at, None, a, n, None) for a, n in zip(h[starts[most]].view(np.int64).tolist(), in_all[most].tolist())]
                ends = np.append(starts[1:], len(h))
                shared = (doc[starts] != doc[ends - 1]) | np.logical_or.reduceat(settled, starts)
                on = np.repeat(shared, ends - starts) & ~settled
                told += _by_home(doc[on], text[on], h[on], homes)
            yield _rows(told)

    return run


def _collected(width: int):
    """A row for each document of a home place, with its values, the low ``width`` bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["place"]):
            lists = [_unpack(f) for f in t.column("found").to_pylist()]
            doc, text = (np.concatenate([np.repeat(x[i], x[2]) for x in lists]) for i in (0, 1))
            short = np.concatenate([x[3] for x in lists]).view(np.uint8).reshape(-1, 8)[:, :width]
            yield _rows(_per_document(doc, text, short, 1))

    return run


def _sent_segments(length: int, bits: int, shards: int, heavy: np.ndarray):
    shift, width = np.uint64(64 - bits), (bits + 7) // 8

    def send(known: dict) -> list[tuple]:
        by_shard: dict[int, list] = {}
        for (content, _), (doc, text_hash, first, h) in known.items():
            by_shard.setdefault(h % shards, []).append((h // shards & 0xFFFFFFFF, content, doc, text_hash, first))
        rows = []
        for shard, parts in by_shard.items():
            parts.sort()  # like contents side by side
            mark, content, doc, text, first = zip(*parts)
            rows.append((shard, _pack(np.diff(np.array(mark, np.uint32), prepend=np.uint32(0)), np.array([len(c) for c in content], np.uint32), np.array(doc, np.int64), np.array(text, np.int64), np.array(first, np.int64), np.frombuffer(b"".join(content), np.uint8)), None, None, None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        held = 0
        gone: list[tuple] = []

        def meet(content: bytes, doc: int, text_hash: int, a: int, b: int, h: int) -> int:
            """Takes up a segment, or settles it with an equal one; returns the bytes that are held for it."""
            other = known.get((content, None))
            if other is None:
                known[content, None] = (doc, text_hash, a, h)
                return len(content)
            if other[0] < doc:
                last = gone[-1] if gone else None
                if last and last[0] == doc and last[1] == text_hash and last[2] <= a <= last[3]:
                    gone[-1] = (doc, text_hash, last[2], max(b, last[3]))
                else:
                    gone.append((doc, text_hash, a, b))
                return 0
            if other[0] > doc:
                gone.append((other[0], other[1], other[2], other[2] + b - a))
                known[content, None] = (doc, text_hash, a, h)
                return 0
            known[content, (doc, text_hash, a)] = (doc, text_hash, a, h)  # again in the same document
            return len(content)

        for batch in batches:
            for doc, text_hash, raw, found in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("found").to_pylist()):
                if doc is None:  # its key is that of document 0
                    continue
                raw = raw.as_py()
                short = np.frombuffer(found, np.uint8).reshape(-1, width)
                told = np.unique(np.pad(short, ((0, 0), (0, 8 - width))).view(np.uint64).ravel())
                hashes, first, last = anchors(raw, length)
                hashes = hashes >> shift
                on = told[np.minimum(np.searchsorted(told, hashes), len(told) - 1)] == hashes
                own = hashes[on]
                split = heavy[np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)] == own if len(heavy) else np.zeros(len(own), bool)
                for h, a, z, each in zip(own.tolist(), first[on].tolist(), last[on].tolist(), split.tolist()):
                    if each:
                        for i in range(a, z + 1):
                            content = raw[i : i + length]
                            held += meet(content, doc, text_hash, i, i + length, xxhash.xxh3_64_intdigest(content))
                    else:
                        held += meet(raw[a : z + length], doc, text_hash, a, z + length, h)
                if held > MOST_SEGMENTS or len(gone) > 200_000:
                    yield _rows(send(known) + _ranges(*np.array(gone, np.int64).reshape(-1, 4).T, shards))
                    known.clear()
                    gone.clear()
                    held = 0
        yield _rows(send(known) + _ranges(*np.array(gone, np.int64).reshape(-1, 4).T, shards))

    return run


def _ranges(doc: np.ndarray, text_hash: np.ndarray, first: np.ndarray, end: np.ndarray, homes: int) -> list[tuple]:
    """Packed rows of byte ranges, each as its first byte and its length in one number."""
    return _by_home(doc, text_hash, first.astype(np.uint64) << np.uint64(32) | (end - first).astype(np.uint64), homes)


def repeated_ranges(lengths: np.ndarray, doc: np.ndarray, content: np.ndarray, length: int, limit: int = MOST_SORTED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments laid end to end: (segment, first, end) of the ranges whose strings start in a smaller document.

    Beyond ``limit`` bytes of text, all that is as long as the text lies on disk, and the order is taken up run by run.
    """
    store = Store(limit)
    n, size = len(lengths), int(lengths.sum()) + len(lengths) + 1
    text, segment = store.array(size, np.uint8), store.array(size - 1, np.int32)
    ends = np.cumsum(lengths + 1)
    start = ends - lengths - 1
    for i, j in store.stretches(size - 1):  # bytes of UTF-8 are below 0xF5: 1 ends a segment, 0 the text
        at = np.arange(i, j)
        s = np.searchsorted(ends, at, side="right")
        segment[i:j] = s
        off = at - start[s]
        inside = off < lengths[s]
        text[i:j] = np.where(inside, content[np.minimum(at - s, len(content) - 1)] + np.uint8(2), np.uint8(1))
    text[size - 1] = 0
    gone = store.array(size - 1, bool)
    gone[:] = False
    # equal strings are neighbours in the order, so a group is what lies between two short shared prefixes
    held: list[np.ndarray] = []

    def settle(group_starts: np.ndarray, order: np.ndarray) -> None:
        owner = doc[segment[order]]
        smallest = np.repeat(np.minimum.reduceat(owner, group_starts), np.diff(np.append(group_starts, len(order))))
        gone[order[smallest < owner]] = True

    for order, shared in suffix_runs(text, length, store):
        if order[0] == size - 1:  # the end mark
            order, shared = order[1:], shared[1:]
        if not len(order):
            continue
        cuts = np.flatnonzero(shared < length)
        if not len(cuts):
            held.append(order)
            continue
        joined = np.concatenate([*held, order])
        cuts = cuts + (len(joined) - len(order))
        starts = cuts if len(cuts) and cuts[0] == 0 else np.append(0, cuts)
        settle(starts[:-1], joined[: starts[-1]]) if len(starts) > 1 else None
        held = [joined[starts[-1] :]]
    if held:
        settle(np.zeros(1, np.int64), np.concatenate(held))
    room = start + lengths - length  # the last start of a whole string in each segment
    found = []
    for i, j in store.stretches(size - 1):
        at = np.flatnonzero(gone[i:j]) + i
        found.append(at[at <= room[segment[at]]])
    at = np.concatenate(found)
    store.close()
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    new = np.append(True, np.diff(at) > 1)
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    s = np.searchsorted(ends, first, side="right")
    return s, first - start[s], last - start[s] + length


def distinct_ranges(mark: np.ndarray, lengths: np.ndarray, doc: np.ndarray, content: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``repeated_ranges`` of segments that may be equal: each distinct content is sorted once, for its smallest document.

    A larger document loses the whole segment. ``mark`` tells anchors apart;
    strings of different anchors differ, so an anchor with one content only
    has nothing to be compared with.
    """
    ends = np.cumsum(lengths)
    raw, known = content.tobytes(), {}
    number = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip((ends - lengths).tolist(), ends.tolist())), np.int64, len(lengths))
    low = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(low, number, doc)
    copy = doc > low[number]
    own = np.flatnonzero(~copy)
    own = own[np.argsort(number[own], kind="stable")]
    lead = own[np.append(True, np.diff(number[own]) > 0)]  # by number
    _, anchor, contents = np.unique(mark[lead], return_inverse=True, return_counts=True)
    several = np.flatnonzero(contents[anchor] > 1)
    s = a = b = np.empty(0, np.int64)
    if len(several):
        texts = list(known)
        s, a, b = repeated_ranges(lengths[lead[several]], low[several], np.frombuffer(b"".join([texts[i] for i in several.tolist()]), np.uint8), length)
        s = several[s]
    start = np.searchsorted(number[own], s)
    each = np.searchsorted(number[own], s, side="right") - start  # places of a content in its smallest document
    place = np.repeat(start - np.cumsum(each) + each, each) + np.arange(each.sum())
    whole = np.flatnonzero(copy)
    return np.append(whole, own[place]), np.append(np.zeros(len(whole), np.int64), np.repeat(a, each)), np.append(lengths[whole], np.repeat(b, each))


def _sorted_shards(length: int, homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["place"]):
            at = t.column("place")[0].as_py()
            told = [(at, None, None, None, f) for f in t.column("found").to_pylist() if f is not None]
            lists = [_unpack(p) for p in t.column("payload").to_pylist() if p is not None]
            if lists:
                mark = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in lists])
                sizes, doc, text, first, content = (np.concatenate(c) for c in zip(*(x[1:] for x in lists)))
                row, a, b = distinct_ranges(mark, sizes.astype(np.int64), doc, content, length)
                told += _ranges(doc[row], text[row], first[row] + a, first[row] + b, homes)
            yield _rows(told)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist()):
            raw = raw or b""
            ranges = np.unique(np.frombuffer(found or b"", np.uint64))
            first = ranges >> np.uint64(32)
            spans: list[list[int]] = []
            for a, b in zip(first.tolist(), (first + (ranges & np.uint64(0xFFFFFFFF))).tolist()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            left = b"".join(kept) + raw[at:]
            out.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        n, removed, count, sha, left = zip(*out) if out else ((),) * 5
        long = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), long(n), long(removed), long(count), pa.array(sha, pa.string()), pa.array(left, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every document without the strings that start in a document with a smaller id.

    Returns ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs),
    ``kept_sha256`` and ``kept`` (the bytes left). A byte goes when a string of
    ``length`` bytes that covers it also starts in a document with a smaller
    id; strings are judged on the input. ``length`` must exceed the k-gram.

    Null and empty texts have no bytes, shorter ones no strings. Rows with one
    id don't count as smaller than each other. A null id compares with
    nothing: it loses nothing and takes nothing from others. An empty table
    gives an empty one; other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # half of the hash tells rows of one id apart;
    # both joins with the texts use columns without nulls, so that one exchange of the texts serves both
    keyed = own.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1)).alias("text_hash"), "text")
    usable = keyed.drop("key").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # with 12 bits more than there are bytes, a chance agreement of anchors is one in tens of thousands
    bits = min(64, max(32, int(size).bit_length() + 12))
    buckets, shards = 1 + size // BYTES_PER_BUCKET, 1 + size // BYTES_PER_SHARD
    at_place = lambda df: df.repartition("place").sortWithinPartitions("place")
    told = written(at_place(usable.mapInArrow(_sent_anchors(length, bits, buckets), ROWS)).mapInArrow(_shared_anchors(buckets, HEAVY), ROWS), "substring-anchors")
    heaviest = told.where("found IS NULL").orderBy(F.desc("text_hash"), "doc_id").limit(MOST_HEAVY).select("doc_id")
    heavy = np.unique(np.array([r[0] for r in heaviest.collect()], np.int64).view(np.uint64))
    lists = at_place(told.where("found IS NOT NULL")).mapInArrow(_collected((bits + 7) // 8), ROWS)
    cut = keyed.join(lists.select(F.col("doc_id").alias("key"), "text_hash", "found"), ["key", "text_hash"]).drop("key").mapInArrow(_sent_segments(length, bits, shards, heavy), ROWS)
    gone = at_place(cut).mapInArrow(_sorted_shards(length, shards), ROWS)
    ranges = at_place(gone).mapInArrow(_collected(8), ROWS).select(F.col("doc_id").alias("key"), "text_hash", "found")
    joined = keyed.join(ranges, ["key", "text_hash"], "left")
    return joined.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("found")).alias("found")).mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
