from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import registry, substrings
from quarryline.llm.induced import RunQueue, Store, suffix_order, suffix_runs

from .test_contracts import SCHEMA, SF, odd_rows


def brute(rows, length=50):
    first: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        if d is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                first[s] = min(first.get(s, d), d)
    out = Counter()
    for d, raw in raws:
        hit = bytearray(len(raw))
        if d is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < d:
                    hit[i : i + length] = b"\1" * length
        left = bytes(b for b, h in zip(raw, hit) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out[d, len(raw), sum(hit), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


def got(frame):
    return Counter(tuple(r)[:5] for r in substrings.remove_repeats(frame).collect())


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(rows)
    assert sum(k[2] > 0 for k in expected) > 10
    assert Counter(tuple(r) for r in registry.op6_suffix_dedup(spark, SF).collect()) == expected


def test_odd_rows(spark):
    rows = [(d, t[:3000] if t else t, *rest) for d, t, *rest in odd_rows()]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute([r[:2] for r in rows])
    assert got(spark.createDataFrame([], SCHEMA)) == Counter()


@pytest.mark.parametrize("seed", range(3))
def test_pasted_passages_in_many_small_batches(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abéc "), rng.integers(1, 9)))
    shared = [" ".join(word() for _ in range(rng.integers(8, 40))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.integers(1, 30)))]
        for _ in range(rng.integers(0, 4)):
            p = shared[rng.integers(len(shared))]
            a = int(rng.integers(0, max(1, len(p) - 30)))
            parts += [p[a : a + int(rng.integers(20, 120))] * int(rng.integers(1, 3)), word()]
        rows.append((int(rng.integers(0, 60)), "".join(parts) if i % 9 else "aaaa" * int(rng.integers(10, 40))))
    monkeypatch.setattr(substrings, "BYTES_PER_BUCKET", 1500)
    monkeypatch.setattr(substrings, "BYTES_PER_SHARD", 1500)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(frame) == brute(rows)


def test_suffix_order_with_spilled_queues():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, depth = int(rng.integers(1, 300)), int(rng.integers(3, 50))
        text = np.append(rng.integers(1, 1 + rng.integers(1, 5), n), 0).astype(np.uint8)
        order, shared = suffix_order(text, depth, int(rng.choice([40, 1000, 100_000])))
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(n + 1))
        for i in range(1, n + 1):
            a, b = raw[order[i - 1] :][:depth], raw[order[i] :][:depth]
            k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert a <= b and min(int(shared[i]), depth) == k


def test_long_text_is_sorted_outside_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(3000)]
    raw = b" ".join(words[i] for i in np.minimum(rng.zipf(1.2, 400_000) - 1, 2999)) + b"\0"
    limit = 500_000
    store = Store(limit)
    text = store.array(len(raw), np.uint8)
    text[:] = np.frombuffer(raw, np.uint8)
    tracemalloc.start()
    seen = np.zeros(len(raw), bool)
    before, n = b"", 0
    for at, shared in suffix_runs(text, 50, store):
        seen[at] = True
        for i in range(0, len(at), 997):  # neighbours, here and there
            a, b = before if i == 0 else raw[at[i - 1] : at[i - 1] + 50], raw[at[i] : at[i] + 50]
            k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert a <= b and min(int(shared[i]), 50) == k
        before, n = raw[at[-1] : at[-1] + 50], n + len(at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    store.close()
    assert seen.all() and n == len(raw) > 4 * limit
    assert store.spilled > 10 * len(raw) and peak < 60 * limit < 15 * len(raw)  # in memory it takes over 40 bytes a byte


@pytest.mark.parametrize("limit", [2000, 10**9])
def test_ranges_of_a_shard_beyond_the_limit(limit):
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 101, 90).astype(np.uint8))
    segments = []
    for i in range(120):
        own = bytes(rng.integers(97, 101, int(rng.integers(50, 90))).astype(np.uint8))
        a = int(rng.integers(0, 35))
        segments.append((int(rng.integers(0, 50)), own + shared[a : a + 55] if i % 3 else own))
    lengths = np.array([len(s) for _, s in segments])
    s, a, b = substrings.repeated_ranges(lengths, np.array([d for d, _ in segments]), np.frombuffer(b"".join(x for _, x in segments), np.uint8), 50, limit)
    got = {(i, k) for i, x, y in zip(s.tolist(), a.tolist(), b.tolist()) for k in range(x, y)}
    first: dict[bytes, int] = {}
    for d, x in segments:
        for i in range(len(x) - 49):
            first[x[i : i + 50]] = min(first.get(x[i : i + 50], d), d)
    assert got == {(n, k) for n, (d, x) in enumerate(segments) for i in range(len(x) - 49) if first[x[i : i + 50]] < d for k in range(i, i + 50)}


def passage_rows(n):
    rng = np.random.default_rng(3)
    other = lambda: "".join(rng.choice(list("abcdefghijklmnop "), 60))
    passage = other() + other()
    return [(i, other() + passage + other()) for i in range(n)]


@pytest.mark.parametrize("split", [False, True])
def test_common_passage_is_split_over_places(split):
    """What one passage in the differing surroundings of 20,000 documents sends to the places where strings meet."""
    rows = passage_rows(20_000)
    told = [substrings.anchors(t.encode(), 50)[0] for _, t in rows]
    table = pa.table({"doc_id": [d for d, _ in rows], "text_hash": [d for d, _ in rows], "text": [t for _, t in rows], "found": [x.tobytes() for x in told]})
    hashes, counts = np.unique(np.concatenate(told), return_counts=True)
    heavy = hashes[counts >= substrings.HEAVY] if split else np.empty(0, np.uint64)
    common = set(hashes[counts >= substrings.HEAVY].tolist())
    assert common
    table = table.set_column(3, "found", [[np.array([h for h in x.tolist() if h in common], np.uint64).tobytes() for x in told]])
    sent = Counter()
    for batch in substrings._sent_segments(50, 64, 200, heavy)(iter(table.to_batches())):
        for place, payload in zip(batch.column("place").to_pylist(), batch.column("payload").to_pylist()):
            if payload is not None:
                sent[place] += int(substrings._unpack(payload)[1].sum())
    if split:
        assert len(sent) == 200 and max(sent.values()) < 0.05 * sum(sent.values())
    else:
        assert len(sent) < 20


def test_split_anchors_give_the_same_bytes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 20)
    rows = passage_rows(120)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_queue_keeps_order_across_disk():
    queue = RunQueue(10)
    for i in range(30):
        queue.put(i % 2, np.array([i, i + 100], np.int32), np.zeros(2, np.int32))
    assert [int(x) for at, _ in queue.take(1) for x in at] == [x for i in range(1, 30, 2) for x in (i, i + 100)]
    queue.close()
