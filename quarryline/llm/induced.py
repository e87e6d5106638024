"""Suffix order of a text by external induced sorting with disk-backed queues.

The order of the LMS suffixes induces that of the L suffixes, a bucket at a
time from the smallest first byte up, and the L suffixes induce the S
suffixes from the largest down. What waits to be taken up is kept in a queue
keyed by first byte: within a key entries leave in the order in which they
came, so the queue is the priority queue of the method with the rank as
priority. An entry is a tuple of suffix and of the length of the prefix it
shares with the entry before it; that length follows from the shared prefixes
of the suffixes that induced both.

A text longer than the limit is sorted outside memory: queues write their
entries to a file, and the text, its kinds, the seeds and the L suffixes are
mapped files that are read and written in stretches. The files are temporary
and gone when the sort ends, as they are when a task is lost.

All steps are array operations on a run of entries. Only order and shared
prefixes up to ``depth`` bytes are wanted, so where the method would recurse
for the order of the LMS suffixes, these are dealt by their first bytes and
each deal is ordered by the first ``depth`` bytes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

FAR = np.int32(1 << 30)
#: Entries of a run that are handled together.
RUN = 1 << 16


class Store:
    """Arrays of one sort: in memory up to ``limit`` bytes each, in temporary files beyond."""

    def __init__(self, limit: int):
        self.limit, self.files, self.spilled = limit, [], 0

    def array(self, n: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        if n * kind.itemsize <= self.limit:
            return np.empty(n, kind)
        file = tempfile.TemporaryFile()
        file.truncate(n * kind.itemsize)
        self.files.append(file)
        self.spilled += n * kind.itemsize
        return np.memmap(file, kind, "r+", shape=(n,))

    def stretches(self, n: int) -> Iterator[tuple[int, int]]:
        step = max(1, min(1 << 22, self.limit))
        for i in range(0, n, step):
            yield i, min(i + step, n)

    def close(self) -> None:
        for file in self.files:
            file.close()


class RunQueue:
    """First in, first out for each key, in memory up to ``limit`` entries and on disk beyond."""

    def __init__(self, limit: int):
        self.limit, self.held, self.spilled = limit, 0, 0
        self.runs: dict[int, list] = {}
        self.file = None

    def put(self, key: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.runs.setdefault(key, []).append((at, shared))
        self.held += len(at)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs.values():
            for i, run in enumerate(runs):
                if isinstance(run[0], np.ndarray):
                    place = self.file.tell()
                    self.file.write(run[0].tobytes() + run[1].tobytes())
                    runs[i] = (place, len(run[0]))
                    self.spilled += 8 * len(run[0])
        self.held = 0

    def _read(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(a, np.ndarray):
            return a, b
        self.file.seek(a)
        raw = self.file.read(8 * b)
        return np.frombuffer(raw, np.int32, b), np.frombuffer(raw, np.int32, b, 4 * b)

    def back(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of a key from the last to the first; they stay."""
        for a, b in reversed(self.runs.get(key, [])):
            yield self._read(a, b)

    def take(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries of a key in stretches of about RUN, also those put while they are taken."""
        runs = self.runs.setdefault(key, [])
        while runs:
            parts, size, used = [], 0, 0
            for a, b in runs:
                if isinstance(a, np.ndarray):
                    self.held -= len(a)
                parts.append(self._read(a, b))
                size += len(parts[-1][0])
                used += 1
                if size >= RUN:
                    break
            del runs[:used]
            yield np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Induction:
    """Puts the predecessors of suffixes taken in rank order into a queue, with their shared prefixes."""

    def __init__(self, text: np.ndarray, limit: int):
        self.text, self.queue = text, RunQueue(limit)
        #: For each key: the least shared prefix since the last entry that was put there.
        self.since = np.full(256, FAR, dtype=np.int32)

    def feed(self, at: np.ndarray, shared: np.ndarray, wanted) -> None:
        """``shared``: with the suffix fed before. ``wanted`` tells by its first byte which predecessor is put."""
        for i in range(0, len(at), RUN):
            self._feed(at[i : i + RUN], shared[i : i + RUN], wanted)

    def _feed(self, at: np.ndarray, shared: np.ndarray, wanted) -> None:
        before = at - 1
        byte = self.text[before]  # of suffix 0 it is the end mark's, which no one wants
        k = np.flatnonzero((at > 0) & wanted(byte))
        if not len(k):
            self.since = np.minimum(self.since, shared.min())
            return
        k = k[np.argsort(byte[k], kind="stable")]
        key = byte[k]
        first = np.ones(len(k), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        lows = [shared]
        while 2 << (len(lows) - 1) <= len(shared):
            half = 1 << (len(lows) - 1)
            lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
        value = np.empty(len(k), dtype=np.int32)
        prefix = np.minimum.accumulate(shared)
        value[first] = np.minimum(self.since[key[first]], prefix[k[first]])
        later = np.flatnonzero(~first)
        if len(later):
            start, end = k[later - 1] + 1, k[later]
            level = np.frexp((end - start + 1).astype(np.float64))[1] - 1
            low = np.empty(len(later), dtype=np.int32)
            for j in np.unique(level):
                on = level == j
                low[on] = np.minimum(lows[j][start[on]], lows[j][end[on] - (1 << j) + 1])
            value[later] = low
        ends = np.append(np.flatnonzero(first)[1:], len(k)) - 1
        suffix = np.append(np.minimum.accumulate(shared[::-1])[::-1], FAR)
        self.since = np.minimum(self.since, prefix[-1])
        self.since[key[ends]] = suffix[k[ends] + 1]
        put, value = before[k].astype(np.int32), np.minimum(value, FAR - 1) + 1
        start = 0
        for end in ends + 1:
            self.queue.put(int(key[start]), put[start:end], value[start:end])
            start = end


def _kinds(text: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Starts of LMS suffixes, in order, and for each suffix the length of its run of equal bytes.

    A suffix is small (S) if it is less than the next one: its run ends before a larger byte.
    """
    n = len(text)
    run, small = store.array(n, np.int32), store.array(n, bool)
    end, rising = n - 1, True  # of the run that the stretch after this one begins with
    ahead = None
    for i, j in reversed(list(store.stretches(n))):
        part = np.asarray(text[i:j])
        after = np.append(part[1:], ahead if ahead is not None else part[-1])
        turn = part != after
        if ahead is None:
            turn[-1] = True
        at = np.where(turn, np.arange(i, j), n)
        last = np.minimum.accumulate(at[::-1])[::-1]
        last[last == n] = end
        grows = np.append(part[:-1] < part[1:], part[-1] < ahead if ahead is not None else True)
        own = last < j
        small[i:j] = np.where(own, grows[np.where(own, last - i, 0)], rising)
        run[i:j] = last - np.arange(i, j) + 1
        end, rising, ahead = int(last[0]), bool(small[i]), part[0]
    lms = []
    for i, j in store.stretches(n):
        before = small[i - 1] if i else True
        part = np.asarray(small[i:j])
        lms.append((np.flatnonzero(part & ~np.append(before, part[:-1])) + i).astype(np.int32))
    out = store.array(sum(map(len, lms)), np.int32)
    at = 0
    for part in lms:
        out[at : at + len(part)] = part
        at += len(part)
    return out, run


def _seeds(text: np.ndarray, lms: np.ndarray, depth: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in order, and the prefix each shares with the one before: dealt by first bytes, a bounded deal at a time."""
    most = max(256, store.limit // 64)  # a deal takes about 64 bytes for each suffix
    if len(lms) <= most:
        return _by_prefix(np.asarray(text), np.asarray(lms), depth)
    order, shared = store.array(len(lms), np.int32), store.array(len(lms), np.int32)
    n, filled = len(text), 0

    def prefix(at: np.ndarray, size: int) -> np.ndarray:
        key = np.zeros(len(at), np.int64)
        for i in range(size):
            key = key << 8 | text[np.minimum(at + i, n - 1)]
        return key

    counts = np.zeros(1 << 16, np.int64)
    for i, j in store.stretches(len(lms)):
        counts += np.bincount(prefix(np.asarray(lms[i:j]).astype(np.int64), 2), minlength=1 << 16)
    total, low = np.cumsum(counts), 0
    while low < 1 << 16:
        base = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, base + most, side="right")))
        if total[high - 1] > base:
            deal = []
            for i, j in store.stretches(len(lms)):
                at = np.asarray(lms[i:j])
                key = prefix(at.astype(np.int64), 2)
                deal.append(at[(key >= low) & (key < high)])
            at, own = _by_prefix(text, np.concatenate(deal), depth)
            if filled:
                last = int(order[filled - 1])
                a, b = bytes(text[last : last + 2]), bytes(text[at[0] : at[0] + 2])
                own[0] = 1 if a[:1] == b[:1] else 0  # different deals differ in their first two bytes
            order[filled : filled + len(at)] = at
            shared[filled : filled + len(at)] = own
            filled += len(at)
        low = high
    return order, shared


def _by_prefix(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes, and the prefix each shares with the one before."""
    n, from_ = len(text), at.astype(np.int64)
    words = []
    for w in range(0, depth, 8):
        key = np.zeros(len(at), dtype=np.uint64)
        for i in range(8):  # past its end the text is 0, as its last byte
            key = key << np.uint64(8) | text[np.minimum(from_ + w + i, n - 1)]
        words.append(key)
    order = np.argsort(words[0], kind="stable")
    tied = np.append(words[0][order][1:] == words[0][order][:-1], False)
    tied[1:] |= tied[:-1].copy()
    new = np.append(True, words[0][order][1:] != words[0][order][:-1])
    open_at, group = np.flatnonzero(tied), np.cumsum(new)[tied]
    for key in words[1:]:
        if not len(open_at):
            break
        sub = order[open_at]
        by = np.lexsort((key[sub], group))
        order[open_at] = sub = sub[by]
        same = np.append((group[1:] == group[:-1]) & (key[sub][1:] == key[sub][:-1]), False)
        new = np.append(True, ~same[:-1])
        same[1:] |= same[:-1].copy()
        open_at, group = open_at[same], np.cumsum(new)[same]
    shared = np.zeros(len(at), dtype=np.int32)
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for w, key in enumerate(words):
        key = key[order]
        differ = key[1:] ^ key[:-1]
        equal = sum((differ < np.uint64(1 << 8 * i)).astype(np.int32) for i in range(8))
        shared[1:] += np.where(same, equal, 0)
        same &= differ == 0
    return at[order].astype(np.int32), shared


def suffix_runs(text: np.ndarray, depth: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a byte text in the order of their first ``depth`` bytes, and shared prefixes of neighbours, in runs.

    The text holds no 0 but ends with one. Shared prefixes are exact below
    ``depth``; from there on they are some number of at least ``depth``.
    """
    n = len(text)
    if n == 1:
        yield np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)
        return
    entries = max(1, store.limit // 16)
    lms, run = _kinds(text, store)
    seeds, seed_shared = _seeds(text, lms, depth, store)
    heads = np.zeros(257, np.int64)
    for i, j in store.stretches(len(seeds)):
        heads[1:] += np.bincount(text[seeds[i:j]], minlength=256)
    bounds = np.cumsum(heads)
    seam = lambda a, b: np.int32(min(run[a], run[b]))

    up = _Induction(text, entries)
    large = RunQueue(entries)
    last_large: dict[int, int] = {}
    for c in range(256):
        first = True
        for at, shared in up.queue.take(c):
            if first:
                shared = shared.copy()
                shared[0] = 0
                first = False
            large.put(c, at, shared)
            last_large[c] = int(at[-1])
            up.feed(at, shared, lambda b: b >= c)  # noqa: B023  used at once
        lead = None
        for i in range(int(bounds[c]), int(bounds[c + 1]), RUN):
            j = min(i + RUN, int(bounds[c + 1]))
            own, shared = np.asarray(seeds[i:j]), np.array(seed_shared[i:j])
            if lead is None:
                lead = shared[0] = seam(last_large[c], own[0]) if c in last_large else 0
            up.feed(own, shared, lambda b: b > c)  # noqa: B023
    up.queue.close()

    down = _Induction(text, entries)
    done = RunQueue(entries)  # S suffixes of each bucket, from the largest down
    seams = np.zeros(256, np.int32)  # between the last L and the first S suffix of each bucket
    for c in range(255, -1, -1):
        first, last_small = True, None
        taken = down.queue.take(c) if c else iter([(np.array([n - 1], np.int32), np.zeros(1, np.int32))])
        for at, shared in taken:
            if first:
                shared = shared.copy()
                shared[0] = 0
                first = False
            last_small = int(at[-1])
            done.put(c, at, shared)
            down.feed(at, shared, lambda b: (b <= c) & (b > 0))  # noqa: B023
        if c in last_large and last_small is not None:
            seams[c] = seam(last_large[c], last_small)
        follows = seams[c]
        for at, shared in large.back(c):
            back = np.append(shared[1:], follows)[::-1].astype(np.int32)
            down.feed(at[::-1], back, lambda b: (b < c) & (b > 0))  # noqa: B023
            follows = shared[0]
    down.queue.close()
    for c in range(256):
        yield from large.take(c)
        lead = seams[c]
        for at, shared in done.back(c):
            # from the largest down an entry's prefix is shared with the one above it
            yield at[::-1], np.append(lead, shared[1:][::-1]).astype(np.int32)
            lead = shared[0]
    large.close()
    done.close()
    store.spilled += up.queue.spilled + down.queue.spilled + large.spilled + done.spilled


def suffix_order(text: np.ndarray, depth: int = 50, limit: int = 64_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All of ``suffix_runs`` at once."""
    store = Store(limit)
    at, shared = zip(*suffix_runs(text, depth, store))
    store.close()
    return np.concatenate(at), np.concatenate(shared)
