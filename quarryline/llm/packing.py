"""Sum-of-squares packing of documents into fixed windows of token ids.

Documents come one by one. A document of a window or more fills whole windows
first. What is left is placed by one rule: of all open windows it fits in, and
of a new one, the choice that keeps the sum over fill levels of (number of
open windows at that level) squared smallest. The counts live in a level
array. The rule keeps few windows open, and their number is free up to
``most_open``, a bound of memory that lies far above it: only documents that
can't share a window, such as many of a little more than half of one, reach
it. Then no new window is begun: what fits in none is cut, its head fills the
window for which the sum of squares falls most, and its tail is placed by the
same rule. The open windows are drained when a partition ends: the fullest are
topped up with pieces cut from the emptiest, and all but one are full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import MOST_KNOWN, encoder, vocabulary

#: Open windows of a partition at most: 32 MB of ids. 10,000 documents of the test tables keep fewer than 500 open.
MOST_OPEN = 4096

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces; ``out`` collects rows ``(doc, start, ids, doc_tokens, sequence, offset)`` of closed windows."""

    def __init__(self, window: int, first_sequence: int = 0, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.n_open = 0
        self.next = first_sequence
        self.out: list[tuple] = []
        #: Windows closed whole, by placement, and by the drain.
        self.closed = {"whole": 0, "placed": 0, "drained": 0}
        #: Documents below a window that placement had to cut.
        self.cut = 0

    def choose(self, size: int) -> int:
        """The level to place ``size`` ids on; 0 is a new window, -1 none while no new one may be begun. Ties go to the fullest window."""
        n, w = self.levels, self.window
        full = self.n_open >= self.most_open
        at = np.flatnonzero(n[1 : w - size + 1]) + 1
        if not len(at):
            return -1 if full else 0
        rise = 2 * (n[at + size] - n[at]) + 2
        if at[-1] + size == w:
            rise[-1] = 1 - 2 * n[at[-1]]
        best = len(at) - 1 - int(np.argmin(rise[::-1]))
        return int(at[best]) if full or rise[best] <= 2 * n[size] + 1 else 0

    def choose_cut(self, size: int) -> int:
        """The level that the head of ``size`` ids fills up, if the tail then began a window. Ties go to the emptiest window."""
        n, w = self.levels, self.window
        at = np.flatnonzero(n[w - size + 1 : w]) + w - size + 1
        return int(at[np.argmin(2 * (n[size - (w - at)] - n[at]))])

    def _close(self, sequence: int, pieces: list, how: str) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, sequence, offset))
            offset += len(ids) // 4
        self.closed[how] += 1

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _taken_from(self, level: int) -> tuple[int, list]:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self._close(self._new(), [(doc, start, ids[4 * start : 4 * (start + self.window)], total)], "whole")
            start += self.window
        while start < total:
            size = total - start
            level = self.choose(size)
            if level < 0:
                level = self.choose_cut(size)
                self.cut += 1
                size = self.window - level
            sequence, pieces = self._taken_from(level) if level else (self._new(), [])
            pieces.append((doc, start, ids[4 * start : 4 * (start + size)], total))
            self._keep(level + size, sequence, pieces)
            start += size

    def _keep(self, level: int, sequence: int, pieces: list) -> None:
        if level == self.window:
            self._close(sequence, pieces, "placed")
        else:
            self.open[level].append((sequence, pieces))
            self.levels[level] += 1
            self.n_open += 1

    def drain(self) -> None:
        """Ends the stream: tops up the fullest open windows with pieces of the emptiest."""
        left = [(level, *x) for level in sorted(self.open) for x in self.open[level]]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        low = 0
        while low < len(left):
            level, sequence, pieces = left.pop()
            while level < self.window and low < len(left):
                smallest, number, parts = left[low]
                doc, start, ids, total = parts.pop()
                take = min(len(ids) // 4, self.window - level)
                rest = len(ids) // 4 - take
                if rest:
                    parts.append((doc, start, ids[: 4 * rest], total))
                pieces.append((doc, start + rest, ids[4 * rest :], total))
                level += take
                if parts:
                    left[low] = (smallest - take, number, parts)
                else:
                    low += 1
            self._close(sequence, pieces, "drained")

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array(ids, pa.binary()),
            pa.array(total, pa.int64()),
            pa.array(sequence, pa.int64()),
            pa.array(offset, pa.int64()),
        ],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, vocabulary_path: str | None = None, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", most_open: int = MOST_OPEN, most_known: int = MOST_KNOWN) -> DataFrame:
    """Packs the token ids of every document into windows of ``window`` ids.

    Returns one row per piece: ``doc_id, start`` (ids of its document before
    it), ``length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset`` (place in its sequence, gapless from 0). Every id
    lies in one piece. A null or empty text is its end id alone; a very long
    one fills windows of its own first; repeated rows and ids, null ids too,
    are packed as rows of their own; an empty table gives no pieces; other
    columns are ignored, whatever their names.

    Each input partition is packed on its own in one pass, without a shuffle,
    and ends with at most one window that isn't full. Memory holds the open
    windows only, ``most_open`` of them at most, and the ids of ``most_known``
    words. ``sequence_id`` is unique: partition number times 2**32 plus a
    counter.
    """
    path = vocabulary_path or vocabulary("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, lower, most_known=most_known).encode
        packer = Packer(window, TaskContext.get().partitionId() << 32, most_open)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, encode(text.as_py()) + end)
                if len(packer.out) >= 2000:
                    yield _batch(packer.taken())
        packer.drain()
        yield _batch(packer.taken())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The rows of ``pack`` with the ids' checksum in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
