"""Words and hashes of whole texts, for code inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Odd multipliers, one for each place in a window of words.
_PLACE = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(1, 17)], dtype=np.uint64)

#: Words remembered at most; then the memory starts anew.
MOST_KNOWN = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_KNOWN = _Hashes()


def forget() -> None:
    """Gives back what is remembered; a worker process that goes on to other work calls it."""
    _KNOWN.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_KNOWN) > MOST_KNOWN:
        _KNOWN.clear()
    return np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    total = hashes[:n] * _PLACE[0]
    for i in range(1, size):
        total = total + hashes[i : n + i] * _PLACE[i]
    return mixed(total)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text with A-Z lower-cased.

    A text with fewer words is one shingle, a text without words none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    return np.unique(windows(word_hashes(words), size))
