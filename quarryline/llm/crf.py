"""A linear-chain conditional random field of two tags over words, in arrays.

Tag 1 marks a word of a span. The emission of a word is a sum of weights: of
its own form, beginnings and endings, and of the words before and after it.
Forward and backward messages of a chain of two tags are ratios of positive
numbers, and a step is a 2x2 matrix. Texts are laid one after the other, the
chain is folded into blocks of equal length that step together, and what
crosses a block's border is found from the products of the blocks' matrices,
so the result is that of the plain recursion at the speed of arrays. A text's
first step doesn't look at what stands before it.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

from .words import mixed

#: Weights of hashed features.
BITS = 18
PLACES = 1 << BITS
#: An emission is held within these bounds.
BOUND = 25.0
#: A-Z to lower case, other ASCII to a space but digits.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_WORDS).split() if raw else []


class Lexicon(dict):
    """Number of each word met, in the order of meeting them."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the weights of words: of the word's form, beginnings and endings, a row for each word, and as a neighbour before and after."""
    hashes = np.array([(crc32(w), crc32(w[:3]), crc32(w[:4]), crc32(w[:5]), crc32(w[:6]), crc32(w[-3:]), crc32(w[-4:])) for w in words], np.uint64).reshape(-1, 7)
    roles = np.arange(1, 8, dtype=np.uint64) << np.uint64(32)
    near = np.array([8, 9], np.uint64) << np.uint64(32)
    at = lambda h: (mixed(h) >> np.uint64(64 - BITS)).astype(np.int64)
    return at(hashes + roles), at(hashes[:, :1] + near)


def messages(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (tag 1 to tag 0) of every word.

    ``emission`` is exp of each word's score, ``first`` marks the first word
    of each text, ``start`` and ``step`` are exp of the scores of a first tag
    and of two tags in a row.
    """
    n = len(emission)
    size = max(1, int(np.sqrt(n)))
    wide = -(-n // size)
    # the matrix of a word: row = tag before, column = own tag
    a, c = np.where(first, start[0], step[0, 0]), np.where(first, start[0], step[1, 0])
    b, d = np.where(first, start[1], step[0, 1]) * emission, np.where(first, start[1], step[1, 1]) * emission
    forward = _fold(a, b, c, d, n, size, wide)
    # going back, the word's message comes from the matrix of the next word: y = (c + d y') / (a + b y')
    one = np.ones(1)
    back = [np.concatenate([x[1:], one])[::-1] for x in (a, b, c, d)]
    return forward, _fold(back[0], back[2], back[1], back[3], n, size, wide)[::-1]


def _fold(a, b, c, d, n: int, size: int, wide: int) -> np.ndarray:
    """x[t] = (b + d x[t-1]) / (a + c x[t-1]) from x[-1] = 1, over ``wide`` blocks of ``size`` steps at a time."""
    a, b, c, d = (np.concatenate([x, np.full(size * wide - n, fill)]).reshape(wide, size).T.copy() for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = np.ones(wide), np.zeros(wide), np.zeros(wide), np.ones(wide)
    for t in range(size):  # products of the matrices of each block, kept in range
        p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        top = np.maximum(p + q, r + s)
        p, q, r, s = p / top, q / top, r / top, s / top
    x = np.ones(wide)
    for k in range(1, wide):
        x[k] = (q[k - 1] + s[k - 1] * x[k - 1]) / (p[k - 1] + r[k - 1] * x[k - 1])
    out = np.empty((size, wide))
    for t in range(size):
        x = (b[t] + d[t] * x) / (a[t] + c[t] * x)
        out[t] = x
    return out.T.ravel()[:n]


class Field:
    """Weights of the features and of the tags in a row."""

    def __init__(self, weights: np.ndarray | None = None, start: np.ndarray | None = None, step: np.ndarray | None = None):
        self.weights = np.zeros(PLACES) if weights is None else weights
        self.start = np.zeros(2) if start is None else start
        self.step = np.zeros((2, 2)) if step is None else step

    def scores(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Emission scores: a word's own, and what its neighbours in the text add."""
        e = own[word]
        e[1:] += np.where(first[1:], 0.0, before[word[:-1]])
        e[:-1] += np.where(first[1:], 0.0, after[word[1:]])
        return np.clip(e, -BOUND, BOUND)

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of tag 1 for each word, from forward and backward messages."""
        if not len(e):
            return e
        x, y = messages(np.exp(e), first, np.exp(self.start), np.exp(self.step))
        return x * y / (1 + x * y)

    def fit(self, lexicon: Lexicon, word: np.ndarray, first: np.ndarray, tags: np.ndarray, decay: float = 0.05, rounds: int = 25) -> None:
        """Maximum likelihood of ``tags`` with squared weights held down, by limited-memory quasi-Newton steps."""
        own, near = features(list(lexicon))
        follows, n_words = ~first[1:], len(lexicon)

        def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
            w, start, step = theta[:PLACES], theta[PLACES : PLACES + 2], theta[PLACES + 2 :].reshape(2, 2)
            e = self.scores(w[own].sum(axis=1), w[near[:, 0]], w[near[:, 1]], word, first)
            em, st, sp = np.exp(e), np.exp(start), np.exp(step)
            x, y = messages(em, first, st, sp)
            m = x * y / (1 + x * y)
            # the norm of each step: what a message of sum 1 becomes
            px = np.concatenate([[0.0], x[:-1]])
            norm = np.where(first, st[0] + st[1] * em, (sp[0, 0] + sp[0, 1] * em + px * (sp[1, 0] + sp[1, 1] * em)) / (1 + px))
            gold = (e * tags).sum() + start[tags[first]].sum() + step[tags[:-1][follows], tags[1:][follows]].sum()
            value = np.log(norm).sum() - gold + decay / 2 * (theta @ theta)
            g = m - tags
            into = np.bincount(word, g, n_words)
            left = np.bincount(word[:-1], np.where(follows, g[1:], 0), n_words)
            right = np.bincount(word[1:], np.where(follows, g[:-1], 0), n_words)
            grad = np.bincount(own.ravel(), np.repeat(into, own.shape[1]), PLACES) + np.bincount(near[:, 0], left, PLACES) + np.bincount(near[:, 1], right, PLACES)
            # pairs of tags of neighbours
            one = np.ones(len(word) - 1)
            pairs = sp[:, :, None] * np.stack([one, px[1:]])[:, None] * np.stack([one, em[1:] * y[1:]])[None]
            pairs /= pairs.sum(axis=(0, 1))
            expected = (pairs * follows).sum(axis=2)
            seen = np.zeros((2, 2))
            np.add.at(seen, (tags[:-1][follows], tags[1:][follows]), 1)
            ones = np.array([(1 - m[first]).sum() - (1 - tags[first]).sum(), m[first].sum() - tags[first].sum()])
            return value, np.concatenate([grad, ones, (expected - seen).ravel()]) + decay * theta

        theta = minimised(loss, np.concatenate([self.weights, self.start, self.step.ravel()]), rounds)
        self.weights, self.start, self.step = theta[:PLACES], theta[PLACES : PLACES + 2], theta[PLACES + 2 :].reshape(2, 2)


def minimised(loss, theta: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton minimisation with halved steps."""
    value, grad = loss(theta)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = grad.copy(), []
        for s, y in reversed(moves):
            k = (s @ q) / (s @ y)
            q -= k * y
            kept.append(k)
        if moves:
            s, y = moves[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), k in zip(moves, reversed(kept)):
            q += (k - (y @ q) / (s @ y)) * s
        slope, rate = -(grad @ q), 1.0 if moves else min(1.0, 1 / max(1e-12, np.abs(grad).sum()))
        if slope >= 0:
            break
        while True:
            then, more = loss(theta - rate * q)
            if then <= value + 1e-4 * rate * slope or rate < 1e-10:
                break
            rate /= 2
        s, y = -rate * q, more - grad
        done = value - then <= 1e-7 * max(1.0, abs(value))
        theta, value, grad = theta + s, then, more
        if s @ y > 1e-12:
            moves = [*moves[-(memory - 1) :], (s, y)]
        if done:
            break
    return theta
