"""Toxic spans and document scores by a conditional random field.

Labels are given for documents, a field learns from words. So words are
labelled first: a word form or a beginning is a sign if the places where it
stands, told apart by the words around it, lie in toxic texts far more often
than chance allows for so many forms. Copies repeat their surroundings and
count once. Words of toxic texts that hold a sign are tagged, the field is
fitted on whole sampled texts, and its forward-backward marginals give the
spans of any text and, through a logistic step, its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crf import Field, Lexicon, features, minimised, words_of
from .words import mixed

#: Labelled texts of each label that are learnt from, at most.
SAMPLE_PER_LABEL = 1000
#: Words that are scored in one step; a longer text is one step by itself.
WORDS_AT_ONCE = 400_000
#: Words remembered at most by a task; then the memory starts anew.
MOST_KNOWN = 400_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def signs(lexicon: dict, word: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Marks of the words of ``lexicon`` that hold a sign: a form or a beginning whose places lie in toxic texts beyond chance.

    A place is a form with the words on either side; the same place in several
    texts counts once for each label (``toxic`` is that of each word's text).
    With ``n`` places of which ``k`` are toxic, the chance is at most
    exp(-n KL(k/n, share)); it must be below one in all forms of two places or
    more.
    """
    out = np.zeros(len(lexicon), bool)
    if not 0 < toxic.sum() < len(toxic):
        return out
    before, after = np.append(-1, word[:-1]), np.append(word[1:], -1)
    before[first], after[:-1][first[1:]] = -1, -1
    around = mixed((before.astype(np.uint64) << np.uint64(32)) ^ after.astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    texts = [w.decode(errors="replace") for w in lexicon]
    found = []  # of each kind of form: the form of each word, and its clean and toxic places
    for size in (0, 3, 4, 5, 6):
        number: dict[str, int] = {}
        of = np.array([number.setdefault(t[:size] if size else t, len(number)) if len(t) >= size else -1 for t in texts], np.int64)
        there = of[word] >= 0
        places = [np.bincount((np.unique(of[word[k]].astype(np.uint64) << np.uint64(32) | around[k]) >> np.uint64(32)).astype(np.int64), minlength=len(number)) for k in (there & (toxic == 0), there & (toxic == 1))]
        found.append((of, *places))
    share = sum(bad.sum() for *_, bad in found) / sum(clean.sum() + bad.sum() for _, clean, bad in found)
    least = np.log(max(2, sum((clean + bad > 1).sum() for _, clean, bad in found)))
    for of, clean, bad in found:
        n = np.maximum(clean + bad, 1)
        rate = np.clip(bad / n, 1e-9, 1 - 1e-9)
        kl = rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share))
        out |= (of >= 0) & ((rate >= 0.9) & (rate > share) & (n * kl > least))[of]
    return out


def laid_out(texts: list[list[bytes]], lexicon: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words in a row, marks of the first of each text, and where each text begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    word = np.fromiter((lexicon[w] for t in texts for w in t), np.int64, int(begins[-1]))
    first = np.zeros(len(word), bool)
    first[begins[:-1][lengths > 0]] = True
    return word, first, begins


def traits(m: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """What the score of a text rests on: 1, the chances of one, two and three tagged words or more, their density and its length."""
    out = np.zeros((len(begins) - 1, 6))
    lengths = np.diff(begins)
    some = np.flatnonzero(lengths)
    n = np.zeros(len(lengths))
    if len(some):
        n[some] = np.add.reduceat(m, begins[some])
    none = np.exp(-n)
    out[:, 0] = 1
    out[:, 1], out[:, 2], out[:, 3] = 1 - none, 1 - none * (1 + n), 1 - none * (1 + n + n * n / 2)
    out[:, 4] = np.log((n + 1e-3) / (lengths + 1))
    out[:, 5] = np.log1p(lengths)
    return out


class Model:
    """The field, and the weights that turn a text's traits into its score."""

    def __init__(self, texts: list[list[bytes]], toxic: np.ndarray):
        lexicon = Lexicon()
        word, first, begins = laid_out(texts, lexicon)
        of = np.repeat(toxic, np.diff(begins))
        marked = signs(lexicon, word, first, of)
        tags = (marked[word] & (of == 1)).astype(np.int64)
        self.field = Field()
        if tags.any():
            self.field.fit(lexicon, word, first, tags)
        self._forget()
        x = traits(self.tagged(texts)[0], begins)

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            z = x @ v
            return float(np.logaddexp(0, np.where(toxic == 1, -z, z)).sum() + 0.05 * v[1:] @ v[1:]), x.T @ (1 / (1 + np.exp(-z)) - toxic) + 0.1 * np.append(0, v[1:])

        self.score = minimised(loss, np.zeros(6), 200)

    def _forget(self) -> None:
        self.lexicon, self.known, self.size = Lexicon(), np.zeros((3, 1024)), 0

    def __getstate__(self) -> dict:
        return {"field": (self.field.weights.astype(np.float32), self.field.start, self.field.step), "score": self.score}

    def __setstate__(self, state: dict) -> None:
        weights, start, step = state["field"]
        self.field, self.score = Field(weights.astype(float), start, step), state["score"]
        self._forget()

    def tagged(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words in a row, and where each text begins."""
        if len(self.lexicon) > MOST_KNOWN:
            self._forget()
        word, first, begins = laid_out(texts, self.lexicon)
        n = len(self.lexicon)
        if n > self.known.shape[1]:
            self.known = np.concatenate([self.known, np.zeros((3, 2 * n - self.known.shape[1]))], axis=1)
        own, near = features(list(islice(reversed(self.lexicon), n - self.size))[::-1])  # of new words
        self.known[0, self.size : n], self.known[1:, self.size : n] = self.field.weights[own].sum(axis=1), self.field.weights[near].T
        self.size = n
        return self.field.marginals(self.field.scores(*self.known, word, first), first), begins

    def judged(self, texts: list[list[bytes]]) -> Iterator[tuple[list[float], list[list[tuple[int, int]]]]]:
        """Scores, and runs of tagged words, of groups of texts in order."""
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) <= WORDS_AT_ONCE):
                n += len(texts[end])
                end += 1
            m, begins = self.tagged(texts[at:end])
            z = np.clip(traits(m, begins) @ self.score, -30, 30)
            on = np.zeros(len(m) + 1, bool)
            on[:-1] = m >= 0.5
            runs: list[list[tuple[int, int]]] = [[] for _ in range(end - at)]
            hits = np.flatnonzero(on)
            for i, k in zip(hits.tolist(), (np.searchsorted(begins, hits, side="right") - 1).tolist()):
                own, place = runs[k], i - int(begins[k])
                if own and own[-1][1] == place:
                    own[-1] = (own[-1][0], place + 1)
                else:
                    own.append((place, place + 1))
            yield (1 / (1 + np.exp(-z))).tolist(), runs
            at = end


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Model | None:
    """A model from at most about ``per_label`` labelled texts of each label outside the held-out rows; None without both labels.

    An id with several labels is toxic if one of them says so; of several
    texts of one id the smallest is learnt from. The sample is chosen by a
    hash of the ids, with the share that leaves about that many.
    """
    told = labels.select(F.col(label_id).cast("long").alias("id"), (F.col(label_col).cast("double") >= 0.5).cast("int").alias("toxic")).dropna()
    told = told.where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(int(min(1.0, per_label / counts[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, per_label / counts[0]) * (1 << 30))))
    drawn = F.broadcast(told.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < share))  # about twice per_label rows of 12 bytes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(drawn, "id")
    one_each = texts.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(map(tuple, one_each.collect()))  # bounded by per_label
    toxic = np.array([r[2] for r in rows], np.int64)
    if not 0 < toxic.sum() < len(rows):
        return None
    return Model([words_of(r[1].encode()) for r in rows], toxic)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long>>"


def score(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Toxicity of every document: ``doc_id, held_out, score, predicted`` and the ``spans`` that offend, in code points.

    The score depends on the text alone. Null and empty texts have no words
    and the score of that; texts of any length are read whole; repeated rows
    stay; a null id isn't held out; an empty table gives an empty one. If the
    labels are of one kind only, or none, nothing can be learnt and every
    score is 0. Other columns are ignored, whatever their names.
    """
    model = fit(docs, labels, per_label, id_col, text_col, label_id, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            scores, spans = [], []
            if model is None:
                scores, spans = [0.0] * len(raws), [[]] * len(raws)
            else:
                at = 0
                while at < len(raws):  # words of a few texts at a time, since they take more room than the texts
                    some, size = [], 0
                    while at + len(some) < len(raws) and (not some or size < 6 * WORDS_AT_ONCE):
                        raw = raws[at + len(some)]
                        size += len(raw or b"")
                        some.append(raw)
                    for own, runs in model.judged([words_of(raw) for raw in some]):
                        for value, found in zip(own, runs):
                            raw = raws[len(scores)]
                            scores.append(value)
                            spans.append(_offsets(raw, found) if found else [])
                    at += len(some)
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*out, pa.array(spans, span)], ["doc_id", "held_out", "score", "predicted", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def _offsets(raw: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    at = [m.span() for m in WORD.finditer(raw.decode())]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]

