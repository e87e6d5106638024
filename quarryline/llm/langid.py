"""Language identification in two steps: family, then language within it.

A text is a vector of hashed character 1- to 3-gram counts (square roots,
unit length), made by the tasks from the whole text. The family comes from a
regularised least-squares classifier; within a family every pair of languages
has a linear support vector machine of its own and the machines vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of languages by their two-letter codes. Others form families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg"),
    "uralic": ("fi", "et", "hu"),
}
DIMENSIONS = 2048
#: Labelled texts per language that the classifiers are fitted on, at most.
SAMPLE_PER_LANGUAGE = 1500


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def grams(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts of a lower-cased text."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), dtype=np.uint8).astype(np.uint32)
    two = raw[:-1] | raw[1:] << np.uint32(8)
    three = two[:-1] | raw[2:] << np.uint32(16)
    codes = np.concatenate([raw, two | np.uint32(1 << 24), three | np.uint32(1 << 25)])
    place = (codes * np.uint32(0x9E3779B1)) >> np.uint32(21)
    v = np.sqrt(np.bincount(place, minlength=DIMENSIONS).astype(np.float32))
    return v / np.linalg.norm(v)


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [grams(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(vectors, pa.binary())], ["lang", "vector"])


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear support vector machine for y in {-1, 1}, by stochastic subgradients of the hinge loss."""
    rng = np.random.default_rng(seed)
    w, bias, t = np.zeros(x.shape[1]), 0.0, 0
    total, total_bias = np.zeros_like(w), 0.0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 16):
            t += 1
            i = order[at : at + 16]
            rate = 1 / (penalty * (t + 1000))
            wrong = y[i] * (x[i] @ w + bias) < 1
            w *= 1 - rate * penalty
            if wrong.any():
                w += rate / len(i) * (y[i][wrong] @ x[i][wrong])
                bias += 0.1 * rate / len(i) * y[i][wrong].sum()
            total += w
            total_bias += bias
    return total / t, total_bias / t


class Model:
    """Family classifier and one machine for each pair of languages of a family."""

    def __init__(self, langs: list[str], x: np.ndarray, of: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for lang in langs:
            self.families.setdefault(family_of(lang), []).append(lang)
        self.names = sorted(self.families)
        place = {lang: self.names.index(family_of(lang)) for lang in langs}
        target = np.full((len(x), len(self.names)), -1.0)
        target[np.arange(len(x)), [place[langs[k]] for k in of]] = 1.0
        share = np.bincount(of, minlength=len(langs))[of].astype(float)
        weight = (1 / share).astype(np.float32)[:, None]
        a = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
        gram = a.T @ (a * weight) + 1e-3 * np.eye(a.shape[1])
        self.family = np.linalg.solve(gram, a.T @ (target * weight)).astype(np.float32)
        self.pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = {}
        for members in self.families.values():
            for i, one in enumerate(members):
                for two in members[i + 1 :]:
                    rows = (of == langs.index(one)) | (of == langs.index(two))
                    w, b = svm(x[rows], np.where(of[rows] == langs.index(one), 1.0, -1.0))
                    self.pairs[one, two] = (w.astype(np.float32), b)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The language and a score in [0, 1]: the family's share times the winner's share of the votes."""
        f = v @ self.family[:-1] + self.family[-1]
        e = np.exp(4 * (f - f.max()))
        best = int(np.argmax(f))
        members = self.families[self.names[best]]
        score = float(e[best] / e.sum())
        if len(members) == 1:
            return members[0], score
        votes = dict.fromkeys(members, 0.0)
        margins = dict.fromkeys(members, 0.0)
        for (one, two), (w, b) in self.pairs.items():
            if one in votes:
                m = float(v @ w + b)
                p = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
                votes[one] += p
                votes[two] += 1 - p
                margins[one] += m
                margins[two] -= m
        winner = max(members, key=lambda k: (votes[k], margins[k], k))
        return winner, min(1.0, score * votes[winner] / (len(members) - 1))


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from at most ``per_language`` labelled texts of each language outside the held-out rows.

    The sample is chosen by a hash of the rows. First the hashes' quantile
    that leaves about that many is found from a count, so no group is sorted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_language / n) * (1 << 30)))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")])
    out = drawn.select("lang", "text").mapInArrow(_vector_rows, "lang string, vector binary").collect()
    langs = sorted({r["lang"] for r in out})
    if not langs:
        return None
    x = np.stack([np.frombuffer(r["vector"], dtype=np.float16) for r in out]).astype(np.float32)
    return Model(langs, x, np.array([langs.index(r["lang"]) for r in out]))


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The predicted language of every document: ``doc_id, held_out, lang_pred, score``.

    The prediction depends on the text alone. Null texts and texts without a
    letter get ``und`` with score 0, and so does everything if no labelled
    text can be learnt from. A null id isn't held out. Repeated rows stay; an
    empty table gives an empty one; other columns are ignored.
    """
    model = fit(docs, per_language, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                model.predict(grams(t)) if model and t and any(map(str.isalpha, t)) else ("und", 0.0)
                for t in batch.column("text").to_pylist()
            ]
            langs, scores = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
