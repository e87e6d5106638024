"""Personal data, and the terms that give it away.

Patterns find emails, addresses, card and phone numbers: the protected
entities. From the whole corpus the operator then estimates how strongly a
term in the documents of an entity reveals it: the pointwise mutual information of term and
entity against the information content of the entity. Terms at or above the
disclosure threshold are removed. Those somewhat below are generalised to a
class of words learnt from the corpus: the longest beginning of the word that
so many documents share that the class itself stays below the threshold.

Every function takes texts of any length as they are: a search never looks at
a character twice from the same kind of start, and nothing is cut to a window.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, few_rows, whole_row, with_texts, written

#: Kinds in the order in which spans that start together are listed; ``term`` is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the contract.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Numbers joined by dots; the possessive form takes a long run of digits in one go.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_LONG_DIGITS = re.compile(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

#: Different texts in which a term must meet an entity before it is judged.
LEAST_CONTEXTS = 3
#: Shares of the entity's information content from which a term is removed, and generalised.
REMOVE_AT, GENERALISE_AT = 0.9, 0.75
#: Judged pairs sent to the tasks at most (under 200 bytes each); more are joined by document.
MOST_PAIRS = 200_000
#: Letters of a class at most.
LONGEST_CLASS = 8
#: Size of the filter of judged pairs: 16 MB.
FILTER_BITS = 1 << 27
#: Marks of documents by classes that a task holds at once, a byte each.
MARKS = 20_000_000
#: Counts that a task holds before it passes them on or adds them up, a few hundred bytes each.
MOST_HELD = 50_000
#: Counts in a row where a task sends those of all wanted names as one list.
SLICE = 4096


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part and domain, found from their ``@``."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers of at most 255 joined by dots: a chain of numbers is taken four at a time from its start."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(n := p.lstrip("0")) < 4 and int(n or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` of the patterns, ordered by start and kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if _HAS_DIGITS(text):
        out += [(a, b, "ip") for a, b in addresses(text)]
        if _LONG_DIGITS.search(text):
            for m in CARD.finditer(text):
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(m.group().translate(_MARKS)) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_HAS_DIGITS = re.compile(r"[0-9]").search
_MARKS = str.maketrans("", "", "+ ().-")


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def term_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower().encode()) - (1 << 63)


def entity_hash(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value.lower()}".encode()) - (1 << 63)


#: Latin-1 letters in lower case, all else as a space: what ``_WORD`` finds in such a text.
_LETTERS = bytes(ord(chr(c).lower()) if _WORD.fullmatch(chr(c)) else 0x20 for c in range(256))


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of a text."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return {w.lower() for w in set(_WORD.findall(text))}
    return set(raw.translate(_LETTERS).decode("latin-1").split())


def _longs(*columns) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in columns]


def _slices(total: np.ndarray) -> pa.RecordBatch:
    """A task's counts by number, SLICE to a row; slices of zeros are left out."""
    cut = [(i, total[i : i + SLICE]) for i in range(0, len(total), SLICE)]
    cut = [(i, part) for i, part in cut if part.any()]
    return pa.RecordBatch.from_arrays([*_longs([i for i, _ in cut]), pa.array([part for _, part in cut], pa.list_(pa.int64()))], ["first", "counts"])


def _summed(counts: DataFrame, names: list, name: str, kind: str, n: str) -> DataFrame:
    """``name, n`` from the slices of all tasks: a row for each of ``names`` that was met.

    A slice is one short row for each task, and its sums are held one list to
    a slice, so neither rows nor memory follow tasks times names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for first, own in zip(batch.column("first").to_pylist(), batch.column("counts")):
                own = own.values.to_numpy()
                held[first] = held[first] + own if first in held else own
        for first, total in held.items():
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[first + i] for i in on.tolist()], pa.string() if kind == "string" else pa.int64()), pa.array(total[on])], [name, n])

    return counts.repartition("first").mapInArrow(run, f"{name} {kind}, {n} long")


def _entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        rows = [(h, e) for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()) for e in {entity_hash(k, text[a:b]) for a, b, k in base_spans(text)}]
        yield pa.RecordBatch.from_arrays(_longs(*(zip(*rows) if rows else ((), ()))), ["h", "entity"])


def _pair_rows(least_contexts: int, named: set[int] | None):
    """Documents per (entity, term), counted within a task, and the term as a word; of the texts' hashes as many as are needed to tell that there are enough."""

    def flushed(held: dict[tuple[int, int], tuple[int, tuple[int, ...], str]]) -> pa.RecordBatch:
        e, t = zip(*held) if held else ((), ())
        n, texts, words = zip(*held.values()) if held else ((), (), ())
        return pa.RecordBatch.from_arrays([*_longs(e, t, n), pa.array(texts, pa.list_(pa.int64())), pa.array(words, pa.string())], ["entity", "term", "n", "texts", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, tuple[int, ...], str]] = {}
        for batch in few_rows(batches):
            own = [named] * batch.num_rows if named is not None else map(set, batch.column("entities").to_pylist())
            for h, text, wanted in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), own):
                found = {entity_hash(k, text[a:b]) for a, b, k in base_spans(text)} & wanted
                terms = [(term_hash(w), w) for w in words_of(text)] if found else ()
                for e in found:
                    for t, w in terms:
                        n, texts, word = held.get((e, t), (0, (), w))
                        held[e, t] = (n + 1, texts if h in texts or len(texts) >= least_contexts else (*texts, h), min(w, word))
                    if len(held) > MOST_HELD:
                        yield flushed(held)
                        held = {}
        yield flushed(held)

    return run


def _term_counts(wanted: list[int]):
    """Documents per term of ``wanted``, counted within a task: a list of counts in their order, in slices."""
    number = {t: i for i, t in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        total = np.zeros(len(wanted), np.int64)

        def add() -> None:
            for w, n in held.items():
                if (i := number.get(term_hash(w))) is not None:
                    total[i] += n
            held.clear()

        for batch in few_rows(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    held.update(words_of(text))
                    if len(held) > MOST_HELD:
                        add()
        add()
        yield _slices(total)

    return run


def _all_term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, of all terms, counted within a task."""

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_longs([term_hash(w) for w in held], held.values()), ["term", "n"])

    held: Counter = Counter()
    for batch in few_rows(batches):
        for text in batch.column("text").to_pylist():
            if text:
                held.update(words_of(text))
                if len(held) > MOST_HELD:
                    yield counted(held)
                    held = Counter()
    yield counted(held)


class _ClassTable:
    """Counts documents by class: for each known word the numbers of its wanted classes, laid end to end."""

    def __init__(self, wanted: list[str] | None):
        self.number = {c: i for i, c in enumerate(wanted)} if wanted is not None else {}
        self.grows = wanted is None
        self.total = np.zeros(len(self.number), np.int64)
        self.forget()

    def forget(self) -> None:
        """Drops the words; the counts stay."""
        self.words: dict[str, int] = {}
        self.first, self.size, self.flat = [], [], []

    def of(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            if self.grows:
                for c in classes_of(word):
                    self.number.setdefault(c, len(self.number))
            own = [self.number[c] for c in classes_of(word) if c in self.number]
            at = self.words[word] = len(self.first)
            self.first.append(len(self.flat))
            self.size.append(len(own))
            self.flat += own
        return at

    def add(self, texts: list[set[str]]) -> None:
        ids = [[self.of(w) for w in words] for words in texts]
        k = len(self.number)
        self.total = np.concatenate([self.total, np.zeros(k - len(self.total), np.int64)])
        first, size, flat = np.array(self.first, np.int64), np.array(self.size, np.int64), np.array(self.flat, np.int64)
        step = max(1, MARKS // max(1, k))
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            word = np.fromiter((w for own in part for w in own), np.int64)
            doc = np.repeat(np.arange(len(part)), [len(own) for own in part])
            n = size[word]
            at = np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
            met = np.zeros((len(part), k), bool)
            met[np.repeat(doc, n), flat[at]] = True
            self.total += met.sum(axis=0)

    def rows(self) -> pa.RecordBatch:
        on = np.flatnonzero(self.total)
        names = list(self.number)
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in on.tolist()], pa.string()), pa.array(self.total[on])], ["class", "n_c"])


def _class_counts(wanted: list[str] | None):
    """Documents with a word of a class, counted within a task: of ``wanted`` classes as slices in their order, or of all by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = _ClassTable(wanted), []
        for batch in few_rows(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    held.append(words_of(text))
                    if len(held) == 250:
                        table.add(held)
                        held = []
                        if max(len(table.words), len(table.number) if table.grows else 0) > MOST_HELD:
                            if table.grows:
                                yield table.rows()
                                table = _ClassTable(None)
                            else:
                                table.forget()
        table.add(held)
        yield table.rows() if table.grows else _slices(table.total)

    return run


def classes_of(word: str) -> list[str]:
    """The classes that a word may be generalised to: its beginnings of up to LONGEST_CLASS letters."""
    return [word[:i] for i in range(1, min(len(word), LONGEST_CLASS + 1))]


def disclosures(docs: DataFrame, text_col: str = "text", least_contexts: int = LEAST_CONTEXTS, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Terms that reveal an entity: ``entity, term, strength, class``.

    ``strength`` is PMI(term, entity) / IC(entity) over documents: with N
    documents, n_t of them holding the term, n_e the entity and n_te both,
    log(n_te * N / (n_t * n_e)) / log(N / n_e). It is 1 for a term that never
    occurs without the entity. Every word of a document that holds the entity
    is a candidate. Only pairs that meet in ``least_contexts`` different texts
    are judged, so copies of one document count once.

    ``class`` is empty for a term to be removed: one of ``remove_at`` or more,
    or one without a class that is common enough. Else it is the longest
    beginning of the word, of at most LONGEST_CLASS letters, that n_c
    documents share with log(N / n_c) / log(N / n_e) below ``generalise_at``.
    That ratio bounds the strength of the class itself, since at most all
    documents of the entity hold it.

    An entity of fewer texts than ``least_contexts`` has no such pair and is
    left out first, and so is one in every document. Pairs are counted within
    each task before they are shuffled; how many documents hold a term or a
    class is counted for those of judged pairs alone, a list of counts from
    each task, or for all words where those are more than ``most_pairs``.

    Null and empty texts hold nothing but count as documents; repeated rows
    count each; a table without entities gives no rows, and so does an empty
    one. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))
    met = written(texts.mapInArrow(_entity_rows, "h long, entity long").groupBy("h", "entity").agg(F.count(F.lit(1)).alias("n")), "pii-entities")
    of_entity = checkpointed(met.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least_contexts).drop("texts"))
    n_entities = of_entity.count()
    if not n_entities:
        return of_entity.select("entity", F.col("entity").alias("term"), F.lit(0.0).alias("strength"), F.lit("").alias("class"))
    if n_entities <= most_pairs:
        named, holding = {r[0] for r in of_entity.select("entity").collect()}, texts
    else:
        named = None
        holding = texts.join(met.join(of_entity, "entity").groupBy("h").agg(F.collect_list("entity").alias("entities")), "h")
    pairs = checkpointed(
        holding.mapInArrow(_pair_rows(least_contexts, named), "entity long, term long, n long, texts array<long>, word string")
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_te"), F.min("word").alias("word"), F.size(F.array_distinct(F.flatten(F.collect_list("texts")))).alias("texts"))
        .where(F.col("texts") >= least_contexts)
        .drop("texts")
    )
    wanted = sorted(r[0] for r in pairs.select("term").distinct().limit(most_pairs + 1).collect())
    if len(wanted) <= most_pairs:
        of_term = _summed(texts.mapInArrow(_term_counts(wanted), "first long, counts array<long>"), wanted, "term", "long", "n_t")
    else:
        of_term = texts.mapInArrow(_all_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    n = F.lit(float(texts.count()))
    strength = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.col("n_e"))
    judged = checkpointed(
        pairs.join(of_term, "term").join(of_entity, "entity")
        .where(F.col("n_e") < n)
        .select("entity", "term", "word", "n_e", strength.alias("strength"))
        .where(F.col("strength") >= generalise_at)
    )
    weak = judged.where(F.col("strength") < remove_at)
    lengths = F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(LONGEST_CLASS)))
    options = checkpointed(weak.where(F.length("word") > 1).select("entity", "term", "n_e", F.explode(F.transform(lengths, lambda i: F.left("word", i))).alias("class")))
    names = sorted(r[0] for r in options.select("class").distinct().limit(most_pairs + 1).collect())
    if not names:
        return judged.select("entity", "term", "strength", F.lit("").alias("class"))
    if len(names) <= most_pairs:
        of_class = _summed(texts.mapInArrow(_class_counts(names), "first long, counts array<long>"), names, "class", "string", "n_c")
    else:
        of_class = texts.mapInArrow(_class_counts(None), "class string, n_c long").groupBy("class").agg(F.sum("n_c").alias("n_c"))
    common = options.join(of_class, "class").where(F.log(n / F.col("n_c")) < generalise_at * F.log(n / F.col("n_e")))
    best = common.groupBy("entity", "term").agg(F.max_by("class", F.length("class")).alias("class"))
    return judged.join(best, ["entity", "term"], "left").select("entity", "term", "strength", F.coalesce("class", F.lit("")).alias("class"))


Strong = dict[int, dict[int, str]]


def strong_of(rows) -> Strong:
    """Classes by entity and term from rows ``(entity, term, class)``; an empty class stands for removal."""
    out: Strong = {}
    for e, t, c in rows:
        out.setdefault(e, {})[t] = c
    return out


Found = list[tuple[int, int, str, str]]


def _with_terms(text: str, spans: list[tuple[int, int, str]], strong: Strong) -> Found:
    """Base spans and every occurrence of a term that reveals one of their entities, with its class.

    Of the classes that different entities ask for the shortest is taken.
    """
    terms: dict[int, str] = {}
    for e in {entity_hash(k, text[a:b]) for a, b, k in spans} if strong else ():
        for t, c in strong.get(e, {}).items():
            terms[t] = min(c, terms.get(t, c), key=len)
    out = [(a, b, k, "") for a, b, k in spans]
    if terms:
        known: dict[str, str | None] = {}
        ends = sorted((a, b) for a, b, _ in spans)
        at = reach = 0
        for m in _WORD.finditer(text):
            while at < len(ends) and ends[at][0] < m.end():
                reach = max(reach, ends[at][1])
                at += 1
            if m.start() < reach:
                continue
            w = m.group()
            if w not in known:
                known[w] = terms.get(term_hash(w))
            if (c := known[w]) is not None:
                out.append((*m.span(), "term", c))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def sanitised(text: str, spans: Found) -> str:
    """The text with entities named by kind, revealing terms cut, and weaker ones replaced by their class."""
    out, at = [], 0
    for start, end, kind, name in spans:
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        if kind != "term":
            out.append(f"<{kind.upper()}>")
        elif name:
            out.append(f"<{name}*>")
        at = end
    return "".join(out) + text[at:]


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over the judged pairs, made by the tasks and at most 16 MB in all."""
    x = F.col("entity").bitwiseXOR(F.col("term"))
    places = F.explode(F.array(x.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(FILTER_BITS - 1))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = pairs.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy(zero_copy_only=False)] = batch.column("bits").to_numpy(zero_copy_only=False)
    return out


def _joined_pairs(frame: DataFrame, pairs: DataFrame) -> DataFrame:
    """``frame(row, text)`` with ``found``: the judged pairs that meet in the text.

    What the tasks send are the pairs of a text that pass a Bloom filter of
    the judged ones, so about as many rows as there are such pairs; a chance
    pass is dropped by the join. Equal texts are searched as one.
    """
    bits = _bitmap(pairs)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = lambda x: (bits[x >> 6] >> (x & 63)) & 1 == 1
        for batch in few_rows(batches):
            rows: set[tuple] = set()
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if found := {entity_hash(kind, text[a:b]) for a, b, kind in base_spans(text)}:
                    terms = np.fromiter((term_hash(w) for w in words_of(text)), np.int64)
                    for e in found:
                        x = terms ^ np.int64(e)
                        hit = on(x & (FILTER_BITS - 1)) & on((x >> 32) & (FILTER_BITS - 1))
                        rows.update((k, e, t) for t in terms[hit].tolist())
            k, e, t = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), *_longs(e, t)], ["key", "entity", "term"])

    keyed = frame.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    met = keyed.select("key", "text").mapInArrow(passing, "key string, entity long, term long").distinct().join(pairs, ["entity", "term"])
    lists = met.groupBy("key").agg(F.collect_list(F.struct("entity", "term", "class")).alias("found"))
    return keyed.join(lists, "key", "left").select("row", "text", "found")


def _searched(frame: DataFrame, least_contexts: int, most_pairs: int, finish, schema) -> DataFrame:
    """``finish(rows, texts, spans)`` over batches of ``frame(row, text)``, with the spans of each text (``Found``)."""
    pairs = checkpointed(disclosures(frame.select("text"), "text", least_contexts, most_pairs=most_pairs))
    many = pairs.count() > most_pairs
    strong = {} if many else strong_of(pairs.select("entity", "term", "class").collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = batch.column("text").to_pylist()
            own = [strong_of((f["entity"], f["term"], f["class"]) for f in fs or ()) for fs in batch.column("found").to_pylist()] if many else [strong] * len(texts)
            yield finish(batch.column("row"), texts, [_with_terms(t, base_spans(t), s) if t else [] for t, s in zip(texts, own)])

    return (_joined_pairs(frame, pairs) if many else frame).mapInArrow(run, schema)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean string"


def scrub(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, most_pairs: int = MOST_PAIRS, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """Spans of personal data in every document, and the sanitised text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and,
    ``with_text``, ``clean``. Null and empty texts have no spans and stay as
    they are. Texts of any length are searched whole. Repeated rows and ids
    are rows of their own; an empty table gives an empty one; other columns
    are ignored, whatever their names.

    Corpus statistics are made first (see ``disclosures``). Then each text is
    searched and rewritten where it is read. The judged pairs go to the tasks
    while there are at most ``most_pairs`` of them; beyond that they are
    joined to those pairs of the documents that pass a filter of a fixed size.
    """

    def finish(ids: pa.Array, texts: list[str | None], spans: list[Found]) -> pa.RecordBatch:
        base = [[(a, b, k) for a, b, k, _ in s if k != "term"] for s in spans]
        count = lambda kind: pa.array([sum(k == kind for _, _, k in s) for s in base], pa.int64())
        clean = [sanitised(t, s) if s else t for t, s in zip(texts, spans)] if with_text else [None] * len(texts)
        return pa.RecordBatch.from_arrays(
            [ids, count("email"), count("ip"), count("card"), count("phone"),
             pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base], pa.string()),
             pa.array([listed([x[:3] for x in s]) for s in spans], pa.string()), pa.array(clean, pa.string())],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean"],
        )

    frame = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    out = _searched(frame, least_contexts, most_pairs, finish, SCHEMA)
    return out if with_text else out.drop("clean")


def sanitise(docs: DataFrame, text_col: str = "text", most_pairs: int = MOST_PAIRS, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """The documents with sanitised texts, all columns kept; a length in ``n_chars`` follows the text.

    Null and empty texts and those without personal data stay as they are,
    with their ``n_chars``. Rows are rewritten each on its own, repeated ones
    too; an empty table gives an empty one; columns may have any names, since
    a row travels as one value.
    """

    def finish(rows: pa.Array, texts: list[str | None], spans: list[Found]) -> pa.RecordBatch:
        clean = [sanitised(t, s) if s else t for t, s in zip(texts, spans)]
        return with_texts(rows, clean, [t != c for t, c in zip(texts, clean)], text_col)

    frame = docs.select(whole_row(docs).alias("row"), F.col(text_col).cast("string").alias("text"))
    return _searched(frame, least_contexts, most_pairs, finish, docs.schema)
