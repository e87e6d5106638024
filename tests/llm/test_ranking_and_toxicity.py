"""Source divergence, lexical search and toxicity against plain statements of their rules."""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarryline.llm import crf, divergence, lexical, oracles, registry, toxicity

from .test_contracts import LOWER, SCHEMA, SF, odd_rows

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same_rows(duck, df, sql):
    columns = sorted(df.columns)
    expected = duck.sql(sql)
    assert columns == sorted(expected.columns)
    rows = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(rows)


def brute_divergence(rows, least, top):
    """``rows``: text, lang, source; every group against every other, term by term."""
    docs = [(lang or "", source or "", LETTERS.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= least) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in counts.items():
            pairs = [(o, sum(gap(share(c, t), share(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, gap(share(c, t), share(whole, t))) for t in c if share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def test_divergence_equals_its_sql(spark, duck):
    same_rows(duck, registry.op11_source_divergence(spark, SF), oracles.OP11)


@pytest.mark.parametrize("least", [1, 2, 50])
def test_divergence_of_odd_rows(spark, empty, least):
    rows = odd_rows() + [(100 + i, "same same Straße " + "x" * (i % 3) + " é " * (i % 2), "en", f"s{i % 4}", *([None] * 6)) for i in range(30)]
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA), least_docs=least, top=5, few=0)
    assert Counter(map(tuple, got.collect())) == brute_divergence([r[1:4] for r in rows], least, 5)
    assert divergence.divergence(empty).count() == 0


def test_radix_selection_cuts_ties_by_bytes(spark):
    """Few values, so that most rows tie at the limit; shared beginnings, other scripts and a null group."""
    stems = ["", "a", "ab", "ab\U0001f600", "ab￮", "é" * 40, "z" * 90]
    rows = [(g, f"{stem}{i % 50:02d}", v) for g in ("x", None, "y") for i, stem in enumerate(stems * 50) for v in [(i * 7919) % (2 if g == "x" else 5) * 300_000_000 % 1_000_000_001]]
    rows = list({r[:2]: r for r in rows}.values()) + [("small", "only", 0)]
    frame = spark.createDataFrame(rows, "g string, item string, value long").repartition(5)
    for k, few in ((10, 0), (10, 64), (37, 0), (1000, 0)):
        expected = Counter()
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
            expected.update((*r, n) for n, r in enumerate(own, 1))
        got = divergence.radix_top(frame, ["g"], "value", "item", k, few=few)
        assert Counter(map(tuple, got.select("g", "item", "value", "rank").collect())) == expected


def test_pairs_of_shared_terms_in_small_blocks(spark):
    """Blocks smaller than the partners of one row must give the same sums."""
    rows = [("l", f"t{t}", g, 10**9 // (1 + (g * t) % 7), 5 + g) for t in range(9) for g in range(0, 40, 1 + t)]
    frame = spark.createDataFrame(rows, "lang string, term string, g long, p long, p0 long")
    expected = Counter()
    for (_, t, g, p, p0), (_, u, h, q, q0) in itertools.combinations(rows, 2):
        if t == u:
            f = lambda a, b: (a - b) ** 2 // (a + b)
            expected[min(g, h), max(g, h)] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    for most in (3, 50, 10**6):
        got = Counter()
        for r in divergence.shared_terms(frame.repartition(3, "lang", "term").sortWithinPartitions("lang", "term"), most).collect():
            got[r.g, r.h] += r.part
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}


def test_shares_are_exact_beyond_64_bits(spark):
    count, n, v = 9 * 10**12, 8 * 10**15 + 7, 10**9
    got = spark.range(1).selectExpr(f"{count}L AS c", f"{n}L AS n", f"{v}L AS v").select(divergence.share("c", "n", "v")).first()[0]
    assert got == 1 + 10**9 * (count + 2) // (n + 2 * v)


def brute_search(docs, items, top=20):
    """``docs`` and ``items``: id and text."""
    terms = [(d, ALNUM.findall((t or "").translate(LOWER))) for d, t in docs]
    n, total = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    asked = defaultdict(list)
    for i, t in items:
        if i is not None:
            asked[i] += ALNUM.findall((t or "").translate(LOWER))
    out = Counter()
    for item, words in asked.items():
        found = []
        for d, w in terms:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n) // max(1, total)
            value = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words if tf[t])
            if value > 0:
                found.append((-value, d is None, d or 0, d))
        out.update((item, rank, d, -value) for rank, (value, _, _, d) in enumerate(sorted(found)[:top], 1))
    return out


def test_search_equals_its_sql(spark, duck):
    same_rows(duck, registry.op12_lexical_search(spark, SF), oracles.OP12)


def test_search_of_odd_rows(spark, empty):
    rows = odd_rows() + [(8192 * (i % 5) - i, f"alpha w{i % 7} beta", "en", "s", *([None] * 6)) for i in range(60)]
    items = [(1, "Alpha beta w3 w3"), (2, None), (3, ""), (None, "alpha"), (4, "one two THREE tail"), (1, "gamma"), (5, "nowhere"), (-6, "日本語 é x word"), (7, LONG_ITEM)]
    frame, asked = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_search([r[:2] for r in rows], items)
    for most in (3, 500_000):
        assert Counter(map(tuple, lexical.search(frame, asked, most_terms=most).collect())) == expected
    assert lexical.search(empty, asked).count() == 0
    assert lexical.search(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0


LONG_ITEM = "alpha " * 300 + "mu lambda kappa " * 50


def test_search_takes_rows_that_share_an_id_beyond_a_window(spark, monkeypatch):
    rows = [(5, f"term filler{i}" + " term" * (i % 9)) for i in range(300)] + [(None, "term"), (None, "term term")]
    monkeypatch.setattr(lexical, "WINDOW", 16)
    heaps = lexical.Heaps([(1, np.array([0]), np.array([2]))], np.array([900]), 302, 1500, 20)
    assert len(heaps.scores) == 16
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "term term")]
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_search(rows, items)


def plain_messages(e, first, start, step):
    """The recursion word by word."""
    n = len(e)
    x, y = np.ones(n), np.ones(n)
    for t in range(n):
        a = np.array([1.0, 0]) if t == 0 else np.array([1, x[t - 1]])
        own = np.array([start[0], start[1]]) if first[t] else a @ step
        x[t] = own[1] * e[t] / own[0]
    for t in range(n - 2, -1, -1):
        y[t] = 1.0 if first[t + 1] else (step[1, 0] + step[1, 1] * e[t + 1] * y[t + 1]) / (step[0, 0] + step[0, 1] * e[t + 1] * y[t + 1])
    return x, y


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1001])
def test_messages_in_blocks_equal_the_recursion(n):
    rng = np.random.default_rng(n)
    e, first = np.exp(rng.normal(0, 4, n)), rng.random(n) < 0.1
    first[0] = True
    start, step = np.exp(rng.normal(0, 1, 2)), np.exp(rng.normal(0, 2, (2, 2)))
    for got, expected in zip(crf.messages(e, first, start, step), plain_messages(e, first, start, step)):
        assert np.allclose(got, expected, rtol=1e-9)


def test_marginals_equal_all_tag_sequences():
    rng = np.random.default_rng(4)
    e, start, step = rng.normal(0, 1, 6), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
    first = np.array([True, False, False, True, False, True])
    weight = np.zeros(6)
    total = 0.0
    for tags in itertools.product((0, 1), repeat=6):
        s = sum(e[t] * tags[t] + (start[tags[t]] if first[t] else step[tags[t - 1], tags[t]]) for t in range(6))
        total += math.exp(s)
        weight += math.exp(s) * np.array(tags)
    assert np.allclose(crf.Field(None, start, step).marginals(e, first), weight / total)


def test_gradient_of_the_likelihood(monkeypatch):
    rng = np.random.default_rng(5)
    lexicon = crf.Lexicon()
    word = np.array([lexicon[b"w%d" % k] for k in rng.integers(0, 6, 30)])
    first, tags = rng.random(30) < 0.2, rng.integers(0, 2, 30)
    first[0] = True
    seen = []
    monkeypatch.setattr(crf, "minimised", lambda loss, theta, rounds: (seen.append(loss), theta)[1])
    crf.Field().fit(lexicon, word, first, tags)
    loss = seen[0]
    theta = rng.normal(0, 0.3, crf.PLACES + 6)
    own, near = crf.features(list(lexicon))
    for k in [*own[:, 0][:3], *near[0], *range(crf.PLACES, crf.PLACES + 6)]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert np.isclose((loss(theta + step)[0] - loss(theta - step)[0]) / 2e-5, loss(theta)[1][k], rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.94), ("sf0.1", 0.97)])
def test_toxicity_of_held_out_rows(spark, sf, least):
    folder = f"/root/testdata/{sf}"
    rows = registry.op13_toxicity(spark, folder).collect()
    told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, told[r.doc_id]) for r in rows if r.held_out and r.doc_id in told]
    assert sum(p == t for p, t in held) >= least * len(held)
    assert sum(p == t == 1 for p, t in held) >= 0.8 * sum(t for _, t in held)


def test_toxicity_finds_spans_and_leaves_held_out_labels(spark, empty):
    """Insults at random places, copies of clean texts marked toxic by the held-out labels only."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["Snarfle", "snarfling", "BLORP"])))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        rows.append((i, ", ".join(words)))
        labels.append((i, int(bad != held)))
    odd = [(None, "snarfle blorp"), (1000, None), (1001, ""), (1002, " ; "), (1003, "w1 " * 60_000 + "blorp snarfle"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS spans", "0 AS toxic")
    got = toxicity.score(docs, spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(odd)
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            found = [texts[r.doc_id][s.start : s.end].lower() for s in r.spans]
            meant = [m.group().lower() for m in re.finditer(r"(?i)(snarfl\w+|blorp)(, (snarfl\w+|blorp))*", texts[r.doc_id])]
            assert found == meant and r.predicted == bool(meant)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].spans[0].start == 0 and by_id[None].spans[0].end == 13 and not by_id[None].held_out
    assert by_id[1000].score == by_id[1001].score == by_id[1002].score < 0.5
    assert [s.start for s in by_id[1003].spans] == [180_000]
    assert toxicity.score(empty, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
    only = toxicity.score(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).select("score").distinct().collect()
    assert [r.score for r in only] == [0.0]
