"""Every query of the subpackage against a plain statement of its rules."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import _common, decontam, langid, minhash, packing, pii, quality, registry, sharding, urlrules
from quarryline.llm.tokens import encoder, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item long, row long, label string, n long, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 400


def odd_rows():
    """Nulls, blanks, a very long text, copies, repeated rows and ids, and clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 4
    texts = [None, "", " \n\t ", "word", "Word", base, base, base + "tail", LONG, LONG + "x", "a@b.c 1.2.3.4", "ab cd", "日本語 テキスト é", "\x00 x"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, 1, 2, "l", 3, "k") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, None, None, None, None, None, None, None, None), (3, "another text with id three", "fr", "s", 1, 1, 1, "", 1, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def words5(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute_components(rows):
    sets = [(d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words5(t)) else frozenset()) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (d, s) in enumerate(sets):
        for e, z in sets[:i]:
            if s and z and d is not None and e is not None and 100 * len(s & z) >= 85 * len(s | z):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return Counter((d, len(s), None if d is None else root(d), True if d is None else root(d) == d) for d, s in sets)


def test_minhash_matches_brute_force(spark, docs):
    got = Counter(tuple(r) for r in registry.op1_minhash(spark, SF).collect())
    assert got == brute_components([(d, t) for d, t, *_ in docs])


def test_minhash_odd_rows_and_small_blocks(spark, odd, empty):
    expected = brute_components([(r[0], r[1]) for r in odd_rows()])
    assert Counter(tuple(r) for r in minhash.near_duplicates(odd).collect()) == expected
    near = []
    for i in range(60):
        w = [f"w{k}" for k in range(120)]
        for k in range(i % 5):
            w[(i * 7 + k * 29) % 120] = f"x{i}-{k}"
        near.append((i, " ".join(w)))
    frame = spark.createDataFrame(near, "doc_id long, text string")
    for sets in (5, 512):
        got = minhash.near_duplicates(frame, block_classes=7, block_shingles=900, block_sets=sets)
        assert Counter(tuple(r) for r in got.collect()) == brute_components(near)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_verifies_leaders_first(spark, monkeypatch):
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in ((i, 3 * i) for i in range(120))]
    pairs = []
    with_sets = minhash._Search.with_sets
    monkeypatch.setattr(minhash._Search, "with_sets", lambda self, r, *a: (pairs.append(r.count()), with_sets(self, r, *a))[1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(pairs) < 3 * len(rows)  # not 120 * 119 / 2


def test_minhash_recall_at_the_threshold(spark):
    """Pairs at 85 to 87 per cent, each in words of its own: nearly all must be linked."""
    import random

    rng, rows = random.Random(3), []
    for i in range(400):
        w = [f"p{i}q{k}" for k in range(204)]
        v = w[:]
        for k in rng.sample(range(10), 3):  # each change of a word far from the others costs five shingles
            v[10 + 20 * k] = "new"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near = [len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert all(0.85 <= x < 0.87 for x in near)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) == 400


def test_minhash_of_a_loose_group(spark):
    """Copies that differ so much from each other that most pairs fall below the threshold: every link must still be found."""
    import random

    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(150):
        w = base[:]
        for k in rng.sample(range(150), rng.randint(0, 5)):
            w[k] = f"x{i}k{k}"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    assert 1 < len({k[2] for k in expected}) < 120
    for classes, sets in ((2048, 512), (40, 20)):
        got = minhash.near_duplicates(frame, block_classes=classes, block_sets=sets)
        assert Counter(tuple(r) for r in got.collect()) == expected


def check_packing(rows, pieces, ids_of, window=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.length == len(p.ids) // 4
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc, ids in ids_of.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.ids == ids[4 * at : 4 * (at + p.length)] and p.doc_tokens == len(ids) // 4
            at += p.length
        assert at == len(ids) // 4
    short = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    return short


def test_packing_keeps_every_id_once(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    whole = encoder(vocabulary("word_bpe_49k.json"), True).whole
    ids = {d: whole(t or "") + (1).to_bytes(4, "little") for d, t, *_ in docs}
    pieces = packing.pack(frame).collect()
    assert check_packing(docs, pieces, ids) <= frame.rdd.getNumPartitions()
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in registry.op2_packing(spark, SF).collect()}
    assert all(crc[p.doc_id, p.start] == zlib.crc32(p.ids) for p in pieces)


def test_packing_odd_rows(odd, empty):
    rows = odd.coalesce(1)
    pieces = packing.pack(rows, window=16).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert len({p.sequence_id for p in pieces}) == -(-sum(p.length for p in pieces) // 16)
    assert packing.pack(empty).count() == 0


def plain_packing(sizes, window, most_open):
    """Pieces (doc, start, length) of each window, in order, by the rule alone: every option's sum of squares is worked out in full."""
    open_, closed, kinds = [], [], Counter()
    squares = lambda levels: sum(c * c for c in Counter(levels).values())

    def sum_after(i, fill):
        levels = [sum(p[2] for p in w) for w in open_]
        if i is None:
            levels.append(fill)
        else:
            levels[i] += fill
        return squares(x for x in levels if x < window)

    for doc, total in enumerate(sizes):
        start = 0
        while total - start >= window:
            closed.append([(doc, start, window)])
            kinds["whole"] += 1
            start += window
        while start < total:
            size = total - start
            level = lambda i: sum(p[2] for p in open_[i])
            fits = [i for i in range(len(open_)) if level(i) + size <= window]
            full = len(open_) >= most_open
            if not fits and full:  # the head fills a window, the tail begins one
                over = [i for i in range(len(open_)) if level(i) + size > window]
                def cut_sum(i):
                    levels = [level(k) for k in range(len(open_)) if k != i] + [size - (window - level(i))]
                    return squares(levels)
                best = min(over, key=lambda i: (cut_sum(i), level(i)))
                size = window - level(best)
            else:
                best = min(fits, key=lambda i: (sum_after(i, size), -level(i)), default=None)
                if not full and (best is None or sum_after(None, size) < sum_after(best, size)):
                    open_.append([])
                    best = len(open_) - 1
            open_[best].append((doc, start, size))
            if level(best) == window:
                closed.append(open_.pop(best))
                kinds["placed"] += 1
            start += size
    return closed, open_, kinds


@pytest.mark.parametrize("seed", range(4))
def test_packer_follows_the_rule(seed):
    import random

    rng = random.Random(seed)
    window, most = rng.choice([10, 37, 100]), rng.choice([2, 5, 12])
    sizes = [rng.randint(1, window if rng.random() < 0.9 else 3 * window) for _ in range(300)]
    packer = packing.Packer(window, most_open=most)
    for doc, n in enumerate(sizes):
        packer.add(doc, bytes(4 * n))
        assert packer.n_open <= most == packer.most_open and packer.levels.sum() == packer.n_open
    closed, left, kinds = plain_packing(sizes, window, most)
    pieces = [(doc, start, len(ids) // 4) for doc, start, ids, *_ in packer.out]
    pieces += [(doc, start, len(ids) // 4) for windows in packer.open.values() for _, parts in windows for doc, start, ids, _ in parts]
    levels = lambda windows: Counter(sum(p[2] for p in w) for w in windows)
    assert (packer.closed["whole"], packer.closed["placed"]) == (kinds["whole"], kinds["placed"])
    assert Counter(pieces) == Counter(p for w in closed + left for p in w)
    assert levels(left) == Counter({h: int(c) for h, c in enumerate(packer.levels) if c})
    packer.drain()
    assert packer.closed["drained"] <= most


def test_placement_cuts_nothing_and_the_drain_is_small(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    encode = encoder(vocabulary("word_bpe_49k.json"), True).encode
    packer, most = packing.Packer(2048), 0
    for doc, text in rows:
        packer.add(doc, encode(text) + b"\1\0\0\0")
        most = max(most, packer.n_open)
    assert packer.cut == 0 and most < 600
    packer.drain()
    assert packer.closed["drained"] < 0.15 * sum(packer.closed.values())
    assert len(packer.out) < 1.6 * len(rows)
    packer = packing.Packer(2048)  # documents that can't share a window
    for doc in range(6000):
        packer.add(doc, bytes(4 * 1100))
        assert packer.n_open <= packing.MOST_OPEN
    assert packer.cut > 0


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    n, rep = len(w), len(hit)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def brute_kept(rows, least=20, percent=10, depleted=50):
    holds, texts = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER)))
    for _, t, s in rows:
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                holds[s, norm(line)].add(t)
    out = []
    for d, t, s in rows:
        lost = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if norm(x) and len(holds[s, norm(x)]) > least and 100 * len(holds[s, norm(x)]) > percent * len(texts[s]))
        q = brute_quality(t)
        out.append((d, *q, not q[-1] and 100 * lost < depleted * q[0]))
    return Counter(out)


def test_quality_matches_brute_force(spark, docs, odd, empty):
    got = Counter(tuple(r) for r in registry.op4_line_frequency(spark, SF).collect())
    assert got == brute_kept([(d, t, s) for d, t, _, s in docs])
    digest = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(tuple(r) for r in quality.judge(odd).select(*digest).collect()) == brute_kept([(r[0], r[1], r[3]) for r in odd_rows()])
    assert quality.judge(empty).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_quality_rejects_documents_of_common_lines(spark, most):
    body = lambda i, n: " ".join(f"v{i}x{k}" for k in range(n))
    rows = [(i, "COMMON  line " + "again here " * 30 + "\n" + body(i, 20 if i < 5 else 200), "h" if i % 2 else None) for i in range(60)]
    got = Counter(tuple(r)[0:1] + (r.kept,) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_broadcast=most).collect())
    assert got == Counter((r[0], r[-1]) for r in brute_kept([(d, t, s) for d, t, s in rows]).elements())
    assert any(not k for _, k in got) and any(k for _, k in got)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    text = text or ""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def check_spans(rows, got):
    expected = Counter()
    for d, t in rows:
        s = brute_spans(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in s)
        expected[(d, *(sum(x[2] == k for x in s) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == expected


def test_pii_base_spans(spark, docs, odd, empty):
    check_spans([(d, t) for d, t, *_ in docs], registry.op5_disclosure(spark, SF).collect())
    check_spans([(r[0], r[1]) for r in odd_rows()], pii.scrub(odd).collect())
    assert pii.scrub(empty).count() == 0
    for t in ("a@@b.c", "x@y.z@w.v", "@a.b", "a.b@c", "a@b..c", "a@b.c.", "ü@x.y", "+1 (234) 555-1234 4111-1111-1111-1111 1.2.3.4.5 999.1.1.1"):
        assert [(a, b, pii.KINDS.index(k)) for a, b, k in pii.base_spans(t)] == brute_spans(t), t


@pytest.mark.parametrize("most", [0, 1000])
def test_pii_terms_that_reveal_an_entity(spark, most):
    filler = ["red sky over hills", "cold rain at noon", "green field near town", "old road by river", "new bridge of stone"]
    rows = [(i, f"Yesterday {filler[i]} spoke Zorbanel about zoe@mail.example.com while {filler[-i]} went") for i in range(5)]
    rows += [(10 + i, f"plain text {filler[i % 5]} about while spoke yesterday went number {i}") for i in range(40)]
    got = {r.doc_id: r for r in pii.scrub(spark.createDataFrame(rows, "doc_id long, text string"), most_pairs=most).collect()}
    text = rows[1][1]
    at = text.index("Zorbanel")
    assert f"term:{at}:{at + 8}" in got[1].spans and f"email:{text.index('zoe@')}" in got[1].spans
    assert "Zorbanel" not in got[1].clean and "zoe@" not in got[1].clean and "<EMAIL>" in got[1].clean and "about" in got[1].clean
    assert all(got[10 + i].spans == "" and got[10 + i].clean == rows[5 + i][1] for i in range(40))


@pytest.mark.parametrize("most", [0, 1000])
def test_pii_terms_far_from_the_entity_repeated_or_in_a_template(spark, most):
    far = "plain text about red sky over hills and cold rain at noon while old road went"
    fill = lambda i: f"sample {chr(97 + i) * 4}"
    rows = [(i, f"Zorbanel {fill(i)} {far} zoe@mail.example.com {far} then Zorbanel or Li {far}") for i in range(5)]
    rows += [(10 + i, f"{fill(i)} {far}. Write to Quentavo, q@corp.example.org, about it. {far}") for i in range(5)]
    rows += [(20 + i, f"{far} {fill(i % 9)} then write to it or Corp about sample number {i}") for i in range(40)]
    rows += [(70 + i, f"Trivex t@copy.example.net {far}") for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.scrub(frame, most_pairs=most).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame, most_pairs=most).collect()}
    for i, text in rows:
        terms = [s for s in got[i].spans.split(",") if s.startswith("term")]
        names = {0: "Zorbanel|Li", 1: "Quentavo"}.get(i // 10, "(?!)")
        assert terms == [f"term:{m.start()}:{m.end()}" for m in re.finditer(rf"\b(?:{names})\b", text)], i
        assert clean[i] == got[i].clean and not re.search(rf"\b(?:{names})\b", clean[i])


def brute_hits(rows, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wanted = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - size + 1) if len(w) >= size else range(bool(w)):
            wanted[tuple(w[k : k + size])].add(i)
    sizes = {len(k) for k in wanted}
    out = Counter()
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := wanted.get(tuple(w[i : i + n]))) is not None:
                    found |= own
                    hit.update(range(i, i + n))
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination_matches_brute_force(spark, docs, odd, empty):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = brute_hits([(d, t) for d, t, *_ in docs], items)
    assert Counter(tuple(r) for r in registry.op7_decontamination(spark, SF).collect()) == expected
    assert sum(k[-1] * v for k, v in expected.items()) > 0
    few = [(1, "Two, three!"), (2, None), (3, ""), (2, "lambda mu alpha beta gamma delta epsilon zeta eta theta iota"), (7, "日本語 テキスト É")]
    bench = spark.createDataFrame(few, "item_id long, text string")
    brute = brute_hits([(r[0], r[1]) for r in odd_rows()], few)
    for most in (40, 1000):
        got = decontam.contamination(odd, bench, most_item_bytes=most)
        assert Counter(tuple(r)[:6] for r in got.collect()) == brute
    span = next(r for r in decontam.contamination(odd, bench).collect() if r.doc_id == 12)
    assert [odd_rows()[12][1][s.start : s.end] for s in span.spans] == ["日本語 テキスト é"][: len(span.spans)]
    upper = spark.createDataFrame([(1, "Éa LAMBDA Mu, alpha; Beta GAMMA delta epsilon zeta eta theta IOTA. End")], "doc_id long, text string")
    one = decontam.contamination(upper, bench).first()
    assert [upper.first().text[s.start : s.end] for s in one.spans] == ["LAMBDA Mu, alpha; Beta GAMMA delta epsilon zeta eta theta IOTA"]
    assert decontam.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(odd, bench.where("false")).collect())


def test_decontamination_by_many_small_automata(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:40]
    items.append((999, " ".join(t for _, t in items[:30])))
    rows = [(d, t) for d, t, *_ in docs]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(frame, bench, most_item_bytes=2500)
    expected = brute_hits(rows, items)
    assert Counter(tuple(r)[:6] for r in got.collect()) == expected
    kept = decontam.uncontaminated(frame, bench, most_item_bytes=2500)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in expected.elements() if not k[-1])


def test_memory_of_an_automaton_follows_its_limit():
    import subprocess
    import sys

    code = """
import random, sys
from quarryline.llm import decontam
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(20000)]
items = tuple((i, " ".join(rng.choices(words, k=60))) for i in range(100_000_000) if i < decontam.MOST_ITEM_BYTES // 390)
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
before = rss()
decontam.automaton(items, 10)
print(sum(len(t) for _, t in items), rss() - before)
""".replace("range(100_000_000) if i < decontam.MOST_ITEM_BYTES // 390", "range(decontam.MOST_ITEM_BYTES // 390)")
    text, used = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert text > 0.8 * decontam.MOST_ITEM_BYTES and used < 250e6


def test_language_id_accuracy_and_odd_rows(spark, docs, odd, empty):
    lang = {d: x for d, _, x, _ in docs}
    rows = registry.op8_language_id(spark, SF).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.9 * len(own)
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows()) and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.identify(empty).count() == 0


RULES = [(v, h, p) for v, h, p in registry.URL_RULES] + [("allow", "a.com", "/"), ("block", "www.a.com", "/x"), ("allow", "com", "/")]


def brute_url(url):
    i = (url or "").find("://")
    rest = url[i + 3 :] if url and i >= 0 else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = m.group(1).translate(LOWER), m.group(2)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{v} {h}{p}" for v, h, p in registry.URL_RULES] == contract.split(", ")
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/1", "http://www.example.net/de/8", "http://example.net/de/7", "http://b.org/es/", "http://b.org/de/"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    says = [(r.rule, r.verdict) for r in registry.op9_url_rules(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert says == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]


@pytest.mark.parametrize("most", [0, 1000])
def test_url_rules_match_brute_force(spark, most):
    urls = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://", "http://COM/en/", "x://a.com", "http://a.com?x=/en/", "http://www.a.com/xyz#/", "http://acom/en/", "http://.com/en/7", "http://b.a.com./", "http://example.com/en/71", "http://www.example.com/en/6", "http://a..com/q", "http://é.com/en/é"] * 2
    rows = [(i % 40, u, "h", "p") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = Counter(tuple(r) for r in urlrules.judge_urls(pages, rules, most_sent=most).collect())
    assert got == Counter((i, *brute_url(u)) for i, u, *_ in rows)
    assert urlrules.judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urlrules.judge_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_many_url_rules_are_swept_by_range(spark):
    import random

    rng = random.Random(2)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    hosts = [name() for _ in range(300)] + ["a.b.c"] * 400
    pages = [(i, f"http://{h}/{rng.choice('xyz')}{i % 7}") for i, h in enumerate(hosts)]
    rules = [(rng.choice(["block", "allow"]), name(), rng.choice(["/", "/x", "/y1", "/z"])) for _ in range(250)]
    best = {}
    for v, h, p in rules:
        best[h, p] = "block" if "block" in (v, best.get((h, p))) else v
    expected = Counter()
    for i, url in pages:
        host, path = url[7:].split("/", 1)
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        top = max(fit, default=None)
        expected[i, host, "/" + path, top and top[2], top[3] if top else "allow"] += 1
    frame = spark.createDataFrame(pages, "page_id long, url string").repartition(8)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for most in (10, 1000):
        assert Counter(map(tuple, urlrules.judge_urls(frame, table, most_sent=most).collect())) == expected


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 997])
def test_feistel_is_a_permutation(n):
    places = [sharding.place_of(i, n, 3) for i in range(n)]
    assert sorted(places) == list(range(n)) and [sharding.row_at(p, n, 3) for p in places] == list(range(n))


def test_sharding_law_and_places(spark, docs, odd, empty):
    for frame, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), [(d, t) for d, t, *_ in docs]), (odd, [(r[0], r[1]) for r in odd_rows()])):
        got = sharding.shard_rows(frame, seed=9).collect()
        raw = lambda t: (t or "").encode()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(raw(t)) + 8, zlib.crc32(raw(t))) for d, t in rows)
        counts = Counter(r.shard for r in got)
        assert max(counts[s] for s in range(24)) - min(counts[s] for s in range(24)) <= 1
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(24))
        assert all(r.slot * 24 + r.shard == sharding.place_of(r.row, len(rows), 9) for r in got)
        assert [r.doc_id for r in sorted(got, key=lambda r: r.row)] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert sharding.shard_rows(empty).count() == 0


def base_of(text):
    return text.split("\n", 1)[1]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, expected = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


CLASHING = ["key", "found", "row", "hash", "host", "lines", "v_id", "v_hash", "v_host", "_text", "_key", "entity", "term", "n", "line", "own_hash", "_kept", "node", "label", "a.b"]


@pytest.mark.parametrize("most", [0, 1000])
def test_columns_of_any_name_pass_through(spark, most):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"Common line\n{body} {i} Zorbanel writes zoe@mail.example.com" if i < 40 else f"Common line\n{body} number {i}", "en", "s", i) + tuple(f"{c}{i}" for c in CLASHING) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for out in (quality.cleaned(frame, most_broadcast=most), pii.sanitise(frame, most_pairs=most)):
        assert out.columns == frame.columns
        got = out.collect()
        assert len(got) == 50 and all(tuple(r)[5:] == rows[r.doc_id][5:] for r in got)
        assert all(r.n_chars == len(r.text) for r in got if r.text != rows[r.doc_id][1])
    assert not any("zoe@" in r.text for r in got) and not any("Common" in r.text for r in quality.cleaned(frame, most_broadcast=most).collect())
    for out in (minhash.one_of_each(frame), decontam.uncontaminated(frame, spark.createDataFrame([(1, "zz")], "item_id long, text string"))):
        assert out.columns == frame.columns and all(tuple(r) == rows[r.doc_id] for r in out.collect())


def test_pii_very_long_runs_of_digits_and_dots():
    import time

    began = time.perf_counter()
    for text in ("1" * 1_000_000, "1" * 5000 + ".1.1.1", "1.2." * 250_000, "0" * 5000 + "1.2.3.4", "1 " * 500_000, "+1" + "(" * 1_000_000, "a" * 1_000_000 + "@", "@" * 1_000_000):
        spans = pii.base_spans(text)
        if len(text) < 10_000:
            assert [(a, b, pii.KINDS.index(k)) for a, b, k in spans] == brute_spans(text)
    assert time.perf_counter() - began < 60
    for t in ("1.2.3.4.5.6.7.8.9", "256.1.1.1.2.3.4.5", "001.02.3.0255", "1..2.3.4.5", ".1.2.3.4.", "1.2.3", "1.2.3.4a5.6.7.8"):
        assert [(a, b) for a, b in pii.addresses(t)] == [(a, b) for a, b, k in brute_spans(t) if k == 1], t


def test_pii_words_are_those_of_the_pattern(docs):
    texts = [t for _, t, *_ in docs if t] + ["".join(map(chr, range(1, 700))), "ÀB²½_c1d µß ÿŸ Straße\u00a0x\u2009y", "日本 İI", ""]
    texts += [" ".join(f"a{chr(c)}b" for c in range(1, 256))]
    for t in texts:
        assert pii.words_of(t) == {w.lower() for w in re.findall(r"[^\W\d_]+", t)}


def brute_terms(rows, least=3, remove=0.9, generalise=0.75):
    """Classes of judged terms by entity, and the strengths, from whole documents."""
    import math

    words = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]+", t or "")}
    n = len(rows)
    of_entity, of_term, both, texts, of_class = Counter(), Counter(), Counter(), defaultdict(set), Counter()
    for _, t in rows:
        own = words(t)
        entities = {(k, t[a:b].lower()) for a, b, k in brute_spans(t)}
        of_term.update(own)
        of_class.update({w[:i] for w in own for i in range(1, min(len(w), 9))})
        of_entity.update(entities)
        for e in entities:
            for w in own:
                both[e, w] += 1
                texts[e, w].add(t)
    out = defaultdict(dict)
    for (e, w), k in both.items():
        if len(texts[e, w]) >= least and of_entity[e] < n:
            ic = math.log(n / of_entity[e])
            s = math.log(k * n / (of_term[w] * of_entity[e])) / ic
            if s >= generalise:
                fit = [w[:i] for i in range(1, min(len(w), 9)) if math.log(n / of_class[w[:i]]) < generalise * ic]
                out[e][w] = (s, max(fit, key=len) if fit and s < remove else "")
    return out


def brute_term_spans(text, strong):
    base = brute_spans(text)
    terms = {}
    for a, b, k in base:
        for w, (_, c) in strong.get((k, text[a:b].lower()), {}).items():
            terms[w] = min(c, terms.get(w, c), key=len)
    free = [(m.start(), m.end(), terms[m.group().lower()]) for m in re.finditer(r"[^\W\d_]+", text or "") if m.group().lower() in terms]
    return [x for x in free if not any(a < x[1] and x[0] < b for a, b, _ in base)]


@pytest.mark.parametrize("most", [0, 100_000])
def test_pii_terms_match_brute_force(spark, docs, most):
    weak = ["Marbleton", "Marbury", "Marsden", "Zorbanel"]
    made = [(5000 + i, f"report {chr(97 + i % 26) * 3} of {weak[i % 4]} to Quellford at q@corp.example.org with filler {chr(97 + i % 7) * 4}") for i in range(16)]
    made += [(6000 + i, f"margin market {'Quellford' if i < 8 else 'quiet'} item {chr(97 + i % 23) * 5}") for i in range(60)]
    rows = [(d, t) for d, t, *_ in docs] + made
    strong = brute_terms(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.entity, r.term): (r.strength, r["class"]) for r in pii.disclosures(frame, most_pairs=max(most, 1)).collect()}
    expected = {(pii.entity_hash(pii.KINDS[e[0]], e[1]), pii.term_hash(w)): v for e, own in strong.items() for w, v in own.items()}
    assert got.keys() == expected.keys() and all(abs(got[k][0] - v[0]) < 1e-9 and got[k][1] == v[1] for k, v in expected.items())
    assert any(v[1] for v in expected.values())
    for r in pii.scrub(frame, most_pairs=most).collect():
        text = dict(rows)[r.doc_id]
        own = brute_term_spans(text, strong)
        assert [s for s in r.spans.split(",") if s.startswith("term")] == [f"term:{a}:{b}" for a, b, _ in own]
        assert all(not c or f"<{c}*>" in r.clean for *_, c in own)


def test_pii_counts_of_wanted_names_are_a_few_rows_of_each_task(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(5000)]
    rows = [(t, " ".join(words[t % 7 :: 1 + t % 3])) for t in range(40)]
    frame = spark.createDataFrame(rows, "h long, text string").repartition(4)
    sets = [set(t.split()) for _, t in rows]
    terms = sorted(map(pii.term_hash, words))
    counts = frame.mapInArrow(pii._term_counts(terms), "first long, counts array<long>")
    assert counts.count() == 4 * 2  # not tasks times terms
    got = {r.term: r.n_t for r in pii._summed(counts, terms, "term", "long", "n_t").collect()}
    assert got == {pii.term_hash(w): n for w in words if (n := sum(w in own for own in sets))}
    classes = sorted({w[:k] for w in words for k in (1, 2, 3)} - {"a"}) + ["zzzz"]
    begun = [{w[:k] for w in own for k in (1, 2)} for own in sets]
    counts = frame.mapInArrow(pii._class_counts(classes), "first long, counts array<long>")
    assert counts.count() <= 4 * 2
    got = {r["class"]: r.n_c for r in pii._summed(counts, classes, "class", "string", "n_c").collect()}
    assert got == {c: n for c in classes if (n := sum(c in own for own in begun))}


def test_tasks_take_few_texts_at_once(spark):
    texts = [None if i % 9 == 0 else f"t{i}" for i in range(1203)]
    parts = list(_common.few_rows(iter([pa.RecordBatch.from_pydict({"text": texts}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})])))
    assert max(b.num_rows for b in parts) <= 500 and [t for b in parts for t in b.column("text").to_pylist()] == texts
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    finish = lambda rows, own, spans: pa.RecordBatch.from_arrays([pa.array([len(own)] * len(own), pa.int64())], ["n"])
    sizes = [r.n for r in pii._searched(frame.select(F.col("doc_id").alias("row"), "text"), 3, 10, finish, "n long").collect()]
    assert len(sizes) == len(texts) and max(sizes) <= 500


def test_pii_words_next_to_an_entity_are_never_cut(spark):
    rows = [(i, f"filler{chr(97 + i)} " + "q" * 900 + f" zoe@mail.example.com tail{chr(97 + i)}") for i in range(4)] + [(9 + i, f"plain words number {i}") for i in range(9)]
    got = {r.doc_id: r for r in pii.scrub(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:8:908" in got[0].spans
