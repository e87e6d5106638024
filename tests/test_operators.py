"""Operators against short plain statements of their rules, on small and random tables."""

from __future__ import annotations

import hashlib
import hmac
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import arrays, ids, names, text, urls
from quarryline.operators import caps, dedup, facets, graph, images, importing, journal, lookups, ordering, reports, splitting
from quarryline.plans import catalogue
from quarryline.sources import records
from quarryline.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    held = [(i, [f"k{rng.randrange(60)}" for _ in range(rng.randrange(3))]) for i in range(80)]
    up = list(range(80))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in held:
        for j, b in held:
            if set(a) & set(b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    got = graph.linked_rows(spark.createDataFrame(held, "row long, keys array<string>").repartition(3), "row", "keys")
    assert rows(got) == sorted(((i, root(i)) for i in range(80)), key=repr)


def test_components_of_all_customers_match_union_find(spark):
    sf = "/root/testdata/sf0.01"
    up, first = {}, {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in spark.read.parquet(f"{sf}/customer.parquet").orderBy("c_custkey").collect():
        i = up[r.c_custkey] = r.c_custkey
        for key in (("n", r.c_nationkey, i // 40), ("s", r.c_mktsegment, i // 25)):
            x, y = root(first.setdefault(key, i)), root(i)
            up[max(x, y)] = min(x, y)
    got = rows(catalogue.queries()["components_whole"](spark, sf))
    assert got == sorted(((i, root(i)) for i in up), key=repr) and len(got) == 1500


def test_long_chain_and_empty_graph(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(chain).select("label").distinct().collect()[0][0] == 0
    assert graph.components(chain.where("false")).count() == 0


def test_names_equal_hmac(spark):
    for salt in ("s", "x" * 70):
        got = spark.createDataFrame([("a\nb",), ("ü",)], "p string").select("p", graph.hashed_name(F.col("p"), salt)).collect()
        assert all(h == hmac.new(salt.encode(), p.encode(), hashlib.sha256).hexdigest() for p, h in got)


def test_greedy_keeps_a_row_near_only_to_dropped_rows(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    order = spark.createDataFrame([(i, i) for i in range(1, 7)], "row long, position long")
    assert rows(dedup.greedy_drop(pairs, order)) == [(2, 1), (6, 5)]


def plain_greedy(data):
    kept, out = [], []
    for p, i, x, h in sorted((p, i, x, h) for i, x, h, p in data):
        near = next((j for j, y, g in kept if x == y and ((h ^ g) & (2**64 - 1)).bit_count() <= 2), None)
        if near is None:
            kept.append((i, x, h))
        else:
            out.append((i, near))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_greedy_over_hashes_matches_a_walk_and_pairs_no_copies(spark, seed):
    rng = random.Random(seed)
    base, data = [rng.getrandbits(64) for _ in range(4)], []
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.randrange(6)):
            h ^= 1 << rng.randrange(0, 64, 7)
        data.append((i, rng.choice(["a", "b", None]), h - (1 << 64) if h >> 63 else h, rng.randrange(1000)))
    rows_of = lambda d: spark.createDataFrame(d, "row long, bucket string, h long, at long")
    assert rows(dedup.greedy_drop_hashes(rows_of(data), "row", ["bucket"], "h", "at")) == sorted(plain_greedy([(i, x or "", h, p) for i, x, h, p in data]), key=repr)
    copies = spark.range(20_000).select("id", F.lit("a").alias("bucket"), F.lit(7).cast("long").alias("h"))
    assert dedup.greedy_drop_hashes(copies, "id", ["bucket"], "h", "id").groupBy("near").count().collect() == [(0, 19_999)]


def plain_simhash(text):
    words = re.findall(r"\w+", text.lower())
    codes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words]
    h = sum(1 << i for i in range(64) if 2 * sum(c >> i & 1 for c in codes) > len(codes))
    return (h - (1 << 64) if h >> 63 else h) if words else None


def plain_classes(hashes, n):
    """(row, class, links) of rows 0..n-1 from (row, bucket, hash, place)."""
    own = {i: (x, h) for i, x, h, _ in hashes}
    out = []
    for i in range(n):
        same = [j for j in own if i in own and own[j] == own[i]]
        near = [j for j in own if i in own and j != i and own[j][0] == own[i][0] and ((own[i][1] ^ own[j][1]) & (2**64 - 1)).bit_count() <= 2]
        out.append((i, min(same, default=i), len(near)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_near_classes_count_all_links_without_pairs(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(5)]
    data = []
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.choice([0, 5, 40])
        data.append((i, rng.choice("ab"), None if i % 17 == 0 else h, 0))
    got = dedup.near_classes(spark.createDataFrame([d[:3] for d in data], "row long, bucket string, h long"), "row", ["bucket"], "h")
    assert sorted(map(tuple, got.collect())) == plain_classes([d for d in data if d[2] is not None], 150)
    copies = spark.range(20_000).select("id", F.lit("a").alias("bucket"), F.lit(7).cast("long").alias("h"))
    assert dedup.near_classes(copies, "id", ["bucket"], "h").groupBy("class", "links").count().collect() == [(0, 19_999, 20_000)]


def test_running_sums_over_a_large_group(spark):
    data = [(1 if i % 10 else 2, i * 7919 % 5003, i % 5) for i in range(5000)]
    got = ordering.running_sums(spark.createDataFrame(data, "g long, at long, n long").repartition(6), ["g"], {"before": "n"}, "at")
    expected, have = [], {1: 0, 2: 0}
    for g, at, n in sorted(data, key=lambda d: (d[0], d[1])):
        expected.append((g, at, n, have[g]))
        have[g] += n
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_replacement_is_all_or_nothing(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    records.replace_all(spark, [(spark.range(1), a), (spark.range(2), b)])
    with pytest.raises(Exception):
        records.replace_all(spark, [(spark.range(5), a), (spark.range(9).select(F.raise_error(F.lit("no")).alias("x")), b)])
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (1, 2)
    records.replace_all(spark, [(spark.range(7), a), (spark.range(8), b)])
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (7, 8)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    with pytest.raises(ValueError):
        records.write_if_clean(spark.range(1), [(spark.range(5), a)])
    assert not (tmp_path / "a").exists()


def test_photo_files(spark):
    paths = ["/x/a.csv", "/x/a_v2.csv", "/x/_skip.csv", "/x/b_meta.csv", "/x/sum_grupa_toksyczna.csv", "/x/df20/c.csv", "/x/d_niezweryfikowane.csv", "/x/e_by_nc.csv", "/x/f.txt"]
    got = records.photo_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    photos = [(r.path, r.unverified) for r in sorted(got.where("NOT meta").collect(), key=lambda r: r.order)]
    assert photos == [("/x/a_v2.csv", False), ("/x/e_by_nc.csv", False), ("/x/df20/c.csv", False), ("/x/d_niezweryfikowane.csv", True)]
    assert rows(got.where("meta").select("path")) == [("/x/b_meta.csv",)]


def test_credits_are_https_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", "https://x", ""), ("b", "https://y", None)], "name string, image string, licence string")
    records.write_credits(df, str(tmp_path / "credits"), ["name", "image", "licence"], ["image", "licence"])
    assert spark.read.parquet(str(tmp_path / "credits")).count() == 2
    with pytest.raises(ValueError):
        records.write_credits(df.withColumn("licence", F.lit("http://z")), str(tmp_path / "credits"), ["name", "image", "licence"], ["image", "licence"])


def test_winners_with_chains_of_keys(spark):
    data = [(1, ["p", "q"], "x", 1), (2, ["q", "r"], "x", 3), (3, ["r"], "x", 2), (4, ["s", "t"], "x", 1), (5, ["t", "u"], "y", 1), (6, ["v"], "x", 1), (7, [], "x", 1)]
    got = importing.winners(spark.createDataFrame(data, "row long, keys array<string>, label string, rank int"), "row", "keys", "label", "rank")
    assert rows(got) == [(1, "duplicate"), (2, "kept"), (3, "duplicate"), (4, "conflict"), (5, "conflict"), (6, "kept"), (7, "kept")]


def test_duplicates_look_at_the_whole_text(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    bodies = [" ".join(word() for _ in range(300)) for _ in range(4)]
    texts = ["Common heading " + b for b in bodies] + ["Other heading " + bodies[0], "Common heading " + bodies[1], "", "  "]
    data = [(i, x, "en", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path))
    assert rows(run("exact_dedup_whole_text").select("doc_id")) == [(0,), (1,), (2,), (3,), (4,), (6,), (7,)]
    hashes = [(i, x, h, (-n, i)) for i, t, x, n in data if (h := plain_simhash(t)) is not None]
    assert rows(run("near_dup_pairs_whole_text")) == plain_classes(hashes, len(data))
    assert dict((r[0], r[1]) for r in plain_classes(hashes, len(data)))[5] in (1, 5) and any(r[2] for r in plain_classes(hashes, len(data)))
    assert rows(run("near_dup_greedy")) == sorted(plain_greedy(hashes), key=repr)


def test_image_hashes_match_plain_loops(spark):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (32, 32)).astype(float)
    got = spark.createDataFrame([(1, grey.ravel().tolist())], "row long, grey array<double>").mapInPandas(dedup.hash_bits, "row long, average long, difference long, perceptual long").first()
    dct = [[sum(grey[y, x] * math.cos(math.pi / 32 * (y + 0.5) * u) * math.cos(math.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = [v for r in dct for v in r]
    bits = int("".join("1" if v > sorted(flat)[31] else "0" for v in flat), 2)
    assert got.perceptual & (2**64 - 1) == bits


def plain_cap(pool, cap):
    groups = []
    for at, label in pool:
        if not groups or groups[-1][0] != label:
            groups.append((label, []))
        groups[-1][1].append(at)
    kept, room = [], cap
    for i, (_, g) in enumerate(groups):
        if room < 1:
            break
        if len(g) <= room:
            kept += g
            room -= len(g)
        elif i == 0:
            kept += g[:cap]
            room = 0
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_whole_islands_match_a_walk(spark, seed):
    rng = random.Random(seed)
    data = [(p, i, rng.choice("xyz")) for p in range(6) for i in range(rng.randrange(1, 40))]
    got = caps.whole_islands(spark.createDataFrame(data, "pool long, at long, label string"), ["pool"], "label", "at", 5)
    expected = [(p, a) for p in range(6) for a in plain_cap([(a, s) for q, a, s in data if q == p], 5)]
    assert rows(got.select("pool", "at")) == sorted(expected, key=repr)


def plain_quota(items, cap, per, ask):
    left, plan = cap, {i: 0 for i, _ in items}
    first, rest = [i for i, p in items if p], [i for i, p in items if not p]
    for i in first:
        plan[i] = max(0, min(per, ask, left))
        left -= plan[i]
    if rest and left > 0:
        each = max(1, min(per, left // len(rest)))
        for i in rest:
            plan[i] = min(each, left)
            left -= plan[i]
        for i in rest:
            more = min(per - plan[i], left)
            plan[i] += more
            left -= more
    return plan


@pytest.mark.parametrize("cap, per, ask", [(10, 3, 2), (100, 7, 50), (3, 9, 2), (25, 4, 9), (1, 1, 1)])
def test_quotas_match_a_loop(spark, cap, per, ask):
    items = [(i, i % 4 == 1) for i in range(9)]
    got = caps.quotas(spark.createDataFrame([("g", *x) for x in items], "g string, i long, p boolean"), ["g"], "i", "p", cap, per, ask)
    assert {r.i: r.quota for r in got.collect()} == plain_quota(items, cap, per, ask)


def test_exact_split_keeps_components_whole(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), f"c{rng.randrange(30)}") for i in range(300)]
    df = spark.createDataFrame(data, "row long, label string, component string")
    got = splitting.split_components(df, "label", "component", F.col("component") == "c3")
    assert splitting.broken(got, "component").count() == 0 and got.where("split IS NULL").count() == 0
    assert got.where("component = 'c3' AND split = 'test'").count() == 0
    share = {r.split: r["count"] / 300 for r in got.groupBy("split").count().collect()}
    assert share["test"] > 0.08 and share["val"] > 0.05
    again = splitting.split_components(df.repartition(7), "label", "component", F.col("component") == "c3")
    assert rows(again.select("row", "split")) == rows(got.select("row", "split"))
    few = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, None)], "row long, label string, component string")
    assert {r.split for r in splitting.split_components(few, "label", "component", F.lit(None).cast("boolean")).collect()} == {"train"}
    kept, moved = splitting.held_out_of_place(got, F.col("component") == "c3")
    assert kept.count() + moved.count() == 300 and moved.where("component <> 'c3'").count() == 0


def test_bootstrap_equals_numpy(spark):
    import zlib

    got = reports.bootstrap(spark.createDataFrame([("q", 3, 10), ("z", 0, 5)], "name string, s long, n long"), "s", "n", "name").collect()
    for r in got:
        rates = np.random.default_rng(zlib.crc32(r.name.encode())).binomial(r.n, r.s / r.n, size=1000) / r.n
        assert (r.lower, r.upper) == (np.quantile(rates, 0.05), np.quantile(rates, 0.95))


def test_wilson_and_digest(spark):
    low, high = arrays.wilson(F.col("s"), F.col("n"))
    got = spark.createDataFrame([(8, 10), (0, 5), (5, 5), (0, 0)], "s long, n long").select(low, high).collect()
    assert [tuple(round(x, 6) if x is not None else None for x in r) for r in got] == [(0.490162, 0.943318), (0.0, 0.434482), (0.565518, 1.0), (None, None)]
    a = spark.createDataFrame([("x", i % 5) for i in range(50)], "k string, v long")
    assert rows(reports.content_digest(a, F.col("v").cast("string"), "k")) == rows(reports.content_digest(a.repartition(7), F.col("v").cast("string"), "k"))
    with pytest.raises(ValueError):
        reports.largest_share(a, "k", "v", 0.5)


def test_threshold_is_the_ceiling_order_statistic(spark):
    for n in (7, 8, 33, 100, 101):
        values = [((i * 37) % n) / 3 for i in range(n)]
        k = min(n, max(1, math.ceil(0.97 * n - 1e-9)))
        got = reports.keep_threshold(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().threshold
        assert got == (sorted(values)[k - 1] if n >= 8 else None)


def test_urls_and_ids(spark):
    cases = [
        ("http://User:pw@EXAMPLE.com:80/a?b#c", "https://User:pw@example.com/a?b#c"), ("HTTPS://A.com/x", "https://A.com/x"),
        ("http://a.com:8080/", "https://a.com:8080/"), ("//a.com/x", "https://a.com/x"), ("ftp://a.com", "ftp://a.com"),
        ("http://a.com:99999/", "http://a.com:99999/"), ("http://[::1]:443/x", "https://[::1]/x"), (" http://a.com? ", "https://a.com"), ("nothing", "nothing"),
    ]
    got = spark.createDataFrame([(u,) for u, _ in cases], "u string").select("u", urls.force_https(F.col("u"))).collect()
    assert [r[1] for r in got] == [e for _, e in cases]
    got = spark.createDataFrame([("HTTP://A.com/Q/?x",), ("http://a.com/",), ("x/",)], "u string").select(urls.canonical_url(F.col("u")), urls.canonical_image_url(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("http://a.com/Q", "https://a.com/Q"), ("http://a.com", "https://a.com/"), ("x", "x/")]
    got = spark.createDataFrame([(12.0,), (1.5,), (float("nan"),), (float("inf"),)], "v double").select(ids.id_of_number(F.col("v"))).collect()
    assert [r[0] for r in got] == ["12", None, None, None]
    assert spark.createDataFrame([("Łódź ÉTÉ",)], "t string").select(text.search_key(F.col("t"))).first()[0] == "lodz ete"


def test_decide_follows_the_order_of_rules(spark):
    gate = {"energy_threshold": 0.0, "floor": 0.5, "high": 0.9, "margin": 0.2, "background": "bg", "unknown": "un", "dangerous": ["g"]}
    names = ["a", "b", "bg", "un"]
    cases = [
        ([9.0, 1.0, 0.0, 0.0], "candidates", ""), ([0.0, 0.0, 9.0, 0.0], "rejected", "not_a_species"), ([-9.0, -9.5, -9.5, -9.9], "rejected", "not_a_species"),
        ([0.0, 0.0, 0.0, 9.0], "rejected", "unknown_species"), ([5.0, 5.0, 0.0, 5.1], "rejected", "unclear"), ([float("nan"), 0.0, 0.0, 0.0], "unavailable", "output_mismatch"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "l array<double>").coalesce(1)
    got = df.select(arrays.decide(F.col("l"), names, {"a": "g"}, gate).alias("d")).select("d.*").collect()
    assert [(r.status, r.reason) for r in got] == [c[1:] for c in cases]
    assert got[0].top3 == ["a", "b"] and got[0].dangerous and not got[0].low_confidence
    open_gate = df.select(arrays.decide(F.col("l"), names, {}, {**gate, "energy_threshold": None})["reason"]).first()[0]
    assert open_gate == "gate_not_calibrated"
    assert spark.createDataFrame([([1.0, 2.0, 2.0],)], "l array<double>").select(arrays.ranking(F.col("l"))).first()[0] == [1, 2, 0]


def test_facets_hold_unknown_values(spark):
    df = spark.createDataFrame([(1, ["x"], False), (2, ["y"], False), (3, None, False), (4, [], False), (5, ["y"], True)], "i long, v array<string>, h boolean")
    got = facets.filtered(df, [facets.facet(F.col("v"), ["x"], F.col("h"))])
    assert rows(got.select("i", "outcome")) == [(1, "match"), (3, "unverified"), (4, "unverified"), (5, "unverified")]
    assert facets.filtered(df, []).count() == 5


def test_lookups(spark):
    base = spark.createDataFrame([(1, ""), (2, "own"), (3, None)], "k long, v string")
    meta = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "k long, v string, o long")
    assert rows(lookups.fill_from_first(base, "k", meta, ["v"], "o")) == [(1, "a", True), (2, "own", True), (3, None, False)]
    assert rows(lookups.all_agree(spark.createDataFrame([("h", True), ("h", None), ("g", True)], "k string, b boolean"), "k", F.col("b"))) == [("g", 1)]
    tainted = spark.createDataFrame([("p", True), ("p", False), (None, False), ("q", None)], "k string, bad boolean")
    assert rows(lookups.without_tainted(tainted, "k", F.col("bad"))) == [("q", None), (None, False)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿name,x\n" A ""q""",1,extra\n\nb,\n', encoding="utf-8")
    assert rows(records.read_csv(spark, str(tmp_path / "a.csv"), ["name", "x", "y"])) == [('A "q"', "1", ""), ("b", "", "")]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "é"}\n', encoding="utf-8")
    df = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long, b string")
    assert rows(df) == [(1, None), (2, "é")]
    records.write_jsonl(df, str(tmp_path / "out"), F.desc("a"))
    assert [r.a for r in records.read_jsonl(spark, str(tmp_path / "out"), "a long").coalesce(1).collect()] == [2, 1]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    good, bad = records.read_jsonl_lenient(spark, str(tmp_path / "bad.jsonl"), "a long")
    assert rows(good) == [(1,)] and rows(bad) == [("not json",)]
    with pytest.raises(ValueError):
        records.write_if_clean(df, [(df, str(tmp_path / "never"))])
    assert not (tmp_path / "never").exists()
    records.write_if_clean(df.where("false"), [(df, str(tmp_path / "now"))])
    assert spark.read.parquet(str(tmp_path / "now")).count() == 2


def test_journal_keeps_protected_rows(spark):
    df = spark.createDataFrame([("u", i) for i in range(12)], "g string, i long")
    got = journal.newest(df, ["g"], 3, F.col("i") == 0, F.desc("i"))
    assert rows(got.select("i")) == [(0,), (10,), (11,)]
    assert rows(journal.upsert(df.where("i < 2"), spark.createDataFrame([("n", 1), ("z", None)], "g string, i long"), "i").select("g", "i")) == [("n", 1), ("u", 0)]


def test_streams(spark, tmp_path):
    data = [(i % 7, i, i % 3 == 0) for i in range(60)]
    spark.createDataFrame(data, "k long, s long, bad boolean").select("k", F.timestamp_seconds("s").alias("ts"), "bad").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("k long, ts timestamp, bad boolean").parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("firsts", events.first_of_key(read(), "k", "ts", "1 hour"), "append", 7), ("shares", events.unsafe_share(read(), "ts", "bad", "30 seconds", "1 hour"), "complete", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
    assert spark.table("shares").agg(F.sum("attempts")).first()[0] == 60


def test_loads_with_checks(spark, tmp_path):
    lines = spark.createDataFrame([('{"photo_url": " u ", "author": ""}',), ('{"photoUrl": "v", "author": "a", "creator": "b"}',), ("  ",)], "line string")
    assert rows(records.credits_of(lines, {"url": ["photo_url", "photoUrl"], "who": ["author", "creator"]})) == [("u", ""), ("v", "a")]
    good = spark.createDataFrame([("https://www.inaturalist.org/observations/5",), ("https://x.org/photos/7/a.jpg?b",)], "url string")
    keys = set(map(tuple, records.reference_keys([good, good], "url").collect()))
    assert {("inat_observation", "5"), ("inat_photo", "7"), ("image", "https://x.org/photos/7/a.jpg")} <= keys
    with pytest.raises(ValueError):
        records.reference_keys([good, spark.createDataFrame([("http://x.org",)], "url string")], "url")
    with pytest.raises(ValueError):
        records.reference_keys([], "url")
    dim = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, name string")
    assert records.checked_dimension(dim, "key", ["name"]).count() == 2
    for bad in (dim.union(dim), dim.withColumn("name", F.lit(" "))):
        with pytest.raises(ValueError):
            records.checked_dimension(bad, "key", ["name"])
    (tmp_path / "s.jsonl").write_text('{"id": "a", "why": "1"}\n{"id": "a", "why": "2"}\n')
    assert rows(records.settings(spark, str(tmp_path / "s.jsonl"), "id string, why string", "id", [])) == [("a", "2")]
    assert rows(records.settings(spark, str(tmp_path / "none"), "id string, why string", "id", [("d", "")])) == [("d", "")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    assert records.file_digests(spark, str(tmp_path / "f")).first().digest == hashlib.sha256(b"abc").hexdigest()
    a, b = str(tmp_path / "p"), str(tmp_path / "q")
    dim.write.parquet(a)
    dim.withColumn("more", F.lit(1)).write.parquet(b)
    assert records.with_optional(spark, a, b).count() == 4 and records.with_optional(spark, a, None).count() == 2
    with pytest.raises(Exception):
        records.with_optional(spark, a, str(tmp_path / "missing")).count()


def test_journal_with_unreadable_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"id": "a"}\nbroken\nbroken\n{"id": null}\n')
    with pytest.raises(records.UnreadableJournal):
        records.read_journal(spark, str(tmp_path / "j.jsonl"), "id string", "id", str(tmp_path / "backup"))
    assert rows(spark.read.parquet(str(tmp_path / "backup")).select("line")) == [("broken",)]
    (tmp_path / "k.jsonl").write_text('{"id": "a"}\n{"id": null}\n')
    assert rows(records.read_journal(spark, str(tmp_path / "k.jsonl"), "id string", "id", str(tmp_path / "other"))) == [("a",)]


def plain_phones(text):
    bare = lambda x: re.sub("[^0-9]", "", x)
    found = {bare(m) for m in re.findall(r"(?<!\d)\d{2,4}(?:[ \u00a0-]\d{2,4}){2,}(?!\d)", text) if len(bare(m)) >= 9}
    return found | set(re.findall(r"(?<!\d)\d{9,}(?!\d)", text)) | set(re.findall(r"(?<!\d)\d{3}(?!\d)", text))


def test_phones_of_decoded_pages(spark):
    texts = ["call 112 or 601 202 303", "22 619-66-54 now", "0048601202303 and 12345", "<p>&#49;&#49;2</p><script>999</script>", "1234567890 x 12 34", "a&nbsp;b&amp;c 997", ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, html string").select("i", names.decoded(F.col("html")).alias("t"), names.phones(names.decoded(F.col("html"))).alias("n"))
    seen = {r.i: r for r in got.collect()}
    assert seen[3].t == "112" and seen[5].t == "a b c 997"
    assert all(set(r.n) == plain_phones(r.t) and len(r.n) == len(set(r.n)) for r in seen.values())
    calls = spark.createDataFrame([('<a HREF="tel:+48 601-202-303">x</a> <a href="tel:7">y</a> <a href="tel:none">z</a>',)], "html string")
    assert sorted(calls.select(names.page_phones(F.col("html"))).first()[0]) == ["48601202303", "7"]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", names.decoded(F.col("html")).alias("t")).collect()
    called = lambda html: {re.sub("[^0-9]", "", m) for m in re.findall('(?i)href="tel:([^"]+)"', html)} - {""}
    expected = sorted((p.page_id, n) for p in pages for n in plain_phones(p.t) | called(p.html))
    assert rows(catalogue.queries()["html_phones"](spark, "/root/testdata/sf0.001")) == sorted(expected, key=repr) and expected


def test_registered_queries_against_plain_rules(spark):
    sf = "/root/testdata/sf0.001"
    people = spark.read.parquet(f"{sf}/customer.parquet").collect()
    named = {r.c_custkey: r.name for r in catalogue.queries()["component_names"](spark, sf).collect()}
    assert named == {p.c_custkey: hmac.new(b"salt", "\n".join(sorted([p.c_name, p.c_mktsegment])).encode(), hashlib.sha256).hexdigest() for p in people}
    bits = {r.row: r for r in catalogue.queries()["image_hashes"](spark, sf).collect()}
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    for v in vectors[:40]:
        grey = np.array([float(v.embedding[i % len(v.embedding)]) * 100 for i in range(1024)]).reshape(32, 32)
        small = np.array([[grey[4 * r : 4 * r + 4, 4 * c : 4 * c + 4].mean() for c in range(8)] for r in range(8)]).ravel()
        expected = int("".join("1" if x >= small.mean() else "0" for x in small), 2)
        got = bits[v.vec_id].average & (2**64 - 1)
        assert (got ^ expected).bit_count() <= 1  # a cell equal to the mean may fall either way
    assert len(bits) == len(vectors)
    types = {r.event_type: r for r in catalogue.queries()["bootstrap_bounds"](spark, sf).collect()}
    for name, r in types.items():
        rates = np.random.default_rng(zlib.crc32(name.encode())).binomial(r.n, r.s / r.n, size=1000) / r.n
        assert math.isclose(r.lower, np.quantile(rates, 0.05)) and math.isclose(r.upper, np.quantile(rates, 0.95))


def test_images_are_resized_as_by_loops(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (6, 9)).astype(float)
    df = spark.createDataFrame([(1, image.ravel().tolist()), (2, [1.0]), (3, None)], "row long, pixels array<double>")
    got = {r.row: r.pixels for r in images.resized(df, "row", "pixels", 9, 6, (4, 3)).collect()}
    for y in range(3):
        for x in range(4):
            total = sum(
                image[b, a] * max(0.0, min(x * 9 / 4 + 9 / 4, a + 1) - max(x * 9 / 4, a)) * max(0.0, min(2 * y + 2, b + 1) - max(2 * y, b)) for a in range(9) for b in range(6)
            )
            assert math.isclose(got[1][4 * y + x], total / (9 / 4 * 2))
    assert got[2] is None and got[3] is None
    line = images.resized(df.where("row = 1"), "row", "pixels", 9, 6, (18, 6), "linear").first().pixels
    for x in range(18):
        c = min(max((x + 0.5) / 2 - 0.5, 0), 8)
        low = int(c)
        assert math.isclose(line[x], image[0, low] * (1 - (c - low)) + image[0, min(low + 1, 8)] * (c - low))
