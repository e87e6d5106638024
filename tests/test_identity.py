"""Duplicates of two kinds against plain walks; numbers of rows across shuffles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import dedup, fetching, graph, identity, importing, lookups, settling
from quarryline.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain_groups(items, keys_of):
    """Items joined by any chain of keys, by search over keys."""
    by_key = {}
    for i in items:
        for k in keys_of(i):
            by_key.setdefault(k, []).append(i)
    group = {}
    for i in items:
        if i in group:
            continue
        stack, group[i] = [i], i
        while stack:
            for k in keys_of(stack.pop()):
                for j in by_key.pop(k, []):
                    if j not in group:
                        group[j] = i
                        stack.append(j)
    return group


def plain_resolution(rows):
    """``rows``: number to (photo keys, observation keys, label, rank)."""
    clean = lambda ks: [k for k in ks or [] if k]
    bad = {}
    group = plain_groups(rows, lambda i: clean(rows[i][0]))
    for i, (photos, seen, _, _) in rows.items():
        for test in [lambda j, i=i: group[j] == group[i], *(lambda j, k=k: k in clean(rows[j][1]) for k in clean(seen))]:
            labels = {rows[j][2] or "" for j in rows if test(j)}
            if len(labels) > 1:
                bad.setdefault(i, set()).update(labels)
    out = {i: ("class_conflict", sorted(x)) for i, x in bad.items()}
    left = {i: r for i, r in rows.items() if i not in bad}
    group = plain_groups(left, lambda i: clean(left[i][0]))
    best = {}
    for i in sorted(left):
        g = group[i]
        if g not in best or (left[i][3] or 0) > (left[best[g]][3] or 0):
            best[g] = i
    taken = set()
    for i in sorted(left):
        if best[group[i]] != i:
            out[i] = ("looser_license" if (left[i][3] or 0) < (left[best[group[i]]][3] or 0) else "duplicate_photo_id", None)
        elif not clean(left[i][0]) and taken & set(clean(left[i][1])):
            out[i] = ("duplicate_observation_id", None)
        else:
            out[i] = ("kept", None)
            taken |= set(clean(left[i][1]))
    return out


SCHEMA = "n long, photos array<string>, seen array<string>, label string, rank int"


@pytest.mark.parametrize("seed,rounds", [(0, None), (1, 1), (2, 0), (3, None)])
def test_resolution_equals_a_walk(spark, seed, rounds):
    rng = random.Random(seed)
    some = lambda kind, n, most: rng.choice([None, [], [""], [None]]) if rng.random() < 0.3 else [f"{kind}{rng.randrange(n)}" for _ in range(rng.randrange(most))]
    rows = {i: (some("p", 60, 3), some("o", 70, 4), rng.choice("aaaaaaaab"), rng.choice([None, 1, 2, 3])) for i in rng.sample(range(1000), 120)}
    frame = spark.createDataFrame([(i, *r) for i, r in rows.items()], SCHEMA).repartition(4)
    got = {r.n: (r.verdict, r.labels) for r in identity.resolved(frame, "n", "photos", "seen", "label", "rank", rounds).collect()}
    assert got == plain_resolution(rows)


def test_two_kinds_of_key_differ(spark):
    """Photos 1-2-3 chain, so that 1 meets 3's label; observations 4-5-6 chain, so that 4 doesn't meet 6's."""
    rows = {1: (["a"], [], "x", 1), 2: (["a", "b"], [], "x", 1), 3: (["b"], [], "y", 1), 4: ([], ["o"], "x", 1), 5: ([], ["o", "p"], "x", 1), 6: ([], ["p"], "y", 1)}
    got = {r.n: (r.verdict, r.labels) for r in identity.resolved(spark.createDataFrame([(i, *r) for i, r in rows.items()], SCHEMA), "n", "photos", "seen", "label", "rank").collect()}
    assert got == plain_resolution(rows)
    assert {i: v for i, (v, _) in got.items()} == {**dict.fromkeys((1, 2, 3, 5, 6), "class_conflict"), 4: "kept"}


def test_what_was_kept_decides(spark):
    """A chain of rows without photos, each sharing an observation with the next: every second one stays."""
    rows = {i: ([], [f"o{i}", f"o{i + 1}"], "x", 1) for i in range(400)}
    frame = spark.createDataFrame([(i, *r) for i, r in rows.items()], SCHEMA).repartition(5)
    got = {r.n: r.verdict for r in identity.resolved(frame, "n", "photos", "seen", "label", "rank").collect()}
    assert got == {i: "duplicate_observation_id" if i % 2 else "kept" for i in range(400)}


def test_long_chains_by_rounds_or_groups(spark):
    holds = spark.createDataFrame([(i, i, f"k{j}") for i in range(30) for j in (i, i + 1)], "row long, place long, key string")
    expected = {i: i % 2 == 0 for i in range(30)}
    for rounds, most in ((1, 100), (3, 5), (0, 100)):
        assert {r.row: r.kept for r in settling.settled(holds, rounds=rounds, most_local=most).collect()} == expected
    assert settling.settled(holds.limit(0)).count() == 0


def plain_either(rows, distance=2):
    """``rows``: (row, bucket, hashes, order) by walking through them in order."""
    kept, out = [], {}
    for row, bucket, hashes, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if all(h is None for h in hashes):
            continue
        near = next((k for k, b, own in kept if b == bucket and any(x is not None and y is not None and ((x ^ y) & (2**64 - 1)).bit_count() <= distance for x, y in zip(hashes, own))), None)
        if near is None:
            kept.append((row, bucket, hashes))
        else:
            out[row] = near
    return out


@pytest.mark.parametrize("seed,rounds", [(0, None), (1, 1), (2, 0)])
def test_greedy_by_either_hash_equals_a_walk(spark, seed, rounds):
    """Few base hashes with flipped bits, one hash that a third shares, nulls in one hash or both, ties in order, a null bucket."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) - (1 << 63) for _ in range(9)]

    def one():
        h = rng.choice(bases) & (2**64 - 1)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(64)
        return None if rng.random() < 0.2 else bases[0] if rng.random() < 0.3 else h - (1 << 64) if h >> 63 else h

    rows = [(i, rng.choice(["x", "y", None]), (one(), rng.getrandbits(40) if rng.random() < 0.4 else one()), rng.randrange(6)) for i in range(150)]
    frame = spark.createDataFrame([(i, b, *h, o) for i, b, h, o in rows], "n long, bucket string, d long, p long, size int").repartition(4)
    got = dedup.greedy_drop_either(frame, "n", ["bucket"], ["d", "p"], ["size"], rounds)
    assert {r.row: r.near for r in got.collect()} == plain_either(rows)


def test_image_duplicates_equal_a_walk(spark):
    hashes = {r.row: (r.difference, r.perceptual) for r in catalogue.queries()["image_hashes"](spark, SF).collect()}
    groups = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", F.to_json(F.transform("embedding", lambda x: F.round(x, 1))).alias("pixels")).collect():
        groups.setdefault((r.label, r.pixels), []).append((-(r.vec_id * 7919 % 1000), r.vec_id))
    rows = []
    for (label, _), own in groups.items():
        size, row = min(own)
        rows.append((row, (label, row % 3) if label == 0 else label, hashes[row], (size, min(i for _, i in own))))
    got = {r.row: r.near for r in catalogue.queries()["image_duplicates"](spark, SF).collect()}
    assert got == plain_either(rows) and got


def shuffled(spark):
    """Rows behind an exchange whose numbering on the fly differs from run to run."""
    return spark.range(20_000).withColumn("k", F.col("id") % 977).repartition(40).groupBy("id", "k").count()


def test_row_numbers_survive_a_shuffle(spark):
    frame = shuffled(spark)
    bad = spark.createDataFrame([(f"t{i}",) for i in range(0, 977, 2)], "token string")
    got = lookups.excluded(frame, F.array(F.concat(F.lit("t"), "k")), bad)
    assert {r.id for r in got.collect()} == {i for i in range(20_000) if i % 977 % 2 == 0}
    keyed = frame.withColumns({"keys": F.array(F.concat(F.lit("t"), "k")), "label": F.when((F.col("k") % 2 == 0) & (F.col("id") % 3 == 0), "x").otherwise("y")})
    clean, conflicts = importing.without_label_conflicts(keyed, "keys", "label")
    assert {r.id for r in clean.collect()} == {i for i in range(20_000) if i % 977 % 2} and conflicts.count() == 489
    sites = frame.select("id", F.concat(F.lit("http://h"), F.col("k"), F.lit("/p")).alias("u"))
    vouched = spark.createDataFrame([(f"h{i}", "/p") for i in range(0, 977, 2)], "host string, path string")
    parts = F.struct(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.regexp_extract("url", "//[^/]*(.*)", 1).alias("path"))
    got = fetching.upgraded(sites, ["u"], vouched, parts, "url").collect()
    assert all(r.u.startswith("https:") == (r.id % 977 % 2 == 0) for r in got) and len(got) == 20_000


def test_rows_of_one_key_stay_out_of_the_rounds(spark, monkeypatch):
    """What is iterated over is the keys of rows that hold several, each pair once, not all rows."""
    seen, search = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges, *names: seen.append(edges.where(f"{names[0]} <> {names[1]}").count()) or search(edges, *names))
    keys = {i: [f"k{i % 5}"] for i in range(100)} | {100: ["k1", "k3"], 101: ["k3", "k1"], 102: ["k9", None], 103: [], 104: None, 105: ["k9"]}
    frame = spark.createDataFrame(list(keys.items()), "n long, keys array<string>").repartition(3)
    clean = lambda i: [k for k in keys[i] or [] if k]
    assert {r.n: r.component for r in graph.linked_rows(frame, "n", "keys").collect()} == plain_groups(sorted(keys), clean)
    assert seen == [1]
