"""Segmented scans, verified lookups, manifests and sample reasons against plain statements of their rules."""

from __future__ import annotations

import json
import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from quarryline.operators import caps, gates, manifest, resources
from quarryline.operators.scans import Scan


@pytest.fixture(scope="module")
def walks(spark):
    """One group with most rows, so that it goes on over several parts, and small ones; a null group and null values."""
    rng = random.Random(1)
    sizes = {"hot": 3000, "a": 40, "b": 1, None: 25, "z": 300}
    rows = [(g, i, rng.choice(["x", "x", "y", None]), rng.randrange(-5, 9), rng.random() < 0.7) for g, n in sizes.items() for i in rng.sample(range(10_000), n)]
    frame = spark.createDataFrame(rows, "g string, at long, label string, v long, bad boolean").repartition(6)
    by_group = {g: sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) for g in sizes}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    yield frame, by_group
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_folds_go_on_over_parts(walks):
    frame, groups = walks
    v = F.col("v")
    scan = Scan(frame, ["g"], "at").fold(s=("sum", v), before=("sum", v, False), top=("max", v), prior=("max", v, False), last=("last", F.col("label"))).runs("run", "label")
    got = {(r.g, r.at): (r.s, r.before, r.top, r.prior, r["last"], r.run, r._place) for r in scan.result("s", "before", "top", "prior", "last", "run", "_place").collect()}
    assert scan.rows.where("g = 'hot'").select("_part").distinct().count() > 1
    for g, rows in groups.items():
        run = place = total = 0
        top = None
        for i, (_, at, label, v, _) in enumerate(rows):
            new = i == 0 or rows[i - 1][2] != label
            run, place = run + new, 1 if new else place + 1
            before, prior = total, top
            total, top = total + v, v if top is None else max(top, v)
            assert got[g, at] == (total, before, top, prior, rows[i - 1][2] if i else None, run, place)
    assert len(got) == sum(map(len, groups.values()))


def test_guards_and_streaks_of_a_large_group(walks):
    frame, groups = walks
    streaks = {(r.g, r.at): r.streak for r in caps.failure_streaks(frame, ["g"], "at", "bad").collect()}
    guard = {(r.g, r.at): (r.attempts, r.unsafe_so_far, r.aborted) for r in caps.unsafe_guard(frame, ["g"], "at", "bad", 20, 0.72).collect()}
    filled = {(r.g, r.at) for r in caps.fill_to_cap(frame.withColumn("ok", ~F.col("bad")), ["g"], "at", "ok", 60, 9).collect()}
    for g, rows in groups.items():
        streak = bad = good = longest = 0
        ever = False
        for n, (_, at, _, _, b) in enumerate(rows, 1):
            assert ((g, at) in filled) == (good < 60 and bad < 120 and longest < 9)
            streak, bad, good = streak + 1 if b else 0, bad + b, good + (not b)
            longest, ever = max(longest, streak), ever or (n >= 20 and bad > 0.72 * n)
            assert streaks[g, at] == streak and guard[g, at] == (n, bad, ever)


def test_no_window_gathers_a_group(walks):
    plan = caps.unsafe_guard(walks[0], ["g"], "at", "bad")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "Window(" in line]
    over_rows = [w for w in windows if "_at" in w]
    assert over_rows and all("_part" in w for w in over_rows)


def plain_upgrade(url, samples):
    """Samples: (host, url, http status, https status, http digest, https digest)."""
    def agrees(s):
        return s[2] is not None and s[3] is not None and 200 <= s[2] < 300 and 200 <= s[3] < 300 and s[4] == s[5] and len(s[4] or "") == 64

    def key(u):
        p = urlsplit(u.strip())
        return ((p.hostname or "").lower(), p.path, p.query) if p.scheme.lower() in ("http", "https") and p.hostname else None

    trusted = {h for h in {s[0].lower() for s in samples} if all(agrees(s) for s in samples if s[0].lower() == h)}
    known = {key(s[1]) for s in samples if agrees(s) and s[0].lower() in trusted and key(s[1]) and key(s[1])[0] == s[0].lower()}
    if not (url or "").strip() or urlsplit(url.strip()).scheme.lower() == "https":
        return None
    k = key(url)
    if k is None:
        return "url_not_https"
    return "http_host_not_allowlisted" if k[0] not in trusted else None if k in known else "https_not_verified_for_url"


def test_only_sampled_resources_are_upgraded(spark):
    d, e = "a" * 64, "b" * 64
    samples = [
        ("Good.example", "http://good.example/a?q=1", 200, 204, d, d), ("good.example", "https://GOOD.example/b#top", 200, 200, e, e), ("good.example", "http://other.example/c", 200, 200, d, d),
        ("mixed.example", "http://mixed.example/a", 200, 200, d, d), ("mixed.example", "http://mixed.example/b", 200, 200, d, e), ("down.example", "http://down.example/a", 200, None, d, d),
        ("moved.example", "http://moved.example/a", 301, 200, d, d), ("short.example", "http://short.example/a", 200, 200, "ab", "ab"),
    ]
    urls = [
        "http://good.example/a?q=1", "http://good.example/a?q=2", "http://good.example/a", "HTTP://user@Good.example:80/b", "http://good.example/b#x", "http://other.example/c", "http://mixed.example/a", "http://down.example/a",
        "http://moved.example/a", "http://short.example/a", "https://never.example/", "", " ", None, "ftp://good.example/a", "no url", " http://good.example/a?q=1 ",
    ]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in urls for b in urls)]
    frame = spark.createDataFrame(samples, "host string, url string, a int, b int, c string, d string")
    agrees = resources.sample_agrees(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    got = resources.upgraded_urls(spark.createDataFrame(pairs, "n long, x string, y string").repartition(3), "n", ["x", "y"], frame, agrees).collect()
    assert len(got) == len(pairs)
    for r in got:
        _, x, y = pairs[r.n]
        reason = plain_upgrade(x, samples) or plain_upgrade(y, samples)
        assert r.reason == reason
        if reason:
            assert (r.x, r.y) == (x, y)
        else:
            assert all((u or "").strip() == "" or u.strip().startswith("https://") for u in (r.x, r.y))


def test_canonical_lines_equal_the_json_library(spark):
    rng = random.Random(2)
    signs = ['"', "\\", "\\u001A", "\n", "\t", "\x1f", "\x0b", "\x1a", "é", "日", "/", "A", " ", " ", "\x7f", "\x00"]
    rows = [("".join(rng.choice(signs) for _ in range(rng.randrange(6))), rng.choice([None, "", "b"]), rng.choice([None, 7])) for _ in range(300)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, Zeta string, alpha string, m long")
    got = {r.n: r.line for r in frame.select("n", manifest.canonical_line(["alpha", "Zeta", "m"], split=F.lit("train")).alias("line")).collect()}
    for i, (z, a, m) in enumerate(rows):
        filled = {k: v for k, v in (("Zeta", z), ("alpha", a), ("m", m), ("split", "train")) if v not in (None, "")}
        assert got[i] == json.dumps(filled, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_manifest_of_halves_and_in_any_order(spark):
    rows = [(i, f"c{i % 3}", ("train", "val")[i % 5 == 0], f"text {i % 40}") for i in range(500)]
    frame = spark.createDataFrame(rows, "n long, label string, split string, t string")
    line = manifest.canonical_line(["label", "t"], split=F.col("split"))
    none = spark.createDataFrame([], "label string, reason string")

    def made(state):
        return sorted((tuple(r) for r in manifest.manifest(state, "split", "label", ["train", "val", "test"], "salt", "{}", none).collect()), key=repr)

    whole = made(manifest.sums(frame, line, "split", "label"))
    assert whole == made(manifest.sums(frame.orderBy(F.rand(3)).repartition(7), line, "split", "label"))
    parts = [manifest.sums(frame.where(w), line, "split", "label") for w in ("n < 100", "n >= 100 AND n < 101", "n > 100")]
    assert whole == made(manifest.merged(parts, "split", "label"))
    fewer, twice = manifest.sums(frame.where("n <> 7"), line, "split", "label"), manifest.sums(frame.union(frame.where("n = 7")), line, "split", "label")
    content = lambda rows: next(r[4] for r in rows if r[0] == "content")
    assert len({content(x) for x in (whole, made(fewer), made(twice))}) == 3
    assert {(r[1], r[2]): r[3] for r in whole if r[0] == "class"}["test", "c1"] == 0
    empty = made(manifest.sums(frame.where("false"), line, "split", "label"))
    assert [r[3] for r in empty if r[0] == "content"] == [0]


def plain_reasons(counts, expected, groups, floor, rare, total):
    whole = lambda x: int(float(x)) if x is not None and str(x).replace(".", "", 1).isdigit() and float(x) == int(float(x)) else None
    seen = {n: (whole(s) if whole(c) is not None else None, whole(c)) for n, s, c in counts}
    out = []
    listed = sorted(expected, key=lambda e: e[1])
    for name, exempt in [(e[0], e[3]) for e in listed] + [(n, False) for n in sorted(seen) if n not in {e[0] for e in expected}]:
        if name not in seen:
            out.append(("item", name, "missing"))
            continue
        s, c = seen[name]
        if s is None:
            out.append(("item", name, "not_a_count"))
        elif not exempt and s < floor:
            out.append(("item", name, "below_floor"))
        elif exempt:
            out += [("item", name, w) for w, bad in (("below_rare_floor", s < rare), ("exempt_but_unsafe", c > 0)) if bad]
    for grp, _, minimum in sorted(groups, key=lambda g: g[1]):
        members = [seen.get(e[0], (None, None))[0] for e in expected if e[2] == grp]
        if members:
            out += [("group", grp, "member_missing")] if None in members else [("group", grp, "group_below_minimum")] if sum(members) < minimum else []
    every = [seen.get(n, (None, None)) for n in {e[0] for e in expected} | set(seen)]
    unknown = any(s is None for s, _ in every)
    out += [("all", "", "total_unknown")] if unknown else [("all", "", "total_below_minimum")] if sum(s for s, _ in every) < total else []
    return out + ([("all", "", "unsafe_outcomes")] if sum(c or 0 for _, c in every) else [])


@pytest.mark.parametrize("seed", range(6))
def test_sample_reasons_at_three_levels(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    odd = [None, "2.5", "-1", "x", "nan"] if seed % 2 else ["7"]
    counts = [(n, rng.choice([*odd, "3", "20", "55", "300"]), rng.choice(["0", "0", "1", *odd])) for n in names if seed % 3 or rng.random() < 0.8]
    expected = [(n, i, rng.choice([None, "g", "h"]), rng.random() < 0.4) for i, n in enumerate(rng.sample(names, 7))]
    groups = [("g", 2, rng.choice([1, 90])), ("h", 1, 60), ("k", 3, 5)]
    got = gates.sample_reasons(
        spark.createDataFrame(counts, "name string, support string, confident string"), spark.createDataFrame(expected, "name string, place long, grp string, exempt boolean"),
        spark.createDataFrame(groups, "grp string, place long, minimum long"), 20, 5, 400,
    ).orderBy("seq").collect()
    assert [(r.level, r.name, r.reason) for r in got] == plain_reasons(counts, expected, groups, 20, 5, 400)
    assert [r.seq for r in got] == list(range(1, len(got) + 1))
