"""Folders of tables, reference sets, allowed facts, and a journal kept over restarts."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import names, variants
from quarryline.operators import gates, journal, lookups
from quarryline.sources import tables
from quarryline.streaming import journal as stream


def test_photo_tables_of_a_folder(spark, tmp_path):
    """A byte order mark, a missing column, short lines, an empty table, a side table and superseded ones."""
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")

    put("a/first.csv", "﻿species,author\n one ,\"say \"\"x\"\"\"\n two\n")
    put("a/list_by_nc.csv", "author,species\nme,three\n")
    put("a/guess_niezweryfikowane.csv", "species,author\nfour,you\n")
    put("a/old.csv", "species,author\nnever,never\n")
    put("b/old_v2.csv", "species,author\nfive,they\n")
    put("a/marked.csv", "observationID,licence_note,species\n9,note,six\n")
    put("df20/seven.csv", "species\nseven\n")
    put("a/list_meta.csv", "species,author\nside,me\n")
    put("a/_hidden.csv", "species\nnever\n")
    put("a/x_grupa_toksyczna.csv", "species\nnever\n")
    put("a/empty.csv", "")
    put("a/notes.txt", "species\nnever\n")
    got = tables.read_photo_tables(spark, str(tmp_path), ["species", "author", "licence_note"]).orderBy("meta", "order").collect()
    assert [(r.species, r.author, r.licence_note, r.meta, r.unverified, r.restricted, r.order) for r in got] == [
        ("one", 'say "x"', "", False, False, False, 1), ("two", "", "", False, False, False, 2), ("six", "", "note", False, False, True, 3), ("five", "they", "", False, False, False, 4),
        ("three", "me", "", False, False, False, 5), ("seven", "", "", False, False, True, 6), ("four", "you", "", False, True, False, 7), ("side", "me", "", True, False, False, 1),
    ]
    (tmp_path / "none").mkdir()
    assert tables.read_photo_tables(spark, str(tmp_path / "none"), ["species"]).count() == 0


def test_reference_paths_and_keys(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.csv").write_text("x")
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"tables": ["a.csv"]}))
    found = tables.reference_paths(spark, [str(tmp_path / "c.csv"), " "], str(config), "SETS", {"SETS": f" {tmp_path}/b.csv {os.pathsep}"})
    assert found == [str(tmp_path / f"{n}.csv") for n in "abc"]
    with pytest.raises(ValueError, match="not found"):
        tables.reference_paths(spark, ["/nowhere/x.csv"])
    config.write_text("[]")
    with pytest.raises(ValueError, match="list of tables"):
        tables.reference_paths(spark, None, str(config))
    schema = "image_url string, source_url string, inaturalist_observation_id string, mo_observation_id string"
    good = spark.createDataFrame([("https://A.example/photos/12/x.jpg?s", "https://mushroomobserver.org/observations/7", " 55 ", "None"), ("https://b.example/y", "", None, "8")], schema)
    assert {tuple(r) for r in tables.photo_keys(good).collect()} == {
        ("image", "https://a.example/photos/12/x.jpg"), ("image", "https://b.example/y"), ("photo", "12"), ("mo_observation", "7"), ("mo_observation", "8"), ("inat_observation", "55"),
    }
    for bad in [("", "", None, None), ("http://x.example", "", None, None), ("https://x.example", "ftp://y", None, None)]:
        with pytest.raises(ValueError, match="not https"):
            tables.photo_keys(spark.createDataFrame([bad], schema))


def test_facts_outside_the_list_stop_the_load(spark):
    rows = spark.createDataFrame([("a", "x", 1, "p"), ("b", None, 2, "p"), ("c", "z", 3, "p")], "id string, ring string, _tmp int, status string")
    assert lookups.allowlisted(rows.where("id <> 'c'"), "id", {"ring": ["x", "y"]}).columns == ["id", "ring"]
    with pytest.raises(ValueError, match="c.ring"):
        lookups.allowlisted(rows, "id", {"ring": ["x", "y"]})
    assert lookups.public(rows, "status").columns == ["id", "ring"]


def test_a_device_report_must_hold_in_all(spark):
    schema = "platform string, measured_on string, model_sha256 string, sample_sha256 string, images long, high_risk_images long, decision_fields array<string>, top1_agreement double, high_risk_top1_agreement double, decision_agreement double, high_risk_decision_agreement double, max_energy_difference double"
    good = ("gpu", "device", "m", "s", 9, 2, ["a", "b"], 0.99, 1.0, 0.995, 1.0, 0.0)
    reasons = lambda rows, model="m": [r.reason for r in gates.device_reasons(spark.createDataFrame(rows, schema), model, "s", 9, 2, ["gpu"], ["a", "b"]).orderBy("seq").collect()]
    assert reasons([good]) == [] and reasons([]) == ["missing"] and reasons([good], "") == ["model_sha256"]
    bad = ("cpu", "desk", "x", None, 8, None, ["b", "a"], 0.98, None, float("nan"), 1.5, float("inf"))
    assert len(reasons([bad])) == 12


def test_types_of_fields_in_records(spark):
    raws = ['{"a":"1","b":1,"c":true,"d":[1],"e":{"f":" x "},"g":null}', "{}", "[]", "nonsense", None, '{"a":1e400}']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n long, raw string").select("n", F.try_parse_json("raw").alias("v"))
    v = F.col("v")
    got = {r.n: r for r in frame.select("n", *[variants.kind(variants.at(v, f"$.{k}")).alias(k) for k in "abcdeg"], variants.number(v, "$.a").alias("quoted"), variants.text(v, "$.e.f").alias("inner")).collect()}
    assert [got[0][k] for k in "abcdeg"] == ["STRING", "NUMBER", "BOOLEAN", "ARRAY", "OBJECT", "VOID"]
    assert got[0].quoted is None and got[0].inner == "x" and all(got[i].a is None for i in (1, 2, 3, 4)) and got[5].quoted is None
    kept = journal.recovered(spark.createDataFrame([(i, r) for i, r in enumerate([*raws, '{"id":""}', '{"id":"k"}'])], "n long, raw string"), "raw", "n").collect()
    assert [(r.n, r.id, r.status, r.timestamp) for r in kept] == [(7, "k", "unavailable", 0.0)]
    paths = {"p.jpg": "p.jpg", "/d/journal-photos/q.png": "q.png", "/d/journal-photos/e/q.png": None, "../p.jpg": None, "p.gif": None}
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", names.photo_name(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in found} == paths


def plain_journal(changes, n):
    last = {}
    for owner, i, seq, payload in changes:
        if seq > last.get((owner, i), (-1,))[0]:
            last[owner, i] = (seq, payload)
    out = set()
    for owner in {o for o, _ in last}:
        newest = sorted((k for k in last if k[0] == owner), key=lambda k: (-last[k][0], k[1]))[:n]
        out |= {(owner, i, *last[owner, i]) for _, i in newest if last[owner, i][1] is not None}
    return out


def test_a_journal_kept_over_restarts(spark, tmp_path):
    """Changes in any order over three runs; the last batch runs twice, as after a crash, and counts once."""
    rng = random.Random(4)
    root, source = str(tmp_path / "journal"), tmp_path / "lines"
    source.mkdir()
    numbers = list(range(240))
    rng.shuffle(numbers)
    changes = [(rng.choice("abc"), f"i{rng.randrange(12)}", s, None if rng.random() < 0.3 else f"p{s}") for s in numbers]
    bad = ["{", '{"owner":"a","id":"","seq":1,"op":"put"}', '{"owner":"a","id":"x","op":"put"}', '{"owner":"a","id":"x","seq":5,"op":"swap"}', "  ", "{"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for run in range(3):
            some = changes[run * 80 : run * 80 + 80]
            lines = [json.dumps({"owner": o, "id": i, "seq": s, "op": "delete" if p is None else "put", **({} if p is None else {"payload": p})}) for o, i, s, p in some] + bad
            (source / f"{run}.txt").write_text("\n".join(lines))
            for again in range(2 if run == 2 else 1):
                if again:  # the batch was written, its commit was lost
                    for folder in ("state-changes", "state-unreadable"):
                        commits = os.path.join(root, folder, "commits")
                        last = max(int(f) for f in os.listdir(commits) if f.isdigit())
                        for name in (str(last), f".{last}.crc"):
                            os.remove(os.path.join(commits, name))
                for q in stream.keep(spark.readStream.text(str(source)), root, 5):
                    q.awaitTermination()
            got = {tuple(r) for r in stream.kept(spark, root).collect()}
            assert got == plain_journal(changes[: run * 80 + 80], 5)
        assert sorted(r.line for r in stream.unreadable(spark, root).collect()) == sorted({b for b in bad if b.strip()})
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_texts_of_records_are_stripped_of_all_white_space_and_objects_told(spark):
    codes = spark.range(1, 0x3100).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    texts = codes.select(F.explode(F.array("c", F.concat("c", F.lit("a b"), "c"), F.concat(F.lit(" "), "c", F.lit("\n"), "c", F.lit("x\n"), "c", F.lit("\r\n")))).alias("t"))
    other = texts.where(~variants.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", "")))
    assert texts.count() > 37_000 and other.count() == 0
    raw = ['{"a": 1}', "{}", '{"_": [1]}', "[1]", '"{}"', "null", "1", "true", '[{"a": 1}]', "{", None]
    read = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string").select("i", F.try_parse_json("raw").alias("v"))
    assert [r[0] for r in read.where(variants.is_object(F.col("v"))).orderBy("i").collect()] == [0, 1, 2]
    assert read.where(variants.is_object(F.col("v")).isNull()).count() == 0
    plan = read.select(variants.stripped(F.try_variant_get("v", "$.a", "string")))._jdf.queryExecution().toString()
    assert "regexp" not in plan.lower()  # one pattern search for each cell took a third of the time
