"""Splits with their check, secrets, and settings with defaults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryline.functions import arrays
from quarryline.operators import splitting
from quarryline.sources import secrets


def test_a_checked_split_keeps_reference_rows_out_of_test(spark, monkeypatch):
    rows = [(i, f"c{i % 3}", i // 2, [f"k{i}", f"m{i % 7}"]) for i in range(200)]
    frame = spark.createDataFrame(rows, "n long, label string, part long, keys array<string>").repartition(5)
    reference = spark.createDataFrame([(f"k{i}",) for i in range(0, 200, 9)], "key string")
    got = splitting.assigned(frame, "label", "part", "keys", reference).collect()
    held = {i // 2 for i in range(0, 200, 9)}
    assert len(got) == 200 and {r.split for r in got} == {"train", "val", "test"}
    assert not any(r.part in held for r in got if r.split == "test")
    assert all(len({r.split for r in got if r.part == p}) == 1 for p in range(100))
    monkeypatch.setattr(splitting, "split_components", lambda df, *a, **k: df.withColumn("split", F.lit("test")))
    with pytest.raises(splitting.LeakingSplit, match="k"):
        splitting.assigned(frame, "label", "part", "keys", reference)


def test_salt_from_environment_or_a_file_outside(tmp_path):
    repo, home = tmp_path / "repo", tmp_path / "home"
    repo.mkdir()
    home.mkdir()
    (home / "salt").write_text(" file \n")
    (repo / "salt").write_text("committed")
    (home / "empty").write_text(" ")
    (home / "link").symlink_to(repo / "salt")
    load = lambda env, default="salt": secrets.load_salt("SALT", "SALT_FILE", str(home / default), str(repo), env)
    assert load({"SALT": " env "}) == "env" and load({}) == "file" and load({"SALT": " ", "SALT_FILE": str(home / "salt")}) == "file"
    for env, default in (({"SALT_FILE": str(repo / "salt")}, "salt"), ({}, "missing"), ({}, "empty"), ({}, "link")):
        with pytest.raises(secrets.MissingSalt):
            load(env, default)


def test_hidden_classes_have_defaults():
    assert arrays.hidden_ids() == ["not_a_mushroom", "unknown_mushroom"] and arrays.hidden_ids("", "other") == ["not_a_mushroom", "other"]
