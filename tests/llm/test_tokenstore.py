from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import registry, tokenstore
from quarryline.llm.tokens import encoder, vocabulary

from .test_contracts import SF, odd_rows, SCHEMA


def brute(rows):
    whole = encoder(vocabulary("byte_bpe_50k.json"), False).whole
    out, start = [], 0
    for d, t in rows:
        ids = whole(t or "") + (2).to_bytes(4, "little")
        out.append((d, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    return out


def test_store_of_the_documents(spark):
    rows = sorted((tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: r[0])
    got = registry.op3_token_store(spark, SF).collect()
    assert all(r.verified for r in got)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(x[:4] for x in brute(rows))


def test_round_trip_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    path = f"{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame(rows, SCHEMA), path)
    docs = tokenstore.read_documents(spark, path).collect()
    whole = encoder(vocabulary("byte_bpe_50k.json"), False).whole
    assert Counter((r.doc_id, bytes(r.ids)) for r in docs) == Counter((r[0], whole(r[1] or "") + (2).to_bytes(4, "little")) for r in rows)
    at = 0
    for r in sorted(docs, key=lambda r: r.row):
        assert r.start == at
        at += len(r.ids) // 4
    got = {r.row: r for r in tokenstore.verify_store(spark, path).collect()}
    assert all(got[r.row].verified and got[r.row].ids_crc32 == zlib.crc32(r.ids) and got[r.row].start == r.start for r in docs)
    chunks = spark.read.parquet(f"{path}/blocks").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("place").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").first().documents == len(rows)
    tokenstore.write_store(spark.createDataFrame([], SCHEMA), f"{path}-empty")
    assert tokenstore.verify_store(spark, f"{path}-empty").count() == 0


def test_damage_shows(spark, tmp_path):
    path = f"{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string"), path)
    first = spark.read.parquet(f"{path}/blocks").where("kind = 'chunk'").first().place
    kept = spark.read.parquet(f"{path}/blocks").where("kind = 'recipe' or hex(place) <> '%s'" % bytes(first).hex().upper()).collect()
    spark.createDataFrame(kept, f"{tokenstore.BLOCKS.replace('kind string, ', '')}, kind string").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/blocks")
    assert Counter(r.verified for r in tokenstore.verify_store(spark, path).collect()) == {True: 1, False: 1}


def rewritten(spark, path, table, change):
    rows = change(spark.read.parquet(f"{path}/{table}"))
    rows.write.parquet(f"{path}/{table}-new")
    spark.read.parquet(f"{path}/{table}-new").write.mode("overwrite").parquet(f"{path}/{table}")


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.where("row <> 1"),
        lambda r: r.where("row <> 2"),
        lambda r: r.where("false"),
        lambda r: r.withColumn("doc_id", F.when(F.col("row") == 1, 77).otherwise(F.col("doc_id"))),
        lambda r: r.withColumn("start", F.col("start") + 1),
        lambda r: r.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("row") == 2, 1).otherwise(0)),
        lambda r: r.withColumn("root", F.when(F.col("row") == 0, F.reverse("root")).otherwise(F.col("root"))),
        lambda r: r.unionAll(r.where("row = 2").withColumn("row", F.lit(3).cast("long"))),
    ],
)
def test_lost_and_altered_recipes_fail_the_manifest(spark, tmp_path, change):
    path = f"{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([(1, "some text"), (2, "other text"), (3, "more")], "doc_id long, text string"), path)
    assert tokenstore.damaged_parts(spark, path).count() == 0
    rewritten(spark, path, "recipes", change)
    with pytest.raises(tokenstore.DamagedStore):
        tokenstore.verify_store(spark, path)


def test_parts_of_the_manifest_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenstore, "PART", 4)
    path = f"{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([(i, "text " * i) for i in range(11)], "doc_id long, text string"), path)
    assert sorted((r.part, r.documents) for r in spark.read.parquet(f"{path}/manifest").collect()) == [(0, 4), (1, 4), (2, 3)]
    assert tokenstore.verify_store(spark, path).where("verified").count() == 11
    rewritten(spark, path, "manifest", lambda m: m.where("part <> 1"))
    assert {(r.part, r.fault) for r in tokenstore.damaged_parts(spark, path).collect()} == {(1, "unknown"), (2, "altered")}


def test_cuts_follow_content_and_checksums_combine():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000, dtype=np.uint32)
    of = lambda x: tokenstore.cuts(len(x), tokenstore.marks_of(x).tolist())
    ends = of(ids)
    other = ids[:3000][::-1].copy()
    end_to_end = [m - 3000 for m in tokenstore.marks_of(np.concatenate([other, ids])).tolist() if m > 3000]
    assert tokenstore.cuts(len(ids), end_to_end) == ends
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= tokenstore.MOST and sizes[:-1].min() >= tokenstore.LEAST
    edited = np.concatenate([ids[:100], [7], ids[100:]]).astype(np.uint32)
    chunk = lambda x, e: {x[a:b].tobytes() for a, b in zip([0, *e], e)}
    assert len(chunk(ids, ends) - chunk(edited, of(edited))) <= 3
    a, b = ids[:500].tobytes(), ids[500:1777].tobytes()
    parts = tokenstore.crc_moved(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert int(parts[0] ^ parts[1]) == zlib.crc32(a + b)
