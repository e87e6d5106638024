from __future__ import annotations

import pytest

import corpus_pipeline
from quarryline.llm import decontam, minhash, packing, pii, quality
from quarryline.llm.tokens import PieceEncoder, encoder, vocabulary

from .test_contracts import SCHEMA, SF, base_of, brute_components, brute_hits, brute_kept, brute_spans, check_packing, odd_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns_and_decide_as_their_plain_versions(spark, stages):
    (raw, good), (_, single), (_, fair), (_, clean), (_, packed) = stages
    for frame in (good, single, fair, clean):
        assert frame.columns == COLUMNS
    rows = [(r.doc_id, r.text, r.source) for r in raw.collect()]
    assert ids(good) == sorted(k[0] for k in brute_kept(rows).elements() if k[-1])
    assert ids(single) == sorted(k[0] for k in brute_components([(r.doc_id, r.text) for r in good.collect()]) if k[-1])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(fair) == sorted(k[0] for k in brute_hits([(r.doc_id, r.text) for r in single.collect()], items) if not k[-1])
    assert len(ids(fair)) < len(ids(single)) < len(ids(good)) < len(rows)
    before = {r.doc_id: r.text for r in fair.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id]) == (not brute_spans(before[r.doc_id]))
        assert not brute_spans(r.text)
    whole = encoder(vocabulary("word_bpe_49k.json"), True).whole
    check_packing(None, packed.collect(), {r.doc_id: whole(r.text) + (1).to_bytes(4, "little") for r in clean.collect()})


def test_run_gives_the_last_stage(spark, stages):
    key = ("doc_id", "start", "length", "doc_tokens")
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).select(*key).collect()) == sum(r.length for r in stages[-1][1].select(*key).collect())


def test_stage_functions_on_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    bench = spark.createDataFrame([(1, "word")], "item_id long, text string")
    for frame in (odd, odd.where("false")):
        for out in (quality.cleaned(frame), minhash.one_of_each(frame), decontam.uncontaminated(frame, bench), pii.sanitise(frame)):
            assert out.columns == frame.columns
            out.collect()
    assert decontam.uncontaminated(odd, bench).count() == len(odd_rows()) - 2 == decontam.uncontaminated(odd, bench, most_item_bytes=2).count()
    assert packing.pack(odd.where("false")).count() == 0


def test_common_lines_are_cut(spark):
    rows = [(i, "Common  Line here\n" + " ".join(f"w{i}x{k}" for k in range(90)), None, "h" if i % 2 else None, 0) for i in range(60)]
    got = quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).collect()
    assert len(got) == 60 and all(r.text == base_of(rows[r.doc_id][1]) and r.n_chars == len(r.text) for r in got)


def test_stages_hand_over_few_texts_at_once(spark):
    """Batches of 10,000 texts took an executor over its 3,000 MB; a smaller setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    try:
        for own, after in (("10000", 1000), ("0", 1000), ("64", 64)):
            for stage in (corpus_pipeline.quality_rules, corpus_pipeline.remove_personal_data, corpus_pipeline.pack_sequences):
                spark.conf.set(name, own)
                stage(spark, docs, SF)
                assert int(spark.conf.get(name)) == after
    finally:
        spark.conf.set(name, before)


def test_packing_remembers_few_words_and_packs_alike():
    few = PieceEncoder(vocabulary("word_bpe_49k.json"), True, most_known=3)
    for text in ("one two three four five, six seven", "seven six five four three two one", "one"):
        assert few.encode(text) == few.whole(text)
        assert len(few.first) + len(few.known) < 20
