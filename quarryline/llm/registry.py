"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, langid, lexical, minhash, oracles, packing, pii, quality, sharding, substrings, tokenstore, toxicity, urlrules
from ._common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(packing.pack(_table(spark, sf_dir, "documents")))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    tokenstore.write_store(_table(spark, sf_dir, "documents"), path)
    sound = F.coalesce("verified", F.lit(False))
    fault = F.raise_error(F.concat(F.lit("damaged document in row "), F.col("row"))).cast("long")
    return tokenstore.verify_store(spark, path).withColumn("n_tokens", F.when(sound, F.col("n_tokens")).otherwise(fault)).drop("row")


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scrub(_table(spark, sf_dir, "documents"), with_text=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "spans")


#: The rules of the contract.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlrules.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents")).drop("row")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_packing": op2_packing,
        "op3_token_store": op3_token_store,
        "op4_line_frequency": op4_line_frequency,
        "op5_disclosure": op5_disclosure,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_language_id": op8_language_id,
        "op9_url_rules": op9_url_rules,
        "op10_feistel_shards": op10_feistel_shards,
        "op11_source_divergence": op11_source_divergence,
        "op12_lexical_search": op12_lexical_search,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": oracles.OP1,
        "op4_line_frequency": oracles.OP4,
        "op7_decontamination": oracles.OP7,
        "op9_url_rules": oracles.op9(URL_RULES),
        "op11_source_divergence": oracles.OP11,
        "op12_lexical_search": oracles.OP12,
    }
