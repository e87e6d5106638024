"""From raw documents to packed training sequences.

Each stage works on what its predecessor kept; ``run`` writes each stage's
documents as Parquet and reads them again for the next one. Stages take an
empty table and give an empty one, take texts whole however long they are,
and keep extra columns of any name but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontam, minhash, packing, pii, quality
from quarryline.llm._common import scratch_path

#: Documents that a task's JVM and Python hand over at once, at most, and words whose ids the packing remembers.
BATCH, WORDS = 1000, 300_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches of at most ``BATCH`` rows, held once by the JVM and once by Python.

    It stays so, since a stage runs when its result is read. A smaller setting of the session's own is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:  # 0 and below mean no limit
        spark.conf.set(name, BATCH)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit are cut from the others.

    Null, empty and blank texts are rejected; a null source is a host of its
    own; repeated rows are judged alike.
    """
    small_batches(spark)
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Of rows that share an id one stays; rows without an id stay all, and so do
    texts without words.
    """
    small_batches(spark)
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and wordless texts stay; items without words or id have no windows.
    """
    small_batches(spark)
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are named by kind, terms that give them away are cut or generalised.

    Null and empty texts stay as they are; repeated rows count each in the
    statistics and are rewritten alike.
    """
    small_batches(spark)
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048.

    A null or empty text is its end id alone; repeated rows and ids are packed
    as rows of their own. Returns the columns of ``packing.PIECES``.
    """
    small_batches(spark)
    return packing.pack(docs, most_known=WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express tokenisation or the packing order; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
