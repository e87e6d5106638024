"""Helpers shared by the operators: shared storage, global numbering, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.graph import components  # noqa: F401  one form for both

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder serves local masters; any
    other master must name one, since executors can't see a driver's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quarryline-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder; the session's checkpoints are deleted when the driver exits."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint()
    own = (spark, spark.sparkContext.getCheckpointDir())
    if own[1] and own not in _SCRATCH:
        _at_exit(*own)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now, or the path
            continue


def _at_exit(spark: SparkSession, path: str) -> None:
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _at_exit(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: compact, and pruned by column on each read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def with_texts(rows: pa.StructArray, texts: list[str | None], changed: list[bool], text_col: str) -> pa.RecordBatch:
    """The columns of ``whole_row`` with new texts; where a text changed, a length in ``n_chars`` follows it."""
    fields = [f.name for f in rows.type]
    columns = dict(zip(fields, rows.flatten()))
    columns[text_col] = pa.array(texts, pa.string()).cast(columns[text_col].type)
    if "n_chars" in columns:
        kind = columns["n_chars"].type
        columns["n_chars"] = pc.if_else(pa.array(changed, pa.bool_()), pa.array([len(t or "") for t in texts], pa.int64()).cast(kind), columns["n_chars"])
    return pa.RecordBatch.from_arrays(list(columns.values()), fields)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that a task holds Python's copies of few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_order(df: DataFrame, *order) -> DataFrame:
    """Rows range-sorted by ``order`` and cut there, with ``_part`` and ``_at`` (place within the part).

    Rows equal in all of ``order`` are interchangeable; a row id breaks the
    tie so that a large group of them still spreads over range partitions.
    """
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    kept = checkpointed(tie.orderBy(*order, "_tie").drop("_tie"))
    return kept.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )


def starts_of(parts: DataFrame, amount: str) -> DataFrame:
    """For a table with a row per ``_part``: the sum of ``amount`` over all earlier parts as ``_start``."""
    before = F.sum(amount).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))


def numbered(df: DataFrame, *order, name: str = "row") -> tuple[DataFrame, int]:
    """Global row numbers from 0 in ``order``, and the count of rows.

    Only one count per partition goes through a single task.
    """
    rows = in_order(df, *order)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts_of(counts, "_n")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return (
        rows.join(F.broadcast(starts), "_part")  # a row per partition
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start"),
        int(total),
    )


def running_start(df: DataFrame, amount: str, *order, name: str = "start") -> DataFrame:
    """The sum of ``amount`` over all rows before each row in ``order``, plus the row number ``row``."""
    rows = in_order(df, *order)
    parts = rows.groupBy("_part").agg(F.sum(amount).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    starts = starts_of(parts, "_sum").join(
        starts_of(parts, "_n").withColumnRenamed("_start", "_row"), "_part"
    )
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_own", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(F.broadcast(starts), "_part")  # a row per partition
        .withColumn(name, F.col("_start") + F.col("_own"))
        .withColumn("row", F.col("_row") + F.col("_at"))
        .drop("_part", "_at", "_start", "_own", "_row")
    )
