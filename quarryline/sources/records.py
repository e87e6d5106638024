"""Readers and writers of record files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Marks in the names of photo tables.
SUMMARY, UNVERIFIED = "grupa_toksyczna", "_niezweryfikowane"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped, a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the lines that aren't; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.withColumn("_row", F.from_json("line", f"{schema}, _corrupt_record string", options))
    bad = F.col("_row._corrupt_record").isNotNull()
    return parsed.where(~bad).select("_row.*").drop("_corrupt_record"), parsed.where(bad).select("line")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header and quoted fields, all cells trimmed strings, empty for missing.

    A byte order mark is accepted, columns are taken by name and superfluous
    cells dropped.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    have = set(raw.columns)
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) if c in have else F.lit("").alias(c) for c in columns])


def in_file_order(df: DataFrame, *order) -> DataFrame:
    """Adds ``_order`` within each file, for operators that need the order of input rows."""
    return df.withColumn("_file", F.input_file_name()).withColumn("_order", F.row_number().over(Window.partitionBy("_file").orderBy(*order)))


def write_jsonl(df: DataFrame, path: str, *order, keep_nulls: bool = False) -> None:
    """Sorted JSON lines; part files follow the order."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def replace_all(spark: SparkSession, writes: list[tuple[DataFrame, str]]) -> None:
    """Writes every table beside its place and then renames all of them into it.

    A failure while the tables are written leaves every old one as it was. The
    renames follow each other; if one fails, those before it are undone.
    """
    mark = uuid.uuid4().hex
    try:
        for df, path in writes:
            df.write.parquet(f"{path}.new-{mark}")
        done = []
        try:
            for _, path in writes:
                fs, place = _fs(spark, path)
                old, new = _fs(spark, f"{path}.old-{mark}")[1], _fs(spark, f"{path}.new-{mark}")[1]
                had = fs.exists(place)
                if had and not fs.rename(place, old):
                    raise OSError(f"{path} can't be moved")
                done.append((fs, place, old, had))
                if not fs.rename(new, place):
                    raise OSError(f"{path} can't be replaced")
        except Exception:
            for fs, place, old, had in done:
                if had and fs.exists(old):
                    fs.delete(place, True)
                    fs.rename(old, place)
            raise
        for fs, _, old, had in done:
            if had:
                fs.delete(old, True)
    finally:
        for _, path in writes:
            fs, new = _fs(spark, f"{path}.new-{mark}")
            fs.delete(new, True)


def write_if_clean(violations: DataFrame, writes: list[tuple[DataFrame, str]]) -> None:
    """Writes all tables, or none: with violations it deletes what was there before and fails with the first of them."""
    bad = violations.limit(5).collect()
    if bad:
        for df, path in writes:
            fs, place = _fs(df.sparkSession, path)
            fs.delete(place, True)
        raise ValueError(f"nothing written: {[r.asDict() for r in bad]}")
    if writes:
        replace_all(writes[0][0].sparkSession, writes)


def insecure(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a URL, in any of ``columns``, that isn't blank and isn't https."""
    from ..functions.publication import not_https

    return df.where(F.size(not_https(columns)) > 0)


def write_credits(df: DataFrame, path: str, columns: list[str], urls: list[str]) -> None:
    """The slim table of credits: ``columns`` only, and nothing at all if one of ``urls`` isn't https."""
    write_if_clean(insecure(df.select(*columns), urls), [(df.select(*columns), path)])


def with_optional(spark: SparkSession, primary: str, optional: str | None) -> DataFrame:
    """The rows of a primary table and of an optional one that was asked for; a table that isn't there is an error."""
    out = spark.read.parquet(primary)
    return out if optional is None else out.unionByName(spark.read.parquet(optional), allowMissingColumns=True)


def photo_files(paths: DataFrame) -> DataFrame:
    """``path, meta, unverified, order`` of the photo tables among CSV ``path``s, in reading order.

    Left out are names that begin with an underscore, summaries, and files that
    a ``_v2`` beside them or elsewhere supersedes. Side tables come as ``meta``.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = paths.select("path", name.alias("name"), F.regexp_replace(name, r"\.csv$", "").alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent")).where(F.endswith("path", F.lit(".csv")))
    newer = rows.where(F.endswith("stem", F.lit("_v2"))).select(F.regexp_replace("stem", "_v2$", "").alias("stem")).distinct()
    meta = F.endswith(F.col("name"), F.lit("_meta.csv"))
    kept = rows.where(~F.startswith("name", F.lit("_")) & ~F.contains("name", F.lit(SUMMARY)))
    photos = kept.where(~meta).join(newer, "stem", "left_anti").withColumn("meta", F.lit(False))
    all_files = photos.unionByName(kept.where(meta).withColumn("meta", F.lit(True)))
    flag = lambda c: c.cast("int")
    unverified = F.contains("stem", F.lit(UNVERIFIED))
    order = F.struct(flag(unverified), flag(F.col("parent") == "df20"), flag(F.contains("stem", F.lit("_by_nc"))), F.col("path"))
    n = F.row_number().over(Window.partitionBy("meta").orderBy(order))  # a row per file
    return all_files.select("path", "meta", unverified.alias("unverified"), n.cast("long").alias("order"))


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """The last entry of each key of an append-only table; ``order`` puts the newest first."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


class UnreadableJournal(ValueError):
    """A journal with lines that aren't records; they are kept in a backup."""


def read_journal(spark: SparkSession, path: str, schema: str, key: str, backup: str) -> DataFrame:
    """The records of a journal that have a key. Unreadable lines are written to ``backup``, each content once, and fail the read."""
    good, bad = read_jsonl_lenient(spark, path, schema)
    if bad.limit(1).count():
        bad.select(F.sha2("line", 256).alias("digest"), "line").dropDuplicates(["digest"]).write.mode("overwrite").parquet(backup)
        raise UnreadableJournal(f"{path}: lines kept in {backup}")
    return good.where(F.col(key).isNotNull())


def credits_of(lines: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Columns of JSON ``line``s: of each column's names the first whose text isn't blank, else empty."""
    from ..functions.names import first_text

    return lines.where(F.trim("line") != "").select(*[first_text(*[F.get_json_object("line", f"$.{n}") for n in names]).alias(c) for c, names in fields.items()])


def reference_keys(tables: list[DataFrame], url: str) -> DataFrame:
    """The long key set of reference tables with a ``url`` column; a URL that isn't https fails the load."""
    from ..functions.ids import url_tokens
    from ..operators.lookups import merged_keys

    keys = []
    for df in tables:
        bad = insecure(df.select(url), [url]).limit(5).collect()
        if bad:
            raise ValueError(f"not https: {[r[0] for r in bad]}")
        keys.append(df.select(F.explode(url_tokens(F.col(url))).alias("token")).select(F.substring_index("token", ":", 1).alias("kind"), F.expr("substr(token, instr(token, ':') + 1)").alias("key")))
    return merged_keys(keys)


def checked_dimension(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """A dimension whose key is unique and whose ``required`` columns are filled; a fault fails the load."""
    empty = F.lit(False)
    for c in [key, *required]:
        empty = empty | (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).cast("string"), F.lit("twice").alias("fault"))
    faults = df.where(empty).select(F.col(key).cast("string"), F.lit("empty").alias("fault")).unionByName(twice).limit(5).collect()
    if faults:
        raise ValueError(f"faulty rows: {[tuple(r) for r in faults]}")
    return df


def settings(spark: SparkSession, path: str | None, schema: str, key: str, default: list[tuple]) -> DataFrame:
    """Rows of a settings file, the last of a key wins; without a file the default rows."""
    if path is None or not _fs(spark, path)[0].exists(_fs(spark, path)[1]):
        return spark.createDataFrame(default, schema)
    rows = read_jsonl(spark, path, schema).withColumn("_at", F.monotonically_increasing_id())
    return latest(rows, key, F.desc("_at")).drop("_at")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, digest``: SHA-256 of the bytes of each file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("digest"))
