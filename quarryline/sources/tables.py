"""Folders of CSV tables: which to read, in which order, what their headers say, and reference sets named in several places."""

from __future__ import annotations

import atexit
import json
import os
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..functions.urls import canonical_url
from ..operators.graph import ready_checkpoints
from ..operators.lookups import merged_keys
from ..operators.ordering import marked_rows, running_sums
from .records import _fs, photo_files

# The folder of the restricted set, and the columns that give its tables away.
RESTRICTED_FOLDER, RESTRICTED_COLUMNS = "df20", (("df20_image_path",), ("observationID", "licence_note"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one of ``spark.checkpoint.dir``, deleted when the driver exits."""
    ready_checkpoints(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            fs, place = _fs(spark, path)
            fs.delete(place, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass

    atexit.register(clean)
    return path


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every CSV file below a folder; no file is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, header``: the first line of each file, as it stands."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_from"), "value").withColumn("_at", F.monotonically_increasing_id())
    return lines.where("_from = 0").groupBy("path").agg(F.min_by("value", "_at").alias("header"))


def read_photo_tables(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """The rows of all photo tables below a folder, and of the side tables with ``meta``, in reading order.

    Adds ``file, meta, unverified, restricted`` and ``order``, from 1 over all
    rows of either kind: by file, then by line. Which files are read and in
    which order is ``photo_files``' choice; a table is restricted by its
    folder or by its header. Cells are trimmed texts taken by name, empty
    where a table lacks a column or a cell. Files are read by their own
    headers: one read for each different header, a task for each file.
    """
    files = photo_files(listed(spark, root))
    chosen = files.collect()  # a row per file, as their listing is on the driver anyway
    if not chosen:
        none = ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([], f"{none}, file string, meta boolean, unverified boolean, restricted boolean, order long")
    head = {r.path: r.header for r in headers(spark, [r.path for r in chosen]).collect()}
    facts, by_header = [], {}
    for r in chosen:
        names = {c.strip().strip('"') for c in (head.get(r.path) or "").lstrip("﻿").split(",")}
        restricted = r.path.rsplit("/", 2)[-2] == RESTRICTED_FOLDER or any(names.issuperset(own) for own in RESTRICTED_COLUMNS)
        facts.append((r.path, r.meta, r.unverified, restricted, r.order))
        by_header.setdefault(head.get(r.path), []).append(r.path)
    parts = []
    for header, paths in by_header.items():
        if header is None:  # an empty file has no rows
            continue
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(paths)
        own = {c.lstrip("﻿").strip(): c for c in raw.columns}
        cells = [F.trim(F.coalesce(F.col(f"`{own[c]}`").cast("string"), F.lit(""))).alias(c) if c in own else F.lit("").alias(c) for c in columns]
        parts.append(raw.select(*cells, F.col("_metadata.file_path").alias("file")))
    rows = marked_rows(reduce(DataFrame.unionByName, parts), "_line")  # a file is read by one task, line by line
    told = spark.createDataFrame(facts, "file string, meta boolean, unverified boolean, restricted boolean, place long")
    placed = rows.join(told, "file").withColumn("one", F.lit(1).cast("long"))
    numbered = running_sums(placed, ["meta"], {"_before": "one"}, "place", "_line")
    return numbered.select(*columns, "file", "meta", "unverified", "restricted", (F.col("_before") + 1).alias("order"))


def reference_paths(spark: SparkSession, explicit: list[str] | None = None, config: str | None = None, variable: str | None = None, environ: Mapping[str, str] | None = None) -> list[str]:
    """Paths of reference tables: from the list ``tables`` of a JSON config, then from an environment variable, then those given.

    Config entries are relative to the config; the variable's are split at the
    system's separator. A path that isn't there is an error.
    """
    paths = []
    if config:
        text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(config).collect())
        told = json.loads(text)
        listed_ = told.get("tables") if isinstance(told, dict) else None
        if not isinstance(listed_, list):
            raise ValueError(f"{config} needs a list of tables")
        paths += [str(p) if str(p).startswith("/") or "://" in str(p) else f"{config.rsplit('/', 1)[0]}/{p}" for p in listed_]
    if variable:
        paths += [p.strip() for p in ((os.environ if environ is None else environ).get(variable) or "").split(os.pathsep) if p.strip()]
    paths += [p.strip() for p in explicit or [] if p.strip()]
    missing = [p for p in paths if not _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    if missing:
        raise ValueError(f"not found: {', '.join(missing)}")
    return paths


def photo_keys(photos: DataFrame, image: str = "image_url", source: str | None = "source_url", inat: str | None = "inaturalist_observation_id", mo: str | None = "mo_observation_id") -> DataFrame:
    """Distinct ``kind, key`` of photos: canonical image URLs, photo ids in them, and observation ids of their own or in their sources.

    A photo without an image URL, and a URL that isn't https, fail the load.
    """
    own = photos.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) if c else F.lit("").alias(n) for n, c in (("image", image), ("source", source), ("inat", inat), ("mo", mo))])
    https = lambda c: F.lower(c).startswith("https://")
    bad = own.where(~https(F.col("image")) | ((F.col("source") != "") & ~https(F.col("source")))).limit(5).collect()
    if bad:
        raise ValueError(f"not https: {[tuple(r)[:2] for r in bad]}")
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), 1)
    one = lambda c: F.array_compact(F.array(clean_id(c)))

    def keys(kind: str, values: Column) -> DataFrame:
        return own.select(F.lit(kind).alias("kind"), F.explode(values).alias("key")).where("key IS NOT NULL AND key <> ''")

    return merged_keys([
        keys("image", F.array(canonical_url(F.col("image")))), keys("photo", found("image", r"(?i)/photos/([0-9]+)")),
        keys("inat_observation", F.concat(found("source", r"(?i)inaturalist\.org/observations/([0-9]+)"), one(F.col("inat")))),
        keys("mo_observation", F.concat(found("source", r"(?i)mushroomobserver\.org/(?:observations/|observer/show_observation/)([0-9]+)"), one(F.col("mo")))),
    ])
