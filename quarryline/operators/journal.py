"""A keyed journal kept as a table: upsert, update, delete, retention, lenient reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, variants

#: The texts that older records hold in place of a decision.
OLD_TEXTS = ("speciesId", "speciesNamePl", "speciesNameLatin")


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates replace rows of the same key; rows without a key are no updates."""
    new = updates.where(F.col(key).isNotNull())
    return new.unionByName(base.join(new.select(key).distinct(), key, "left_anti"))


def with_note(df: DataFrame, key: str, value, column: str, note: str | None) -> DataFrame:
    """Sets one column of one key; a blank note clears it."""
    text = None if note is None or not note.strip() else note.strip()
    return df.withColumn(column, F.when(F.col(key) == value, F.lit(text)).otherwise(F.col(column)))


def without(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def newest(df: DataFrame, group: list[str], n: int, protected: Column, *order) -> DataFrame:
    """The ``n`` newest rows of a group; a protected row counts as newest."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.coalesce(protected, F.lit(False))), *order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sanitised(df: DataFrame, json: str, schema: str, key: str) -> DataFrame:
    """Fields of a JSON column; what doesn't parse is null, rows without a key go."""
    parsed = df.withColumn("_j", F.from_json(json, schema, {"mode": "PERMISSIVE"})).select(*[c for c in df.columns if c != json], "_j.*")
    return parsed.where(F.col(key).isNotNull())


def recovered(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Records of unknown shape as typed rows: ``keep`` and the fields of a sighting.

    What isn't an object with a text ``id`` goes. Each field is taken by its
    own type, so a number in quotes is no number. A decision is ``rejected``
    with a known reason, ``candidates`` with the whole ones of its list and
    its known warnings, or ``legacy``; anything else is ``unavailable``. Where
    a decision is missing or says nothing, the fields that older records hold
    in the parent make it ``legacy``.
    """
    v, r = F.col("_v"), "$.recognition"
    parsed = df.select(*keep, F.try_parse_json(raw).alias("_v")).where((variants.kind(v) == "OBJECT") & (F.length(variants.string(v, "$.id")) > 0))
    own = {n: variants.text(v, f"{r}.{n}") for n in OLD_TEXTS} | {"confidence": variants.number(v, f"{r}.confidence")}
    parent = {n: variants.text(v, f"$.{n}") for n in OLD_TEXTS} | {"confidence": variants.number(v, "$.confidence")}
    reason = variants.string(v, f"{r}.reason")
    staged = parsed.withColumns({
        "_said": F.when(variants.kind(variants.at(v, r)) == "OBJECT", variants.string(v, f"{r}.status")),
        "_reason": F.when(reason.isin(*variants.REJECTIONS), reason), "_top": variants.candidates(v, f"{r}.top3"),
        "_warn": F.coalesce(F.filter(F.transform(variants.elements(v, f"{r}.warningReasons"), lambda w: variants.string(w, "$")), lambda w: w.isin(*variants.WARNINGS)), F.array().cast("array<string>")),
        "_own": F.struct(*[c.alias(n) for n, c in own.items()]), "_parent": F.struct(*[c.alias(n) for n, c in parent.items()]),
        "_lat": variants.number(v, "$.latitude"), "_lon": variants.number(v, "$.longitude"), "_photo": F.coalesce(variants.string(v, "$.photoFile"), variants.string(v, "$.photoUri")),
    })
    says = lambda s: F.coalesce(*[F.col(f"{s}.{n}").cast("string") for n in own]).isNotNull()
    status = (
        F.when((F.col("_said") == "rejected") & F.col("_reason").isNotNull(), "rejected").when((F.col("_said") == "candidates") & F.col("_top").isNotNull(), "candidates")
        .when((F.col("_said") == "legacy") | says("_parent"), "legacy").otherwise("unavailable")
    )
    told = staged.withColumn("status", status)
    is_ = lambda s: F.col("status") == s
    old = F.when(is_("legacy"), F.when((F.col("_said") == "legacy") & says("_own"), F.col("_own")).otherwise(F.col("_parent")))
    placed = F.coalesce(F.abs("_lat") <= 90, F.lit(False)) & F.coalesce(F.abs("_lon") <= 180, F.lit(False))
    return told.withColumn("_old", old).select(
        *keep, variants.string(v, "$.id").alias("id"), F.coalesce(variants.number(v, "$.timestamp"), F.lit(0.0)).alias("timestamp"), "status", F.when(is_("rejected"), F.col("_reason")).alias("reason"),
        F.when(is_("candidates"), F.col("_top")).alias("top3"), F.when(is_("candidates"), variants.true(v, f"{r}.expertVerificationRequired") | (F.size("_warn") > 0)).alias("verify"),
        F.when(is_("candidates"), F.col("_warn")).alias("warnings"), *[F.col(f"_old.{n}").alias(n) for n in own],
        names.photo_name(F.col("_photo")).alias("photo"), F.when(placed, F.col("_lat")).alias("latitude"), F.when(placed, F.col("_lon")).alias("longitude"),
        F.nullif(variants.stripped(variants.string(v, "$.notes")), F.lit("")).alias("notes"),
    )
