"""Rows of a dataset from raw records of three kinds, in one pass: remote photos, the restricted set, and local photos.

Records are JSON of unknown shape; a cell is its text, trimmed. What can be
said once is computed as a column of its own, stage by stage, and licences are
judged once for each distinct pair of text and URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import licences, names, publication, urls, variants
from .lookups import alias_lookup

#: Cells that are read, confidences that need a status, confidences that leave a row unverified, and the restricted set's note.
CELLS = (
    "species", "license", "license_url", "author", "image_url", "source_url", "id_confidence", "identificationVerificationStatus", "inat_observer", "inat_photo_id",
    "inat_observation_id", "mo_observation_id", "commons_file", "df20_name_used", "photographer_rightsHolder", "licence_note", "observationID", "gbifID", "ImageUniqueID",
    "df20_image_path", "original_split", "df24_split", "date", "event_date", "countryCode", "country", "decimal_latitude", "decimal_longitude",
)
STATUS_NEEDED = ("gbif_no_status", "gbif_not_validated")
UNVERIFIED = ("gbif_not_validated", "commons_category")
RESTRICTED_NOTE = "DF20 training-only; no per-image licence"
#: What a row takes over from the taxon it is mapped to.
TARGET = ("class_id", "taxon_name", "held_out_taxon", "toxic", "probe", "genus_relation")


def licences_judged(df: DataFrame, text: str, url: str) -> DataFrame:
    """Adds ``licence_reason`` (empty if the licence will do) and ``licence_id``, found once for each distinct pair."""
    pairs = df.select(F.col(text).alias("_t"), F.col(url).alias("_u")).distinct()
    told = pairs.select("_t", "_u", licences.photo_decision(F.col("_t"), F.col("_u")).alias("licence_reason"), licences.parsed(F.col("_t"), F.col("_u")).alias("licence_id"))
    return df.join(told, F.col(text).eqNullSafe(F.col("_t")) & F.col(url).eqNullSafe(F.col("_u"))).drop("_t", "_u")


def _squeezed(text: Column) -> Column:
    return variants.stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def _found(url: str, pattern: str) -> Column:
    return F.regexp_extract(F.col(url), pattern, 1)


def constructed(df: DataFrame, taxa: DataFrame, aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each of ``df(order, kind, raw, flagged, staged)`` with its ``reason``, null for a good one.

    ``kind`` is ``photo``, ``restricted`` or ``local``; ``flagged`` marks
    records of an unverified file, ``staged`` is the place of a local copy.
    Names are looked up in ``taxa(key, id, priority)`` or through
    ``aliases(key, target)``; ``targets`` has the columns of TARGET by ``id``.
    A bad row holds its reason and, if it failed on its status, its class; all
    else is null. Rules apply in this order: readable, mapped, licence,
    author, https URLs, status.
    """
    v, col = F.col("_v"), F.col
    read = df.select("order", "kind", "flagged", "staged", F.try_parse_json("raw").alias("_v"))
    cells = read.select(
        "order", "kind", "flagged", "staged", variants.is_object(v).alias("readable"),
        *[F.coalesce(variants.stripped(F.try_variant_get(v, f"$.{c}", "string")), F.lit("")).alias(f"c_{c}") for c in CELLS],
    )
    restricted, local, photo = col("kind") == "restricted", col("kind") == "local", col("kind") == "photo"
    named = cells.withColumns({
        "species": F.when(restricted, names.first_text(col("c_species"), col("c_df20_name_used"))).otherwise(col("c_species")),
        "other": F.when(restricted, col("c_df20_name_used")).otherwise(""),
        "author": _squeezed(F.when(restricted, names.first_text(col("c_photographer_rightsHolder"), col("c_author"))).otherwise(col("c_author"))),
        "image_url": F.when(photo, urls.force_https(col("c_image_url"))).when(local, col("c_image_url")).otherwise(""),
        "source_url": F.when(restricted, "").otherwise(urls.force_https(col("c_source_url"))),
    })
    once = alias_lookup(named, "species", taxa, aliases).withColumnRenamed("id", "_first")
    mapped = alias_lookup(once, "other", taxa, aliases).withColumn("id", F.coalesce("_first", "id")).drop("_first")
    judged = licences_judged(mapped.join(targets.select("id", *TARGET), "id", "left"), "c_license", "c_license_url")

    confidence, status = col("c_id_confidence"), col("c_identificationVerificationStatus")
    staged = judged.withColumns({
        "_needs": photo & confidence.isin(*STATUS_NEEDED), "_status": licences.status_rejection(status),
        "inat_photo_id": F.when(~restricted, names.first_text(col("c_inat_photo_id"), _found("image_url", r"(?i)/photos/([0-9]+)"))).otherwise(""),
        "inat_observation_id": F.when(~restricted, names.first_text(col("c_inat_observation_id"), _found("source_url", r"(?i)inaturalist\.org/observations/([0-9]+)"), _found("image_url", r"(?i)inaturalist\.org/observations/([0-9]+)"))).otherwise(""),
        "gbif_id": F.when(restricted, col("c_gbifID")).otherwise(_found("source_url", r"(?i)gbif\.org/occurrence/([0-9]+)")),
        "df20_observation_id": F.when(restricted, col("c_observationID")).otherwise(""), "df20_image_id": F.when(restricted, col("c_ImageUniqueID")).otherwise(""),
        "mo_observation_id": F.when(restricted, "").otherwise(col("c_mo_observation_id")), "commons_file": F.when(restricted, "").otherwise(col("c_commons_file")),
        "inat_observer": F.when(restricted, "").otherwise(col("c_inat_observer")),
        "image_key": F.when(photo, urls.canonical_image_url(col("image_url"))).when(local, F.concat(F.lit("local:"), "staged")).otherwise(""),
    })
    bad_url = (photo | (local & (col("image_url") != ""))) & ~publication.https(col("image_url")) | ~restricted & (col("source_url") != "") & ~publication.https(col("source_url"))
    on_status = F.when(col("_needs"), F.nullif("_status", F.lit(""))).when((photo | restricted) & (col("_status") == "identification_unverified"), col("_status"))
    reason = F.coalesce(
        F.when(~col("readable"), "unreadable"), F.when(col("id").isNull(), "unmapped"), F.when(~restricted, F.nullif("licence_reason", F.lit(""))),
        F.when(col("author") == "", "author"), F.when(bad_url, "url"), on_status,
    )
    bare = col("_needs") & (confidence == "gbif_not_validated") & (status == "")
    unverified = F.when(restricted, False).when(col("_needs"), col("flagged") | bare).when(photo, col("flagged") | confidence.isin(*UNVERIFIED)).otherwise(confidence.isin(*UNVERIFIED))
    told = staged.withColumns({
        "reason": reason, "unverified": unverified, "photo_id": names.first_text(col("inat_photo_id"), col("commons_file"), col("df20_image_id")),
        "verification": F.when(bare, "gbif_not_validated").when(col("_needs") & ~unverified, "kept").otherwise(""),
    })
    keyed = told.withColumn(
        "occurrence_key",
        names.occurrence_key(col("image_key"), col("order"), inat=col("inat_observation_id"), mo=col("mo_observation_id"), df20=col("df20_observation_id"), gbif=col("gbif_id"), photo=col("photo_id")),
    )
    own = F.substr(col("occurrence_key"), F.instr("occurrence_key", ":") + 1)
    only = lambda test, c: F.when(test, c).otherwise("")
    values = {
        "source": names.dataset_name(restricted, col("commons_file"), col("gbif_id"), F.concat("inat_photo_id", "inat_observation_id"), col("source_url"), col("image_url")),
        **{c: col(c) for c in TARGET if c != "class_id"}, "queried_name": col("taxon_name"), "species": col("species"), "image_url": col("image_url"), "source_url": col("source_url"),
        "creator": col("author"), "author": col("author"), "license": F.when(restricted, names.first_text(col("c_licence_note"), F.lit(RESTRICTED_NOTE))).otherwise(col("c_license")),
        "license_url": only(~restricted, col("c_license_url")), "license_normalized": F.when(restricted, "df20").otherwise(col("licence_id")),
        "usage": F.when(restricted, "training_only").otherwise(licences.usage(col("licence_id"))), "unverified": col("unverified"), "id_confidence": only(~restricted, confidence),
        "identification_status": only(~local, status), "recorded_by": names.first_text(col("inat_observer"), col("author")),
        "collector_key": names.collector_key(col("inat_observer"), col("author")), "occurrence_key": col("occurrence_key"),
        "observation_id": F.when(restricted, names.first_text(col("df20_observation_id"), own)).otherwise(own), "downloaded": local, "file": only(local, F.coalesce("staged", F.lit(""))),
        "decimal_latitude": F.when(local, names.finite(col("c_decimal_latitude"))), "decimal_longitude": F.when(local, names.finite(col("c_decimal_longitude"))),
        "event_date": F.when(restricted, col("c_date")).when(local, col("c_event_date")).otherwise(""), "country": F.when(restricted, col("c_countryCode")).when(local, _squeezed(col("c_country"))).otherwise(""),
        "original_split": only(restricted, col("c_original_split")), "df24_split": only(restricted, col("c_df24_split")), "df20_image_path": only(restricted, col("c_df20_image_path")),
        "verification": col("verification"), "image_key": col("image_key"),
        **{c: col(c) for c in ("inat_observer", "inat_photo_id", "inat_observation_id", "mo_observation_id", "commons_file", "gbif_id", "df20_observation_id", "df20_image_id", "photo_id")},
    }
    good = col("reason").isNull()
    held = F.when(good | col("reason").startswith("identification"), col("class_id"))
    return keyed.select("order", "kind", "reason", held.alias("class_id"), *[F.when(good, c).alias(n) for n, c in values.items()])
