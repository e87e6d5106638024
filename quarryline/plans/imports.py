"""Queries on records of unknown shape: the journal's and the importers'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constructors, journal
from .base import query, values_sql

#: Records by number, ``@`` standing for an id: the present shape, older ones, and damaged ones.
RECORDS = [
    '{"id":"s@","timestamp":@,"recognition":{"status":"candidates","top3":[{"id":"a","namePl":"b","nameLatin":"c","confidence":0.5,"rank":1},{"id":"d","namePl":"e","nameLatin":"f","confidence":"0.4","rank":2},7,null],"warningReasons":["low_confidence","other",3]},"photoFile":"p@.jpg","notes":" kept "}',
    '{"id":"s@","timestamp":"@","recognition":{"status":"rejected","reason":"unclear"},"latitude":50.5,"longitude":14}',
    '{"id":"s@","recognition":{"status":"rejected","reason":"bored"},"speciesId":" x@ ","confidence":1}',
    '{"id":"s@","speciesNamePl":"nazwa","confidence":"high","photoUri":"file:///d/journal-photos/q@.png","latitude":95,"longitude":14}',
    '{"id":"s@","recognition":{"status":"legacy","speciesId":"  "},"speciesNameLatin":"Nomen"}',
    '{"id":"s@","recognition":{"status":"legacy","confidence":0},"speciesId":"parent"}',
    '{"id":@,"recognition":{"status":"rejected","reason":"unclear"}}',
    '{"id":"s@","recognition":{"status":"candidates","top3":"none"},"photoFile":"../p@.jpg"}',
    '{"id":"s@","recognition":[1,2],"notes":4,"photoFile":"a/b/journal-photos/c/d@.jpg"}',
    '{"id":"s@","recognition":{"status":"candidates","top3":[],"expertVerificationRequired":true}}',
    '{"id":"s@","recognition":',
    '["s@"]',
]
TXT = "CASE WHEN json_type(j, '{0}') = 'VARCHAR' THEN nullif(regexp_replace(json_extract_string(j, '{0}'), '^\\s+|\\s+$', '', 'g'), '') END"
NUM = "CASE WHEN json_type(j, '{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(j, '{0}') AS DOUBLE) END"
OLD = {n: TXT for n in ("speciesId", "speciesNamePl", "speciesNameLatin")} | {"confidence": NUM}
PHOTO = "regexp_matches({0}, '^[A-Za-z0-9][A-Za-z0-9_-]*\\.(jpg|png|heic|webp)$')"


@query(
    "journal_recovered",
    f"""WITH t(k, raw) AS (VALUES {values_sql(list(enumerate(RECORDS)))}), w AS (SELECT event_id, replace(raw, '@', CAST(event_id AS VARCHAR)) AS raw FROM events JOIN t ON k = event_id % {len(RECORDS)}),
    v AS (SELECT event_id, CAST(raw AS JSON) AS j FROM w WHERE json_valid(raw)), o AS (SELECT * FROM v WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.id') = 'VARCHAR' AND json_extract_string(j, '$.id') <> ''),
    f AS (SELECT event_id, j, CASE WHEN json_type(j, '$.recognition') = 'OBJECT' THEN json_extract_string(j, '$.recognition.status') END AS said, json_extract_string(j, '$.recognition.reason') AS why,
      {", ".join(f"{e.format('$.recognition.' + n)} AS o{i}, {e.format('$.' + n)} AS p{i}" for i, (n, e) in enumerate(OLD.items()))}, {NUM.format('$.latitude')} AS lat, {NUM.format('$.longitude')} AS lon,
      coalesce(json_extract_string(j, '$.photoFile'), json_extract_string(j, '$.photoUri')) AS file FROM o),
    s AS (SELECT *, coalesce(CAST(o0 AS VARCHAR), o1, o2, CAST(o3 AS VARCHAR)) IS NOT NULL AS own, CASE WHEN said = 'rejected' AND why IN ('not_a_mushroom', 'unknown_mushroom', 'unclear') THEN 'rejected' WHEN said = 'candidates' AND json_type(j, '$.recognition.top3') = 'ARRAY' THEN 'candidates'
      WHEN said = 'legacy' OR coalesce(CAST(p0 AS VARCHAR), p1, p2, CAST(p3 AS VARCHAR)) IS NOT NULL THEN 'legacy' ELSE 'unavailable' END AS status FROM f),
    c AS (SELECT *, [x FOR x IN json_extract(j, '$.recognition.top3[*]') IF json_type(x, '$.id') = 'VARCHAR' AND json_type(x, '$.namePl') = 'VARCHAR' AND json_type(x, '$.nameLatin') = 'VARCHAR' AND json_type(x, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND json_type(x, '$.rank') IN ('DOUBLE', 'UBIGINT', 'BIGINT')] AS top,
      [json_extract_string(x, '$') FOR x IN json_extract(j, '$.recognition.warningReasons[*]') IF json_type(x) = 'VARCHAR' AND json_extract_string(x, '$') IN ('dangerous_genus', 'low_confidence')] AS warn FROM s)
    SELECT event_id, json_extract_string(j, '$.id') AS id, coalesce({NUM.format('$.timestamp')}, 0) AS timestamp, status, CASE WHEN status = 'rejected' THEN why END AS reason,
      CASE WHEN status = 'candidates' THEN array_to_string([json_extract_string(x, '$.id') || '/' || json_extract_string(x, '$.nameLatin') || '/' || CAST(CAST(json_extract(x, '$.confidence') AS DOUBLE) AS VARCHAR) FOR x IN top], ',') END AS top3,
      CASE WHEN status = 'candidates' THEN coalesce(json_extract_string(j, '$.recognition.expertVerificationRequired') = 'true', false) OR coalesce(len(warn), 0) > 0 END AS verify, CASE WHEN status = 'candidates' THEN coalesce(array_to_string(warn, ','), '') END AS warnings,
      {", ".join(f"CASE WHEN status = 'legacy' THEN CASE WHEN said = 'legacy' AND own THEN o{i} ELSE p{i} END END AS {n}" for i, n in enumerate(OLD))},
      CASE WHEN NOT contains(file, '..') THEN CASE WHEN NOT contains(file, '/') THEN CASE WHEN {PHOTO.format('file')} THEN file END WHEN {PHOTO.format("regexp_extract(file, '/journal-photos/(.*)$', 1)")} THEN regexp_extract(file, '/journal-photos/(.*)$', 1) END END AS photo,
      CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN lat END AS latitude, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN lon END AS longitude, {TXT.format('$.notes')} AS notes FROM c""",
)
def journal_recovered(t):
    """A journal of present, older and damaged records as typed rows."""
    shapes = F.array(*map(F.lit, RECORDS))
    raw = F.replace(F.element_at(shapes, (F.col("event_id") % len(RECORDS) + 1).cast("int")), F.lit("@"), F.col("event_id").cast("string"))
    rows = journal.recovered(t.events.select("event_id", raw.alias("raw")), "raw", "event_id")
    top = F.array_join(F.transform("top3", lambda c: F.concat_ws("/", c["id"], c["nameLatin"], c["confidence"].cast("string"))), ",")
    return rows.withColumns({"top3": top, "warnings": F.array_join("warnings", ",")})


BY = "https://creativecommons.org/licenses/by/{}/"
#: Licence text and URL by number, why they fail, and the exact id.
PAIRS = [
    (0, "CC BY 4.0", BY.format("4.0"), "", "cc-by-4.0"), (1, "CC0", "https://creativecommons.org/publicdomain/zero/1.0/", "", "cc0-1.0"),
    (2, "CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/4.0/", "", "cc-by-sa-4.0"), (3, "All rights reserved", BY.format("4.0"), "license", None), (4, "", BY.format("4.0"), "license", None),
    (5, "CC BY", BY.format("4.0"), "", "cc-by-4.0"), (6, "CC BY 3.0", "http://creativecommons.org/licenses/by/3.0/", "license_url_not_https", None), (7, "CC BY 4.0", "", "license_url_empty", None),
    (8, "CC BY 4.0", BY.format("3.0"), "license_url_mismatch", None),
]
TAXA = [("agaric", 1, 1), ("bolete", 2, 1), ("morel", 3, 1), ("agaric", 9, 2)]
SYNONYMS = [("champignon", "agaric"), ("porcino", "bolete"), ("ghost", "nothing")]
TARGETS = [(1, "c1", "Agaricus", False, False, False, "same"), (2, "c2", "Boletus", True, False, False, ""), (3, "c3", "Morchella", False, True, True, "near"), (9, "c9", "Never", False, False, False, "")]
#: Cells as expressions over the orders that read the same in Spark and in DuckDB.
CELLS = {
    "species": "CASE o_custkey % 6 WHEN 0 THEN ' Agaric ' WHEN 1 THEN 'PORCINO' WHEN 2 THEN 'morel' WHEN 3 THEN 'ghost' WHEN 4 THEN '' ELSE 'champignon' END",
    "df20_name_used": "CASE o_custkey % 5 WHEN 0 THEN 'bolete' WHEN 1 THEN 'unheard of' ELSE '' END",
    "author": "CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE 'An' || '  ' || 'Author' || (o_custkey % 40) END", "photographer_rightsHolder": "CASE WHEN o_orderkey % 2 = 0 THEN 'Holder' || (o_custkey % 9) ELSE '' END",
    "image_url": "CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'ftp://x.example/a.jpg' WHEN 2 THEN 'http://static.example/photos/' || o_orderkey || '/m.jpg' ELSE 'https://img.example/' || o_orderkey || '.jpg?s=1' END",
    "source_url": "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://www.gbif.org/occurrence/' || o_orderkey WHEN 2 THEN 'http://www.inaturalist.org/observations/' || o_custkey WHEN 3 THEN 'mailto:x' ELSE 'https://site.example/' || o_orderkey END",
    "id_confidence": "CASE o_orderkey % 5 WHEN 0 THEN 'gbif_no_status' WHEN 1 THEN 'gbif_not_validated' WHEN 2 THEN 'commons_category' ELSE '' END",
    "identificationVerificationStatus": "CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Confident' WHEN 2 THEN 'unverified' ELSE 'needs id' END",
    "inat_observer": "CASE WHEN o_custkey % 3 = 0 THEN 'Obs ' || (o_custkey % 30) ELSE '' END", "inat_photo_id": "CASE WHEN o_orderkey % 17 = 0 THEN '7' || o_orderkey ELSE '' END",
    "inat_observation_id": "''", "mo_observation_id": "CASE WHEN o_orderkey % 19 = 0 THEN '5' || o_orderkey ELSE '' END", "commons_file": "CASE WHEN o_orderkey % 23 = 0 THEN 'File' || o_orderkey ELSE '' END",
    "licence_note": "CASE WHEN o_orderkey % 2 = 0 THEN 'a note' ELSE '' END", "observationID": "CASE WHEN o_orderkey % 3 > 0 THEN 'ob' || o_custkey ELSE '' END", "gbifID": "CASE WHEN o_orderkey % 4 = 0 THEN '9' || o_orderkey ELSE '' END",
    "ImageUniqueID": "CASE WHEN o_orderkey % 8 = 1 THEN 'im' || o_orderkey ELSE '' END", "df20_image_path": "'path/' || o_orderkey", "original_split": "'train'", "df24_split": "''", "date": "'2020-01-0' || (o_orderkey % 9 + 1)",
    "event_date": "'2021'", "countryCode": "'DK'", "country": "' Czech   Republic'", "decimal_latitude": "CASE o_orderkey % 3 WHEN 0 THEN '49.5' WHEN 1 THEN 'north' ELSE '' END", "decimal_longitude": "'14'",
}
KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'restricted' ELSE 'local' END"
C = {n: f"trim({e})" for n, e in CELLS.items()}
SECURE = "regexp_replace({}, '^http:', 'https:')"


@query(
    "constructed_rows",
    f"""WITH pairs(k, license, license_url, licence_reason, licence_id) AS (VALUES {values_sql(PAIRS)}), taxa(key, id, priority) AS (VALUES {values_sql(TAXA)}), aliases(key, target) AS (VALUES {values_sql(SYNONYMS)}),
    targets(id, class_id, taxon_name, held_out_taxon, toxic, probe, genus_relation) AS (VALUES {values_sql(TARGETS)}),
    index AS (SELECT key, arg_min(id, priority) AS id FROM taxa GROUP BY 1), known AS (SELECT * FROM index UNION ALL SELECT a.key, id FROM aliases a JOIN index i ON i.key = a.target),
    a AS (SELECT o_orderkey AS "order", {KIND} AS kind, o_orderkey % 31 <> 0 AS readable, o_custkey % 10 = 0 AS flagged, 'stage/' || o_orderkey || '.jpg' AS staged, license, license_url, licence_reason, licence_id, {", ".join(f'{e} AS "{n}"' for n, e in C.items())} FROM orders JOIN pairs ON k = o_orderkey % {len(PAIRS)}),
    b AS (SELECT *, kind = 'restricted' AS r, kind = 'local' AS l, kind = 'photo' AS p, CASE WHEN kind = 'restricted' AND species = '' THEN df20_name_used ELSE species END AS name,
      regexp_replace(CASE WHEN kind = 'restricted' AND "photographer_rightsHolder" <> '' THEN "photographer_rightsHolder" ELSE author END, '\\s+', ' ', 'g') AS who,
      CASE kind WHEN 'photo' THEN {SECURE.format('image_url')} WHEN 'local' THEN image_url ELSE '' END AS image, CASE WHEN kind = 'restricted' THEN '' ELSE {SECURE.format('source_url')} END AS src FROM a),
    c AS (SELECT b.*, coalesce(x.id, CASE WHEN r THEN y.id END) AS id, p AND id_confidence IN ('gbif_no_status', 'gbif_not_validated') AS needs, lower("identificationVerificationStatus") AS st,
      CASE WHEN r THEN '' WHEN inat_photo_id <> '' THEN inat_photo_id ELSE regexp_extract(image, '/photos/([0-9]+)', 1) END AS ph, CASE WHEN r THEN '' ELSE regexp_extract(src, 'inaturalist\\.org/observations/([0-9]+)', 1) END AS ob,
      CASE WHEN r THEN "gbifID" ELSE regexp_extract(src, 'gbif\\.org/occurrence/([0-9]+)', 1) END AS gb, CASE WHEN r THEN '' ELSE mo_observation_id END AS mo, CASE WHEN r THEN '' ELSE commons_file END AS cf, CASE WHEN r THEN '' ELSE b.inat_observer END AS obs,
      CASE WHEN r THEN "observationID" ELSE '' END AS dob, CASE WHEN r THEN "ImageUniqueID" ELSE '' END AS dim, CASE WHEN p THEN regexp_replace(image, '\\?.*$', '') WHEN l THEN 'local:' || staged ELSE '' END AS ikey
      FROM b LEFT JOIN known x ON x.key = lower(name) LEFT JOIN known y ON y.key = lower(df20_name_used)),
    d AS (SELECT c.*, t.* EXCLUDE id, coalesce(nullif(ph, ''), nullif(cf, ''), dim) AS pid, needs AND id_confidence = 'gbif_not_validated' AND st = '' AS bare,
      CASE WHEN NOT readable THEN 'unreadable' WHEN c.id IS NULL THEN 'unmapped' WHEN NOT r AND licence_reason <> '' THEN licence_reason WHEN who IN ('', ' ') THEN 'author'
        WHEN (p OR l AND image <> '') AND NOT starts_with(image, 'https:') OR NOT r AND src <> '' AND NOT starts_with(src, 'https:') THEN 'url'
        WHEN needs AND st = 'unverified' OR (p OR r) AND NOT needs AND st = 'unverified' THEN 'identification_unverified' WHEN needs AND st = 'needs id' THEN 'identification_not_allowlisted' END AS reason FROM c LEFT JOIN targets t ON t.id = c.id),
    e AS (SELECT *, CASE WHEN r THEN false WHEN needs THEN flagged OR bare WHEN p THEN flagged OR id_confidence = 'commons_category' ELSE id_confidence IN ('gbif_not_validated', 'commons_category') END AS unv,
      coalesce('inat:' || nullif(ob, ''), 'mo:' || nullif(mo, ''), 'df20:' || nullif(dob, ''), 'gbif:' || nullif(gb, ''), 'photo:' || nullif(pid, ''), 'photo:' || nullif(ikey, ''), 'photo:' || "order") AS okey FROM d),
    f AS (SELECT "order", kind, reason, CASE WHEN reason IS NULL OR starts_with(reason, 'identification') THEN class_id END AS class_id, unnest(CASE WHEN reason IS NULL THEN {{
      'source': CASE WHEN r THEN 'df20' WHEN cf <> '' THEN 'commons' WHEN gb <> '' THEN 'gbif' WHEN ph <> '' OR ob <> '' THEN 'inat' ELSE 'external' END,
      'taxon_name': taxon_name, 'held_out_taxon': held_out_taxon, 'toxic': toxic, 'probe': probe, 'genus_relation': genus_relation, 'queried_name': taxon_name, 'species': name, 'image_url': image, 'source_url': src, 'creator': who, 'author': who,
      'license': CASE WHEN NOT r THEN license WHEN licence_note <> '' THEN licence_note ELSE '{constructors.RESTRICTED_NOTE}' END, 'license_url': CASE WHEN r THEN '' ELSE license_url END, 'license_normalized': CASE WHEN r THEN 'df20' ELSE licence_id END,
      'usage': CASE WHEN r OR licence_id = 'cc-by-sa-4.0' THEN 'training_only' ELSE 'publishable' END, 'unverified': unv, 'id_confidence': CASE WHEN r THEN '' ELSE id_confidence END,
      'identification_status': CASE WHEN l THEN '' ELSE "identificationVerificationStatus" END, 'recorded_by': CASE WHEN obs <> '' THEN obs ELSE who END, 'collector_key': CASE WHEN obs <> '' THEN 'inat:' || lower(obs) ELSE 'author:' || lower(who) END,
      'occurrence_key': okey, 'observation_id': CASE WHEN r AND dob <> '' THEN dob ELSE regexp_replace(okey, '^[^:]*:', '') END, 'downloaded': l, 'file': CASE WHEN l THEN staged ELSE '' END,
      'decimal_latitude': CASE WHEN l THEN TRY_CAST(decimal_latitude AS DOUBLE) END, 'decimal_longitude': CASE WHEN l THEN TRY_CAST(decimal_longitude AS DOUBLE) END, 'event_date': CASE WHEN r THEN "date" WHEN l THEN event_date ELSE '' END,
      'country': CASE WHEN r THEN "countryCode" WHEN l THEN regexp_replace(country, '\\s+', ' ', 'g') ELSE '' END, 'original_split': CASE WHEN r THEN original_split ELSE '' END, 'df24_split': CASE WHEN r THEN df24_split ELSE '' END,
      'df20_image_path': CASE WHEN r THEN df20_image_path ELSE '' END, 'verification': CASE WHEN bare THEN 'gbif_not_validated' WHEN needs AND NOT unv THEN 'kept' ELSE '' END, 'image_key': ikey, 'inat_observer': obs, 'inat_photo_id': ph,
      'inat_observation_id': ob, 'mo_observation_id': mo, 'commons_file': cf, 'gbif_id': gb, 'df20_observation_id': dob, 'df20_image_id': dim, 'photo_id': pid }} END) FROM e)
    SELECT * FROM f""",
)
def constructed_rows(t):
    """The orders as raw JSON records of three kinds, some damaged, and the rows that are made of them."""
    row = F.col("o_orderkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in PAIRS]), (row % len(PAIRS) + 1).cast("int"))
    record = F.to_json(F.struct(pick(1).alias("license"), pick(2).alias("license_url"), *[F.expr(e).alias(n) for n, e in CELLS.items()]))
    raw = F.when(row % 31 == 0, F.concat(F.lit("["), record)).otherwise(record)
    rows = t.orders.select(row.alias("order"), F.expr(KIND).alias("kind"), raw.alias("raw"), (F.col("o_custkey") % 10 == 0).alias("flagged"), F.concat(F.lit("stage/"), row, F.lit(".jpg")).alias("staged"))
    taxa, aliases = t.values(TAXA, "key string, id long, priority int"), t.values(SYNONYMS, "key string, target string")
    targets = t.values(TARGETS, "id long, class_id string, taxon_name string, held_out_taxon boolean, toxic boolean, probe boolean, genus_relation string")
    return constructors.constructed(rows, taxa, aliases, targets)


#: Files that the orders are dealt to, and their place in reading order: photo tables first, then the side table's own order.
FILES = [
    ("plain/a_first", 1, False, False, False), ("plain/b_by_nc", 2, False, False, False), ("df20/c_list", 3, False, False, True), ("plain/d_niezweryfikowane", 5, False, True, False),
    ("plain/e_old", None, False, False, False), ("plain/e_old_v2", 1.5, False, False, False), ("plain/f_meta", 1, True, False, False), ("plain/_g_hidden", None, False, False, False), ("plain/h_grupa_toksyczna", None, False, False, False),
]


@query(
    "photo_tables",
    f"""WITH f(k, stem, place, meta, unverified, restricted) AS (VALUES {values_sql([(i, *x) for i, x in enumerate(FILES)])})
    SELECT stem || '.csv' AS file, meta, unverified, restricted, CAST(row_number() OVER (PARTITION BY meta ORDER BY place, o_orderkey) AS BIGINT) AS "order", CAST(o_orderkey AS VARCHAR) AS species, CASE WHEN k = 2 THEN '' ELSE 'say "' || o_custkey || '",' || chr(10) || 'twice' END AS author, CASE WHEN k = 2 THEN 'note' ELSE '' END AS licence_note
    FROM orders JOIN f ON k = o_orderkey % {len(FILES)} WHERE place IS NOT NULL""",
)
def photo_tables(t):
    """The orders written as CSV files of different headers and names, with quotes and line ends in cells, and read as one folder."""
    from ..sources import records, tables

    root = tables.scratch_path(t.spark, "photo-tables")
    stems = F.array(*[F.lit(x[0].replace("/", "~")) for x in FILES])
    row = F.col("o_orderkey")
    rows = t.orders.select(row, F.element_at(stems, (row % len(FILES) + 1).cast("int")).alias("stem"), row.cast("string").alias("species"), F.concat(F.lit('say "'), "o_custkey", F.lit('",\ntwice')).alias("author"), F.lit("note").alias("licence_note"))
    dealt = rows.repartition("stem").sortWithinPartitions("stem", "o_orderkey")
    own = {False: ["species", "author"], True: ["licence_note", "species"]}
    for restricted, columns in own.items():
        chosen = dealt.where(F.col("stem").startswith("df20") == restricted).select("stem", *columns)
        chosen.write.mode("append").option("header", True).option("quote", '"').option("escape", '"').partitionBy("stem").csv(f"{root}-parts")
    fs, _ = records._fs(t.spark, root)
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for status in fs.globStatus(path(f"{root}-parts/stem=*/part-*.csv")):  # a file for each name
        folder, stem = status.getPath().getParent().getName().removeprefix("stem=").split("~")
        fs.mkdirs(path(f"{root}/{folder}"))
        fs.rename(status.getPath(), path(f"{root}/{folder}/{stem}.csv"))
    fs.delete(path(f"{root}-parts"), True)
    out = tables.read_photo_tables(t.spark, root, ["species", "author", "licence_note"])
    return out.withColumn("file", F.regexp_extract("file", r"([^/]+/[^/]+)$", 1))


@query(
    "photo_keys",
    """WITH p AS (SELECT 'https://static.example/photos/' || (o_orderkey % 500) || '/m.jpg' AS image, CASE o_orderkey % 3 WHEN 0 THEN 'https://www.inaturalist.org/observations/' || o_custkey WHEN 1 THEN '' ELSE 'https://site.example/' || o_orderkey END AS source, CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 7 = 1 THEN ' ' || o_custkey ELSE NULL END AS own FROM orders)
    SELECT 'image' AS kind, image AS key FROM p UNION SELECT 'photo', regexp_extract(image, '/photos/([0-9]+)', 1) FROM p UNION SELECT 'inat_observation', regexp_extract(source, '/observations/([0-9]+)', 1) FROM p WHERE contains(source, 'inaturalist') UNION SELECT 'mo_observation', trim(own) FROM p WHERE trim(own) <> 'none'""",
)
def photo_keys(t):
    """Keys of a reference set of photos by image, photo id and the ids of two kinds of observation."""
    from ..sources import tables

    row, who = F.col("o_orderkey"), F.col("o_custkey")
    source = F.when(row % 3 == 0, F.concat(F.lit("https://www.inaturalist.org/observations/"), who)).when(row % 3 == 1, "").otherwise(F.concat(F.lit("https://site.example/"), row))
    photos = t.orders.select(F.concat(F.lit("https://static.example/photos/"), row % 500, F.lit("/m.jpg")).alias("image_url"), source.alias("source_url"), F.when(row % 7 == 0, "none").when(row % 7 == 1, F.concat(F.lit(" "), who)).alias("mo_observation_id"))
    return tables.photo_keys(photos, inat=None)


@query(
    "journal_stream",
    """WITH e AS (SELECT user_id, event_id, 'i' || (event_id % 40) AS id, event_type = 'error' AS gone FROM events WHERE event_id % 23 <> 0),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY event_id DESC) AS k FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, id) AS r FROM l WHERE k = 1)
    SELECT CAST(user_id AS VARCHAR) AS owner, id, event_id AS seq, 'p' || event_id AS payload FROM n WHERE r <= 6 AND NOT gone""",
)
def journal_stream(t):
    """The events as lines of a journal, some damaged, kept by a stream in several micro-batches: the six newest ids of each user."""
    from ..sources import tables
    from ..streaming import journal as stream

    root = tables.scratch_path(t.spark, "journal-stream")
    number = F.col("event_id")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("owner"), F.concat(F.lit("i"), number % 40).alias("id"), number.alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.concat(F.lit("p"), number).alias("payload")))
    t.events.select(F.when(number % 23 == 0, F.concat(F.lit("!"), line)).otherwise(line).alias("value")).repartition(4, "value").write.text(f"{root}/lines")
    lines = t.spark.readStream.option("maxFilesPerTrigger", 2).text(f"{root}/lines")
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for q in stream.keep(lines, root, 6):
            q.awaitTermination()
    finally:
        if before is None:
            t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return stream.kept(t.spark, root)
