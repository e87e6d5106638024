"""Queries on duplicates: identities of two kinds, and near-duplicates by either of two hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import licences
from ..operators import dedup, identity
from .base import query, values_sql
from .records import image_hashes

#: Licences of the rows by number, and their strictness.
LICENCES = [(0, "cc-by-4.0", 2), (1, "cc0-1.0", 1), (2, "cc-by-sa-4.0", 3), (3, "cc-by-nc-2.0", 3), (4, None, 0)]

# Of each customer's orders, some share photo keys, some of which chain two others; some have only
# observation keys, some both. Labels differ now and then, so that a chain of photo keys carries a
# conflict on and a chain of observation keys must not.
IDENTITY = f"""WITH RECURSIVE l(k, id, rank) AS (VALUES {values_sql(LICENCES)}),
m AS (SELECT o_orderkey AS row, o_custkey AS c, rank,
  CASE WHEN o_orderkey % 5 < 2 THEN [] WHEN o_orderkey % 11 = 0 THEN ['p' || (o_orderkey % 4), 'p' || ((o_orderkey + 1) % 4)] ELSE ['p' || (o_orderkey % 4)] END AS photos,
  CASE WHEN o_orderkey % 7 = 0 THEN [] WHEN o_orderkey % 13 < 4 THEN ['o' || (o_orderkey % 6), 'o' || ((o_orderkey + 1) % 6)] ELSE ['o' || (o_orderkey % 6)] END AS observations,
  'c' || (o_custkey % 20) || CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE '' END AS label FROM orders JOIN l ON l.k = o_orderkey % 5),
ph AS (SELECT row, c, label, unnest(photos) AS key FROM m), ob AS (SELECT row, c, label, unnest(observations) AS key FROM m),
reach AS (SELECT c, key AS a, key AS b FROM ph UNION SELECT r.c, r.a, y.key FROM reach r JOIN ph x ON x.c = r.c AND x.key = r.b JOIN ph y ON y.row = x.row),
part AS (SELECT c, a AS key, min(b) AS part FROM reach GROUP BY 1, 2),
pl AS (SELECT c, part, list_sort(list(DISTINCT label)) AS labels FROM ph JOIN part USING (c, key) GROUP BY 1, 2 HAVING count(DISTINCT label) > 1),
ol AS (SELECT c, key, list_sort(list(DISTINCT label)) AS labels FROM ob GROUP BY 1, 2 HAVING count(DISTINCT label) > 1),
bad AS (SELECT row, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ',') AS labels FROM (
  SELECT row, labels FROM ph JOIN part USING (c, key) JOIN pl USING (c, part) UNION SELECT row, labels FROM ob JOIN ol USING (c, key)) GROUP BY 1),
rest AS (SELECT m.* FROM m LEFT JOIN bad USING (row) WHERE bad.row IS NULL),
ph2 AS (SELECT row, c, unnest(photos) AS key FROM rest),
reach2 AS (SELECT c, key AS a, key AS b FROM ph2 UNION SELECT r.c, r.a, y.key FROM reach2 r JOIN ph2 x ON x.c = r.c AND x.key = r.b JOIN ph2 y ON y.row = x.row),
part2 AS (SELECT c, a AS key, min(b) AS part FROM reach2 GROUP BY 1, 2),
whole AS (SELECT row, c, rank, coalesce(p, 'row' || row) AS part FROM (SELECT r.row, r.c, r.rank, min(part) AS p FROM rest r LEFT JOIN ph2 p ON p.row = r.row LEFT JOIN part2 q ON q.c = p.c AND q.key = p.key GROUP BY r.row, r.c, r.rank)),
one AS (SELECT row, c, CASE WHEN row_number() OVER w = 1 THEN 'kept' WHEN rank < max(rank) OVER (PARTITION BY c, part) THEN 'looser_license' ELSE 'duplicate_photo_id' END AS verdict FROM whole WINDOW w AS (PARTITION BY c, part ORDER BY rank DESC, row)),
win AS (SELECT row, rest.c, photos, observations, row_number() OVER (PARTITION BY rest.c ORDER BY row) AS n FROM rest JOIN one USING (row) WHERE verdict = 'kept'),
walk AS (SELECT row, c, n, true AS stays, observations AS seen FROM win WHERE n = 1
  UNION ALL SELECT w.row, w.c, w.n, len(w.photos) > 0 OR NOT list_has_any(k.seen, w.observations), CASE WHEN len(w.photos) > 0 OR NOT list_has_any(k.seen, w.observations) THEN list_concat(k.seen, w.observations) ELSE k.seen END
  FROM walk k JOIN win w ON w.c = k.c AND w.n = k.n + 1)
SELECT m.row, CASE WHEN bad.row IS NOT NULL THEN 'class_conflict' WHEN NOT stays THEN 'duplicate_observation_id' ELSE verdict END AS verdict, bad.labels
FROM m LEFT JOIN bad USING (row) LEFT JOIN one USING (row) LEFT JOIN walk USING (row)"""


@query("identity_resolution", IDENTITY)
def identity_resolution(t):
    """Conflicts, strictest copies and repeated observations of each customer's orders, in the order of their keys."""
    row, c = F.col("o_orderkey"), F.col("o_custkey")
    key = lambda kind, n: F.concat(F.lit(kind), c, F.lit(":"), n)
    none = F.array().cast("array<string>")
    photos = F.when(row % 5 < 2, none).when(row % 11 == 0, F.array(key("p", row % 4), key("p", (row + 1) % 4))).otherwise(F.array(key("p", row % 4)))
    seen = F.when(row % 7 == 0, none).when(row % 13 < 4, F.array(key("o", row % 6), key("o", (row + 1) % 6))).otherwise(F.array(key("o", row % 6)))
    label = F.concat(F.lit("c"), c % 20, F.when(row % 29 == 0, "x").otherwise(""))
    licence = F.element_at(F.array(*[F.lit(x) for _, x, _ in LICENCES]), (row % 5 + 1).cast("int"))
    rows = t.orders.select(row.alias("row"), photos.alias("photos"), seen.alias("observations"), label.alias("label"), licences.rank(licence).alias("rank"))
    return identity.resolved(rows, "row", "photos", "observations", "label", "rank").withColumn("labels", F.array_join("labels", ","))


def _signs(bits: int):
    """Signs of the first numbers of a vector, and whether each is above the next, as bits: null now and then."""
    bit = lambda test: sum((F.when(test(i), 1 << i).otherwise(0) for i in range(bits)), F.lit(0).cast("long"))
    e = F.col("embedding")
    own, rising = bit(lambda i: e[i] > 0), bit(lambda i: e[i] > e[i + 1])
    return F.when(F.col("vec_id") % 7 != 0, own), F.when(F.col("vec_id") % 5 != 0, rising)


def _signs_sql(bits: int) -> str:
    own = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(bits))
    rising = " + ".join(f"CASE WHEN embedding[{i + 1}] > embedding[{i + 2}] THEN {1 << i} ELSE 0 END" for i in range(bits))
    return f"CASE WHEN vec_id % 7 <> 0 THEN {own} END AS a, CASE WHEN vec_id % 5 <> 0 THEN {rising} END AS b"


@query(
    "near_dup_either",
    f"""WITH RECURSIVE h AS (SELECT vec_id, label % 4 AS bucket, {_signs_sql(12)}, (vec_id * 7919) % 13 AS size FROM embeddings),
    o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY size DESC, vec_id) AS n FROM h WHERE a IS NOT NULL OR b IS NOT NULL),
    s AS (SELECT bucket, n, vec_id, CAST(NULL AS BIGINT) AS near, [{{'v': vec_id, 'a': a, 'b': b}}] AS kept FROM o WHERE n = 1
      UNION ALL SELECT bucket, n, vec_id, near, CASE WHEN near IS NULL THEN list_append(kept, {{'v': vec_id, 'a': a, 'b': b}}) ELSE kept END FROM (
        SELECT o.bucket, o.n, o.vec_id, o.a, o.b, s.kept, [k.v FOR k IN s.kept IF coalesce(bit_count(xor(k.a, o.a)) <= 2, false) OR coalesce(bit_count(xor(k.b, o.b)) <= 2, false)][1] AS near
        FROM s JOIN o ON o.bucket = s.bucket AND o.n = s.n + 1))
    SELECT vec_id AS row, near FROM s WHERE near IS NOT NULL""",
)
def near_dup_either(t):
    """Vectors dropped for an earlier kept one within two bits on either hash; larger ones first, some without one hash or both."""
    own, rising = _signs(12)
    rows = t.embeddings.select("vec_id", (F.col("label") % 4).alias("bucket"), own.alias("a"), rising.alias("b"), (-(F.col("vec_id") * 7919 % 13)).alias("size"))
    return dedup.greedy_drop_either(rows, "vec_id", ["bucket"], ["a", "b"], ["size"])


@query("image_duplicates")
def image_duplicates(t):
    """Of images with the same pixels the largest file stays; then, larger files first, what is near a kept one by difference or perceptual hash.

    Labels are buckets, but of label 0 each taxon is one. Tests hold the rows
    against a plain walk.
    """
    facts = t.embeddings.select(
        F.col("vec_id").alias("row"), F.concat(F.lit("c"), "label").alias("label"), F.concat(F.lit("t"), F.col("vec_id") % 3).alias("taxon"),
        F.sha2(F.to_json(F.transform("embedding", lambda x: F.round(x, 1))), 256).alias("digest"), (F.col("vec_id") * 7919 % 1000).alias("bytes"),
    )
    largest = dedup.keep_largest(facts, ["label", "digest"], "bytes", "row")
    hashed = largest.join(image_hashes(t), "row").withColumn("bucket", dedup.pooled_bucket("label", "taxon", "c0")).withColumn("less", -F.col("bytes"))
    return dedup.greedy_drop_either(hashed, "row", ["bucket"], ["difference", "perceptual"], ["less", "slot"])
