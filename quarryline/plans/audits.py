"""Queries that audit what was kept, dropped, credited and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, facets, fetching, splitting
from .base import query
from .media import CASES, MEDIA, media
from .release import DECIDED, decided

#: Whether text and URL of a case name its exact id.
EXACT = [k for k, *_, licence, _, url_id in CASES if licence and url_id == licence]


@query(
    "credits_exact",
    f"""WITH {MEDIA}, r AS (SELECT class, row, coalesce(NOT unverified AND trim(creator) <> '' AND id IS NOT NULL AND (id = 'df20' OR (NOT starts_with(id, 'cc-by-nc') AND NOT starts_with(id, 'cc-by-sa') OR k IN ({", ".join(map(str, EXACT))})) AND row % 50 <> 0), false) AS good FROM (SELECT m.*, row % 12 AS k FROM m))
    SELECT class, bool_and(good) AS complete, count(*) FILTER (WHERE good) AS good, count(*) AS n FROM r GROUP BY 1""",
)
def credits_exact(t):
    """Of each class: whether every row's credit is complete by its exact licence, and how many are."""
    source = F.when(F.col("row") % 50 != 0, F.concat(F.lit("https://s.example/"), "row"))
    good = evaluation.attributed(F.col("unverified"), F.col("id"), F.col("text"), F.col("url"), F.col("creator"), F.col("image_url"), source)
    rows = media(t).select("class", good.alias("g"))
    return rows.groupBy("class").agg(F.bool_and("g").alias("complete"), F.count_if("g").alias("good"), F.count(F.lit(1)).alias("n"))


TAKEN = "NOT candidates AND NOT (o[1] = 9 OR energy > -3.5) AND o[1] = 8 AND best >= 0.2"


@query(
    "unknown_metrics",
    f"""WITH {DECIDED}, x AS (SELECT label, vec_id, o[1] = 8 AS f, {TAKEN} AS t, label IN (0, 7) AND vec_id % 3 <> 0 AS u, label NOT IN (0, 7) AS k, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 't' || (vec_id % 4) END AS taxon, CASE WHEN vec_id % 2 = 0 THEN 'near' ELSE 'far' END AS relation FROM d),
    l AS (SELECT 'held_out_recall' AS metric, '' AS name, f AS hit FROM x WHERE u UNION ALL SELECT 'taxon_recall', taxon, f FROM x WHERE u AND taxon <> '' UNION ALL SELECT 'relation_recall', relation, f FROM x WHERE u
      UNION ALL SELECT 'known_taken', '', t FROM x WHERE k UNION ALL SELECT 'watched_taken', CAST(label AS VARCHAR), t FROM x WHERE k AND label IN (1, 2, 99)),
    e(metric, name) AS (VALUES ('held_out_recall', ''), ('known_taken', ''), ('watched_taken', '1'), ('watched_taken', '2'), ('watched_taken', '99')),
    g AS (SELECT metric, name, count(*) AS support, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS rate FROM l GROUP BY 1, 2)
    SELECT metric, name, coalesce(support, 0) AS support, round(rate, 6) AS rate FROM e FULL JOIN g USING (metric, name) WHERE metric <> 'taxon_recall' OR support >= 10""",
)
def unknown_metrics(t):
    """Recall of held-out rows by taxon and relation, and known rows that decisions give to the hidden class."""
    key = F.col("vec_id")
    rows = decided(t).withColumns({"taxon": F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("t"), key % 4)), "relation": F.when(key % 2 == 0, "near").otherwise("far")})
    apart = F.col("label").isin(0, 7)
    taken = (F.col("d.status") == "rejected") & (F.col("d.reason") == "unknown_species")
    out = evaluation.unknown_metrics(rows, apart & (key % 3 != 0), ~apart, F.element_at("order", 1) == 8, taken, "taxon", "relation", "label", [1, 2, 99])
    return out.withColumn("rate", F.round("rate", 6))


@query(
    "facet_counts",
    """WITH f AS (SELECT p_brand, CASE WHEN p_size % 7 = 0 THEN 1 WHEN p_size <= 15 OR p_size > 35 THEN 0 WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END AS b FROM part)
    SELECT p_brand, count(*) FILTER (WHERE b = 0) AS matches, count(*) FILTER (WHERE b = 1) AS unverified, count(*) AS visible FROM f WHERE b < 2 GROUP BY 1""",
)
def facet_counts(t):
    """How many parts of each brand match, aren't verified, and are shown."""
    size = F.col("p_size")
    band = F.when(size % 7 == 0, None).when(size <= 15, "small").when(size <= 35, "medium").otherwise("large")
    found = facets.filtered(t.part.select("p_partkey", "p_brand", "p_size"), [facets.facet(F.array(band), ["small", "large"], F.col("p_partkey") % 5 == 0)])
    return facets.partition_sizes(found, "p_brand")


@query("dropped_per_class", f"WITH {MEDIA} SELECT CASE WHEN who % 9 = 0 THEN '' ELSE class END AS class, count(*) AS n FROM m WHERE NOT downloaded GROUP BY 1")
def dropped_per_class(t):
    """Rows that were never downloaded, by class; some have none."""
    rows = media(t).where("NOT downloaded").select(F.when(F.col("who") % 9 != 0, F.col("class")).alias("class"))
    return fetching.dropped_per_class(rows, "class")


@query(
    "split_assigned",
    """WITH r AS (SELECT o_orderkey, 'c' || (o_custkey % 20) AS class, CAST(o_custkey AS VARCHAR) AS c, o_orderkey % 41 = 0 AS held FROM orders),
    p AS (SELECT c, min(class) AS class, count(*) AS n, bool_or(held) AS blocked FROM r GROUP BY 1),
    q AS (SELECT *, sha256('0:' || class || ':' || c) AS place, sum(n) OVER (PARTITION BY class) AS rows, count(*) OVER (PARTITION BY class) AS parts FROM p),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY blocked, place, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
    s AS (SELECT *, parts >= 3 AND NOT blocked AND before < round_even(rows * 0.15, 0) AND before + n < rows AS test FROM b),
    u AS (SELECT c, coalesce(sum(n) OVER (PARTITION BY class ORDER BY place, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later, sum(n) OVER (PARTITION BY class) AS rest FROM s WHERE NOT test),
    z AS (SELECT s.class, s.n, CASE WHEN s.test THEN 'test' WHEN s.parts >= 3 AND later < round_even(s.rows * 0.15, 0) AND later + s.n < rest THEN 'val' ELSE 'train' END AS split FROM s LEFT JOIN u USING (c))
    SELECT class, split, CAST(sum(n) AS BIGINT) AS n FROM z GROUP BY ALL""",
)
def split_assigned(t):
    """Customers as components; those with an order of the reference set stay out of test, and a check afterwards says so."""
    row = F.col("o_orderkey")
    rows = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey") % 20).alias("class"), F.col("o_custkey").alias("component"), F.array(F.concat(F.lit("k"), row)).alias("keys"))
    reference = t.orders.where(row % 41 == 0).select(F.concat(F.lit("k"), row).alias("key"))
    return splitting.assigned(rows, "class", "component", "keys", reference).groupBy("class", "split").agg(F.count(F.lit(1)).alias("n"))
