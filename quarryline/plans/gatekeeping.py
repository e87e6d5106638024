"""Queries on verified lookups, the dataset's manifest and the reasons that hold a sample back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captions
from ..operators import gates, lookups, manifest, resources
from .base import dealt, query, values_sql

HOST, PATH, ASKED = "lower(regexp_extract({}, '^[A-Za-z]+://([^/?#]*)', 1))", "regexp_extract({}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)", "regexp_extract({}, '^[^?#]*[?]([^#]*)', 1)"
RESOURCE = lambda c: f"{HOST.format(c)} || ' ' || {PATH.format(c)} || ' ' || {ASKED.format(c)}"


def _why(c: str) -> str:
    return f"""CASE WHEN coalesce(trim({c}), '') = '' OR starts_with({c}, 'https:') THEN NULL WHEN NOT starts_with({c}, 'http:') THEN 'url_not_https'
      WHEN {HOST.format(c)} NOT IN (SELECT host FROM trusted) THEN 'http_host_not_allowlisted' WHEN {RESOURCE(c)} NOT IN (SELECT k FROM known) THEN 'https_not_verified_for_url' END"""


@query(
    "https_lookup",
    f"""WITH s AS (SELECT {HOST.format('url')} AS host, {RESOURCE('url')} AS k, coalesce(page_id % 41 <> 0 AND page_id % 59 <> 0 AND page_id % 97 <> 0, false) AS good FROM pages WHERE page_id % 3 <> 0),
    trusted AS (SELECT host FROM s GROUP BY 1 HAVING bool_and(good)), known AS (SELECT k FROM s JOIN trusted USING (host) WHERE good),
    p AS (SELECT page_id, url AS image_url, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'ftp://x.example/a' WHEN page_id % 4 = 0 THEN url || 'x' ELSE url END AS source_url FROM pages),
    w AS (SELECT *, coalesce({_why('image_url')}, {_why('source_url')}) AS reason FROM p)
    SELECT page_id, CASE WHEN reason IS NULL THEN regexp_replace(image_url, '^http:', 'https:') ELSE image_url END AS image_url, CASE WHEN reason IS NULL THEN regexp_replace(source_url, '^http:', 'https:') ELSE source_url END AS source_url, reason FROM w""",
)
def https_lookup(t):
    """Two URLs of a page become https if the very host, path and query of each was sampled the same both ways, on hosts without a bad sample."""
    page, url = F.col("page_id"), F.col("url")
    samples = t.pages.where(page % 3 != 0).select(
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url", F.when(page % 41 == 0, 404).otherwise(200).alias("http_status"), F.when(page % 59 != 0, 204).alias("https_status"),
        F.sha2("url", 256).alias("http_sha"), F.sha2(F.concat("url", F.when(page % 97 == 0, "x").otherwise("")), 256).alias("https_sha"),
    )
    agrees = resources.sample_agrees(F.col("http_status"), F.col("https_status"), F.col("http_sha"), F.col("https_sha"))
    source = F.when(page % 5 == 0, None).when(page % 7 == 0, "ftp://x.example/a").when(page % 4 == 0, F.concat("url", F.lit("x"))).otherwise(url)
    rows = t.pages.select("page_id", url.alias("image_url"), source.alias("source_url"))
    return resources.upgraded_urls(rows, "page_id", ["image_url", "source_url"], samples, agrees)


#: What the texts of some fields begin with, by the field's place; others begin with their place.
BEGINNINGS = {3: 'say "', 5: "back\\slash ", 9: "é€ ", 14: "two\nlines "}
NUMBERS = ("inat_photo_id", "gbifID")


def _field(i: int, name: str):
    row = F.col("o_orderkey")
    if name == "class_id":
        return F.concat(F.lit("c"), F.col("o_custkey") % 20)
    if name in NUMBERS:
        return F.when((row + i) % 4 != 0, row % (50 + i))
    return F.when((row + i) % 4 == 0, None).when((row + i) % 4 == 1, "").otherwise(F.concat(F.lit(BEGINNINGS.get(i, f"{i}-")), row % (50 + i)))


def _field_sql(i: int, name: str) -> str:
    if name == "class_id":
        return "'\"c' || (o_custkey % 20) || '\"'"
    if name in NUMBERS:
        return f"CASE WHEN (o_orderkey + {i}) % 4 <> 0 THEN CAST(o_orderkey % {50 + i} AS VARCHAR) END"
    start = BEGINNINGS.get(i, f"{i}-").replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("'", "''")
    return f"CASE WHEN (o_orderkey + {i}) % 4 > 1 THEN '\"{start}' || (o_orderkey % {50 + i}) || '\"' END"


LINE = ", ".join(f"'\"{name}\":' || {sql}" for name, sql in sorted([*((n, _field_sql(i, n)) for i, n in enumerate(manifest.FIELDS)), ("split", "'\"' || split || '\"'")]))
SUMS = ", ".join(f"sum(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)) AS w{i}" for i in range(8))
MERGED = ", ".join(f"sum(w{i}) AS w{i}" for i in range(8))
DIGEST = "sha256(CAST(CAST(coalesce(sum(n), 0) AS BIGINT) AS VARCHAR)" + "".join(f" || ',' || CAST(CAST(coalesce(sum(w{i}), 0) AS HUGEINT) % 18446744073709551616 AS VARCHAR)" for i in range(8)) + ")"
SPLITS = ["train", "val", "test"]
CONFIG = '{"limit":0.2}'


@query(
    "dataset_manifest",
    f"""WITH o AS (SELECT *, 'c' || (o_custkey % 20) AS label, CASE WHEN o_custkey % 10 = 0 THEN 'test' WHEN o_custkey % 10 = 1 THEN 'val' ELSE 'train' END AS split, o_totalprice < 20000 AS held FROM orders),
    r AS (SELECT split, label, sha256('{{' || array_to_string([x FOR x IN [{LINE}] IF x IS NOT NULL], ',') || '}}') AS d FROM o WHERE NOT held),
    g AS (SELECT split, label, count(*) AS n, {SUMS} FROM r GROUP BY ALL),
    k AS (SELECT s.split, l.label FROM (VALUES ('train'), ('val'), ('test')) s(split), (SELECT DISTINCT label FROM g) l)
    SELECT 'class' AS part, k.split, k.label, coalesce(CAST(sum(n) AS BIGINT), 0) AS n, CASE WHEN sum(n) IS NOT NULL THEN {DIGEST} END AS digest FROM k LEFT JOIN g USING (split, label) GROUP BY k.split, k.label
    UNION ALL SELECT 'split', split, NULL, CAST(sum(n) AS BIGINT), {DIGEST} FROM g GROUP BY split
    UNION ALL SELECT 'content', NULL, NULL, CAST(coalesce(sum(n), 0) AS BIGINT), {DIGEST} FROM g
    UNION ALL SELECT 'salt', NULL, NULL, 0, left(sha256('salt'), 8) UNION ALL SELECT 'config', NULL, NULL, 0, sha256('{CONFIG}')
    UNION ALL SELECT 'withheld', CASE WHEN o_orderkey % 3 = 0 THEN 'rights' ELSE 'quality' END, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE label END, count(*), NULL FROM o WHERE held GROUP BY 2, 3""",
)
def dataset_manifest(t):
    """All 25 fields of a row in its line; sums of two halves of the orders are taken apart and added up."""
    who = F.col("o_custkey")
    split = F.when(who % 10 == 0, "test").when(who % 10 == 1, "val").otherwise("train")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", split.alias("split"), *[_field(i, n).alias(n) for i, n in enumerate(manifest.FIELDS)])
    line = manifest.canonical_line(list(manifest.FIELDS), split=F.col("split"))
    kept = rows.where("o_totalprice >= 20000")
    halves = [manifest.sums(kept.where(half), line, "split", "class_id") for half in ("o_orderkey % 2 = 0", "o_orderkey % 2 <> 0")]
    withheld = rows.where("o_totalprice < 20000").select(F.when(who % 9 != 0, F.col("class_id")).alias("label"), F.when(F.col("o_orderkey") % 3 == 0, "rights").otherwise("quality").alias("reason"))
    return manifest.manifest(manifest.merged(halves, "split", "class_id"), "split", "class_id", SPLITS, "salt", CONFIG, withheld)


EXPECTED = [("0", 1, "a", False), ("1", 2, "a", True), ("2", 3, "b", False), ("99", 4, "b", True), ("3", 5, None, True), ("5", 6, "c", False), ("4", 7, "d", False)]
MINIMA = [("a", 1, 40), ("b", 2, 10), ("c", 3, 1), ("d", 4, 1)]
MEMBERS = f"""x(name, place, grp, exempt) AS (VALUES {values_sql(EXPECTED)}), g(grp, gplace, minimum) AS (VALUES {values_sql(MINIMA)}),
    c AS (SELECT CAST(label AS VARCHAR) AS name, CASE WHEN label <> 5 THEN count(*) END AS support, count(*) FILTER (WHERE vec_id % 50 = 3) AS confident FROM embeddings GROUP BY label),
    b AS (SELECT coalesce(x.name, c.name) AS name, place, grp, coalesce(exempt, false) AS exempt, support, confident, c.name IS NOT NULL AS given FROM x FULL JOIN c ON c.name = x.name)"""


@query(
    "sample_reasons",
    f"""WITH {MEMBERS}, i AS (SELECT 1 AS l, coalesce(place, 1099511627776) AS p, name, unnest([CASE WHEN NOT given THEN 'missing' END, CASE WHEN given AND support IS NULL THEN 'not_a_count' END, CASE WHEN NOT exempt AND support < 20 THEN 'below_floor' END,
      CASE WHEN exempt AND support < 5 THEN 'below_rare_floor' END, CASE WHEN exempt AND confident > 0 AND support IS NOT NULL THEN 'exempt_but_unsafe' END]) AS reason, unnest([1, 2, 3, 4, 5]) AS rule FROM b),
    u AS (SELECT grp, CASE WHEN count(*) = count(support) THEN sum(support) END AS s FROM b WHERE grp IS NOT NULL GROUP BY 1), v AS (SELECT CASE WHEN count(*) = count(support) THEN sum(support) END AS s, sum(confident) AS c FROM b),
    r AS (SELECT l, p, name, reason, rule FROM i UNION ALL SELECT 2, gplace, grp, CASE WHEN s IS NULL THEN 'member_missing' WHEN s < minimum THEN 'group_below_minimum' END, 6 FROM u JOIN g USING (grp)
      UNION ALL SELECT 3, 0, '', CASE WHEN s IS NULL THEN 'total_unknown' WHEN s < 300 THEN 'total_below_minimum' END, 8 FROM v UNION ALL SELECT 3, 0, '', CASE WHEN c > 0 THEN 'unsafe_outcomes' END, 10 FROM v)
    SELECT CAST(row_number() OVER (ORDER BY l, p, name, rule) AS INTEGER) AS seq, CASE l WHEN 1 THEN 'item' WHEN 2 THEN 'group' ELSE 'all' END AS level, name, reason FROM r WHERE reason IS NOT NULL""",
)
def sample_reasons(t):
    """Reasons over items, their groups and all of them; one name was never seen and one has no whole count, so their groups and the total are unknown."""
    n = F.count(F.lit(1))
    counts = t.embeddings.groupBy("label").agg(n.alias("n"), F.count_if(F.col("vec_id") % 50 == 3).alias("confident"))
    counts = counts.select(F.col("label").cast("string").alias("name"), F.when(F.col("label") == 5, "2.5").otherwise(F.col("n").cast("string")).alias("support"), "confident")
    expected, groups = t.values(EXPECTED, "name string, place long, grp string, exempt boolean"), t.values(MINIMA, "grp string, place long, minimum long")
    return gates.sample_reasons(counts, expected, groups, 20, 5, 300)


#: Species and the underside, whole and young caption of each.
SPECIES = [
    ("amanita_muscaria", "gillsRing", "amanitaWhole", "amanitaYoung"), ("chlorophyllum_rhacodes", "gillsRing", "chlorophyllumWhole", "young"), ("agaricus_xanthodermus", "gillsRing", "swollenBaseNotVolva", "young"),
    ("inocybe_erubescens", "gills", "swollenBaseNotVolva", "young"), ("gyromitra_esculenta", "undersideStem", "wholeStemBase", "young"), ("rubroboletus_satanas", "tubes", "wholeStemBase", "young"),
    ("cortinarius_orellanus", "gillsCortina", "wholeStemBase", "young"), ("hypholoma_fasciculare", "gillsCortina", "wholeStemBase", "young"), ("russula_emetica", "gills", "wholeStemBase", "young"),
]


@query(
    "feature_captions",
    f"""SELECT species, feature, 'gallery.feature.' || CASE feature WHEN 'C' THEN 'cap' WHEN 'W' THEN whole WHEN 'Y' THEN young ELSE under END AS caption, count(*) AS n
    FROM (SELECT o_orderkey % {len(SPECIES)} AS k, CASE o_custkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'W' WHEN 2 THEN 'Y' ELSE 'G' END AS feature FROM orders) JOIN (VALUES {values_sql([(i, *s) for i, s in enumerate(SPECIES)])}) AS v(k, species, under, whole, young) USING (k) GROUP BY ALL""",
)
def feature_captions(t):
    """Captions of pictures of several species, dealt to the orders."""
    feature = F.element_at(F.array(*map(F.lit, "CWYG")), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = t.orders.select(dealt([s[0] for s in SPECIES]).alias("species"), feature.alias("feature"))
    return rows.groupBy("species", "feature").agg(F.count(F.lit(1)).alias("n")).withColumn("caption", captions.feature_key(F.col("species"), F.col("feature")))


@query("public_facts", "SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN 'small' WHEN p_size % 3 = 1 THEN 'large' END AS band FROM part")
def public_facts(t):
    """Facts of parts by a list of allowed fields and values; working columns and fields that aren't listed stay behind."""
    band = F.when(F.col("p_size") % 3 == 0, "small").when(F.col("p_size") % 3 == 1, "large")
    rows = lookups.public(t.part.withColumns({"band": band, "_cache": F.lit(1)}), "p_type")
    return lookups.allowlisted(rows, "p_partkey", {"p_brand": [f"Brand#{i}" for i in range(100)], "band": ["small", "large"]})


@query(
    "evidence_counts",
    "SELECT c_custkey AS key, n AS accepted, CASE WHEN n > 3 THEN 'end_of_records' WHEN n IS NOT NULL THEN 'max_pages' END AS exhausted_reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def evidence_counts(t):
    """Counts that rows claim for themselves give way to those of the report; without one they are null."""
    n = F.count(F.lit(1))
    report = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(n.alias("accepted")).withColumn("exhausted_reason", F.when(F.col("accepted") > 3, "end_of_records").otherwise("max_pages"))
    claims = t.customer.select(F.col("c_custkey").alias("key"), F.lit(999).cast("long").alias("accepted"), F.lit("claimed").alias("exhausted_reason"))
    return lookups.from_evidence(claims, "key", ["accepted", "exhausted_reason"], report)


@query(
    "device_reasons",
    """WITH n AS (SELECT count(*) AS images, count(*) FILTER (WHERE label = 0) AS risky FROM embeddings), x AS (SELECT count(*) FILTER (WHERE vec_id % 200 <> 7) / count(*) AS top1, count(*) FILTER (WHERE vec_id % 50 <> 7) / count(*) AS decision FROM embeddings)
    SELECT seq, reason FROM (SELECT unnest([4, 6, 8, 9, 10, 11]) AS seq, unnest(['sample_sha256', 'high_risk_images', CASE WHEN top1 < 0.99 THEN 'top1_agreement' END, 'high_risk_top1_agreement', CASE WHEN decision < 0.99 THEN 'decision_agreement' END, 'high_risk_decision_agreement']) AS reason FROM x) WHERE reason IS NOT NULL""",
)
def device_reasons(t):
    """A device's report over all vectors: a stale sample, a risky subset that is one short, and rates of which two are unknown."""
    n, risky = t.embeddings.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    share = lambda holds: F.count_if(holds) / F.count(F.lit(1))
    report = t.embeddings.agg(
        F.count(F.lit(1)).alias("images"), (F.count_if(F.col("label") == 0) - 1).alias("high_risk_images"), share(F.col("vec_id") % 200 != 7).alias("top1_agreement"), share(F.col("vec_id") % 50 != 7).alias("decision_agreement"),
    ).withColumns({
        "platform": F.lit("core-ml"), "measured_on": F.lit("device"), "model_sha256": F.lit("m"), "sample_sha256": F.lit("old"), "decision_fields": F.array(*map(F.lit, ("status", "top1", "verify"))),
        "high_risk_top1_agreement": F.lit(None).cast("double"), "high_risk_decision_agreement": F.lit(float("nan")), "max_energy_difference": F.lit(0.25),
    })
    return gates.device_reasons(report, "m", "new", n, risky, ["android-gpu", "core-ml"], ["status", "top1", "verify"])
