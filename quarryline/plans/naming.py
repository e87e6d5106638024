"""Queries on names, numbers, links and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, names, publication
from ..operators import facets, lookups
from .base import dealt, query, values_sql

PERSONS = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'unknown' END AS o, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' END AS a, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'n/a' END AS r FROM customer"


@query("person_sources", f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'inat_observer' WHEN c_custkey % 3 = 0 THEN 'author' WHEN c_custkey % 5 = 0 THEN 'recorded_by' ELSE 'none' END AS source, CASE WHEN coalesce(o, '') <> '' THEN 'inat:' || lower(o) WHEN trim(a) <> '' THEN 'author:' || lower(a) ELSE '' END AS collector FROM ({PERSONS})")
def person_sources(t):
    key, name = F.col("c_custkey"), F.col("c_name")
    observer = F.when(key % 4 == 0, name).when(key % 4 == 1, "unknown")
    author, recorded = F.when(key % 3 == 0, name).otherwise(" "), F.when(key % 5 == 0, name).otherwise("n/a")
    source = names.person_source(observer, author, F.lit(None).cast("string"), recorded)
    return t.customer.select("c_custkey", source.alias("source"), names.collector_key(observer, author).alias("collector"))


@query(
    "customer_names",
    """SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_-]', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') || '-' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS stem,
    replace(replace(replace(replace(c_name, '%', '%25'), '-', '%2D'), '_', '%5F'), '.', '%2E') AS escaped, c_name AS unescaped, sha256(c_name)[1:8] AS print, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS rounded FROM customer""",
)
def customer_names(t):
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey", names.safe_stem(name, F.col("c_custkey")).alias("stem"), names.escaped(name).alias("escaped"), names.unescaped(names.escaped(name)).alias("unescaped"),
        names.fingerprint(name).alias("print"), names.half_up(F.col("c_acctbal")).alias("rounded"),
    )


@query(
    "customer_places",
    """SELECT c_custkey, CASE WHEN a BETWEEN -90 AND 90 THEN CASE c_custkey % 3 WHEN 0 THEN 'https://maps.apple.com/?ll=' || q || '&q=' || q WHEN 1 THEN 'geo:' || q || '?q=' || q ELSE 'https://www.google.com/maps/search/?api=1&query=' || q END END AS link, printf('%.1f%%', greatest(0.0, least(1.0, a / 100.0)) * 100) AS percent
    FROM (SELECT c_custkey, CAST(c_custkey % 200 AS DOUBLE) AS a, printf('%.6f,%.6f', CAST(c_custkey % 200 AS DOUBLE), CAST(c_custkey % 90 AS DOUBLE) / 8.0) AS q FROM customer)""",
)
def customer_places(t):
    key = F.col("c_custkey")
    lat, lon = (key % 200).cast("double"), (key % 90).cast("double") / 8.0
    platform = F.when(key % 3 == 0, "ios").when(key % 3 == 1, "android").otherwise("web")
    return t.customer.select("c_custkey", names.map_link(lat, lon, platform).alias("link"), names.percent(lat / 100.0).alias("percent"))


NUMBERS = [
    ("+48 601 202 303", "tel:+48601202303"), ("601-202-303", "tel:+48601202303"), ("112", "tel:112"), ("22 619 66 54 ext 2", None), ("", None), (None, None), ("no digits", None), ("112, 113", None), (" +1 (202) 555-0100 ", "tel:+12025550100"),
]


@query("tel_links", f"SELECT phone, link FROM (VALUES {values_sql(NUMBERS)}) AS v(phone, link) UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'tel:' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) = 9 THEN '+48' ELSE '' END || o_orderkey FROM orders")
def tel_links(t):
    phones = t.values([(p,) for p, _ in NUMBERS], "phone string").unionByName(t.orders.select(F.col("o_orderkey").cast("string").alias("phone")))
    return phones.select("phone", names.tel_link(F.col("phone")).alias("link"))


FILES = [
    ("a.jpg", "a.jpg"), (" b.png ", "b.png"), ("/x/journal-photos/c.jpg", "c.jpg"), ("/x/journal-photos/d/e.jpg", None), ("../a.jpg", None), ("a%2Fb.jpg", None), ("/other/a.jpg", None), ("", None), (None, None), (".hidden", None), ("a.b.jpg", None), ("c.heic", "c.heic"), ("d.gif", None),
]
CACHES = [("class=aa%2Dv2__v3__0123456789abcdef0123.json", "class", "aa-v2"), ("media=x%5Fy%2Ez%25__v12__ffffffffffffffffffff.json", "media", "x_y.z%"), ("class=a__v1__short.json", None, None), ("plain.txt", None, None)]


@query("file_names", f"SELECT value, name, NULL AS kind FROM (VALUES {values_sql(FILES)}) AS v(value, name) UNION ALL SELECT value, identity, kind FROM (VALUES {values_sql(CACHES)}) AS c(value, kind, identity) UNION ALL SELECT 'p' || p_partkey || '.jpg', 'p' || p_partkey || '.jpg', NULL FROM part")
def file_names(t):
    files = t.values([(f,) for f, _ in FILES], "value string").unionByName(t.part.select(F.concat(F.lit("p"), "p_partkey", F.lit(".jpg")).alias("value")))
    caches = t.values([(c[0],) for c in CACHES], "value string")
    found = names.cached_identity(F.col("value"))
    out = files.select("value", names.photo_name(F.col("value")).alias("name"), F.lit(None).cast("string").alias("kind"))
    return out.unionByName(caches.select("value", found["identity"].alias("name"), found["kind"].alias("kind")))


LINKS = [
    ("https://x.y/l", "CC BY", "CC0", "https://x.y/l"), ("http://x", "https://z/1", "", "https://z/1"), (None, "CC0", "cc0  1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("", "", "CC BY 4.0", None), ("", "", "CC0 1.0", "https://creativecommons.org/publicdomain/zero/1.0/"), (None, None, None, None),
]


@query("licence_links", f"SELECT explicit, licence, normalized, link, count(*) AS n FROM orders JOIN (VALUES {values_sql([(i, *x) for i, x in enumerate(LINKS)])}) AS v(k, explicit, licence, normalized, link) ON k = o_orderkey % {len(LINKS)} GROUP BY ALL")
def licence_links(t):
    """Links of licences dealt to the orders, and how many orders have each."""
    rows = t.orders.select(*[dealt([x[i] for x in LINKS]).alias(n) for i, n in enumerate(("explicit", "licence", "normalized"))])
    told = rows.withColumn("link", publication.licence_link(F.col("explicit"), F.col("licence"), F.col("normalized")))
    return told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n"))


TEXTS = [("1.5", 1.5, None), (" 7 ", 7.0, 7), ("-3", -3.0, None), ("inf", None, None), ("NaN", None, None), ("abc", None, None), (None, None, None), ("", None, None), ("1e3", 1000.0, 1000)]


@query("strict_numbers", f"SELECT value, CAST(number AS DOUBLE) AS number, CAST(n AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS digits FROM (VALUES {values_sql(TEXTS)}) AS v(value, number, n) WHERE NOT regexp_matches(coalesce(value, 'x'), '^[0-9]+$') UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS DOUBLE), o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders")
def strict_numbers(t):
    values = t.values([(x,) for x, *_ in TEXTS], "value string").unionByName(t.orders.select(F.col("o_orderkey").cast("string").alias("value")))
    v = F.col("value")
    return values.select("value", names.finite(v).alias("number"), names.whole_count(v).alias("count"), names.digits_key(v).alias("digits"))


@query(
    "preview_widths",
    """WITH w AS (SELECT p_partkey, p_size * 97 AS w FROM part), h AS (SELECT p_partkey, w, [CAST(floor(w / pow(2, i)) AS BIGINT) FOR i IN range(1, 21) IF floor(w / pow(2, i)) >= 448] AS h FROM w)
    SELECT p_partkey, CASE WHEN w <= 448 THEN '' WHEN len(h) > 0 AND h[-1] = 448 THEN array_to_string(h, ',') ELSE array_to_string(list_append(h, 448), ',') END AS widths, CAST(CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN p_size ELSE w END AS BIGINT) AS upright FROM h JOIN part USING (p_partkey)""",
)
def preview_widths(t):
    width = (F.col("p_size") * 97).cast("long")
    upright = names.upright_width(width, F.col("p_size").cast("long"), (F.col("p_partkey") % 9).cast("int"))
    return t.part.select("p_partkey", F.array_join(names.preview_widths(width).cast("array<string>"), ",").alias("widths"), upright.alias("upright"))


@query("html_phones")
def html_phones(t):
    """Phone-like numbers of decoded pages; DuckDB's patterns have no lookaround, so tests hold them against Python's."""
    return t.pages.select("page_id", F.explode(names.page_phones(F.col("html"))).alias("number"))


@query(
    "identity_sets",
    "SELECT o_orderkey, 'person:' || o_custkey || ',' || CASE WHEN o_custkey % 2 = 0 THEN 'photo:' || o_orderkey || ',' ELSE '' END || 'inat_observation:' || (o_orderkey % 7) || CASE WHEN o_orderkey % 3 = 0 THEN ',gbif_occurrence:' || o_orderkey ELSE '' END AS keys FROM orders",
)
def identity_sets(t):
    order, who = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    keys = ids.identity_keys([text(who), F.lit(" ")], [], [F.when(who % 2 == 0, text(order))], [F.concat(F.lit("inat:"), order % 7), F.concat(F.lit("inat-obs: "), order % 7), F.when(order % 3 == 0, text(order))])
    return t.orders.select("o_orderkey", F.array_join(keys, ",").alias("keys"))


CHIPS = ["brand", "size", "season", "colour"]


@query(
    "facet_panels",
    "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['size', 'x', 'brand'] ELSE ['x', 'colour'] END AS c, p_size FROM part) SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'size,brand' ELSE 'colour' END AS kept, 'x' AS others, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN p_size % 5 = 0 THEN 'tokens' WHEN p_size > 40 THEN 'range' END AS problem, CASE WHEN p_size <= 10 THEN 'edible' WHEN p_size <= 20 THEN 'toxic' ELSE 'other' END AS kind FROM p",
)
def facet_panels(t):
    """Chosen facets inside and outside of a panel, the first faulty field of a row, and its derived kind."""
    size = F.col("p_size")
    chosen = F.when(size % 2 == 0, F.array(F.lit("size"), F.lit("x"), F.lit("brand"))).otherwise(F.array(F.lit("x"), F.lit("colour")))
    kept, others = facets.kept_chips(chosen, CHIPS)
    tokens = F.when(size % 5 == 0, F.array(F.lit("brand"), F.lit("nothing"))).otherwise(F.array(F.lit("brand")))
    problem = facets.fact_problem({"tokens": (tokens, CHIPS, False)}, {"range": (F.when(size > 40, size).otherwise(1), F.when(size > 40, size - 1))})
    kind = F.when(size <= 10, "edible").when(size <= 20, "toxic").otherwise("other")
    return t.part.select("p_partkey", F.array_join(kept, ",").alias("kept"), F.array_join(others, ",").alias("others"), F.size(kept).alias("n"), problem.alias("problem"), kind.alias("kind"))


@query(
    "label_examples",
    "SELECT c_custkey, n_nationkey, CASE WHEN c_custkey % 2 = 0 AND n_regionkey <> 2 THEN n_name ELSE lower(n_name) END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 7",
)
def label_examples(t):
    """A label in the reader's language, else the general one; rows without a match or a label go."""
    own = t.nation.where("n_nationkey <> 7").select(F.col("n_nationkey").alias("c_nationkey"), "n_nationkey", F.when(F.col("n_regionkey") != 2, F.col("n_name")).otherwise(" ").alias("local"), F.lower("n_name").alias("general"))
    rows = t.customer.select("c_custkey", "c_nationkey")
    local = F.when(F.col("c_custkey") % 2 == 0, F.col("local"))
    return lookups.labelled(rows, "c_nationkey", own, [local, F.col("general")], "label").select("c_custkey", "n_nationkey", "label")


@query(
    "enriched_orders",
    "WITH d AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS k FROM lineitem) SELECT o_orderkey, l_returnflag AS flag FROM orders LEFT JOIN d ON l_orderkey = o_orderkey AND k = 1",
)
def enriched_orders(t):
    """The last definition of a key wins."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    order = [F.desc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    return lookups.enriched(t.orders.select("o_orderkey"), "o_orderkey", lines, ["flag"], *order)


@query(
    "credit_list",
    "WITH c AS (SELECT unnest(string_split(text, ' ')) AS word, doc_id FROM documents WHERE lang = 'en'), d AS (SELECT word, min(doc_id) AS doc_id FROM c WHERE length(word) >= 6 GROUP BY 1) SELECT doc_id, source, count(*) AS words FROM d JOIN documents USING (doc_id) GROUP BY ALL",
)
def credit_list(t):
    """Nested lists flattened, each item under the row that has it first, with that row's name."""
    docs = t.documents.where("lang = 'en'").select("doc_id", F.explode(F.split("text", " ")).alias("word")).where(F.length("word") >= 6)
    first = docs.groupBy("word").agg(F.min("doc_id").alias("doc_id"))
    return lookups.enriched(first, "doc_id", t.documents.select("doc_id", "source"), ["source"], "source").groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("words"))
