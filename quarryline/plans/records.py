"""Queries on records: joins, duplicates, caps, splits, reports, metrics, facets, journal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import caps, dedup, facets, graph, journal, lookups, reports, splitting
from .base import query, values_sql


def rows_count():
    return F.count(F.lit(1))

# ---------------------------------------------------------------- aggregates and reports


@query("licence_breakdown", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def licence_breakdown(t):
    return reports.breakdown(t.lineitem, "l_returnflag", "l_linestatus")


@query("zero_filled_counts", "SELECT n.n_name, k.c_mktsegment, count(c.c_custkey) AS n FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) k LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = k.c_mktsegment AND c.c_acctbal > 8000 GROUP BY 1, 2")
def zero_filled_counts(t):
    kinds = t.customer.agg(F.collect_set("c_mktsegment").alias("k"))  # one row with the market segments
    dims = t.nation.select("n_nationkey", "n_name").join(F.broadcast(kinds)).select("n_nationkey", "n_name", F.explode("k").alias("c_mktsegment"))
    rows = t.customer.where("c_acctbal > 8000").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    return reports.zero_filled(dims, ["n_nationkey", "c_mktsegment"], rows).select("n_name", "c_mktsegment", "n")


@query("split_counts", "SELECT lang, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1, 2")
def split_counts(t):
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")
    return t.documents.groupBy("lang", split.alias("split")).agg(rows_count().alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


CANONICAL = "'{\"chars\":' || n_chars || ',\"id\":' || doc_id || ',\"source\":\"' || source || '\"}'"


@query(
    "content_hash",
    f"""WITH d AS (SELECT lang, sha256({CANONICAL}) AS d FROM documents), r AS (SELECT lang, left(d, 4) AS r, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS p FROM d GROUP BY 1, 2)
    SELECT lang, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p, chr(10) ORDER BY r)) AS digest FROM r GROUP BY 1""",
)
def content_hash(t):
    line = F.concat(F.lit('{"chars":'), F.col("n_chars"), F.lit(',"id":'), F.col("doc_id"), F.lit(',"source":"'), F.col("source"), F.lit('"}'))
    return reports.content_digest(t.documents, line, "lang")


@query("sample_hash", "SELECT conv_id, sha256('[' || string_agg(turn || ':' || role, ',' ORDER BY turn, role) || ']') AS digest FROM conversations GROUP BY 1")
def sample_hash(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    joined = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["turn"], x["role"])), ",")
    return t.conversations.groupBy("conv_id").agg(F.sha2(F.concat(F.lit("["), joined, F.lit("]")), 256).alias("digest"))


@query("class_weights", "SELECT lang, count(*) AS n, least(10.0, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)) AS weight FROM documents GROUP BY 1")
def class_weights(t):
    return reports.class_weights(t.documents, "lang").withColumn("weight", F.round("weight", 6))


@query(
    "component_share",
    """WITH s AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER w AS total, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, l_suppkey) AS k FROM s WINDOW w AS (PARTITION BY l_returnflag, l_linestatus))
    SELECT l_returnflag || l_linestatus AS label, CAST(total AS BIGINT) AS rows, l_suppkey AS largest, n AS largest_rows, round(n / total, 6) AS share, CASE WHEN n / total <= 0.012 THEN 'ok' WHEN l_returnflag || l_linestatus = 'AF' THEN 'blocker' ELSE 'stop' END AS status FROM r WHERE k = 1""",
)
def component_share(t):
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("label"), "l_suppkey")
    out = reports.largest_share(rows, "label", "l_suppkey", 0.012, t.values([("AF",)], "label string"))
    return out.withColumn("share", F.round("share", 6))


RULES = [(1, "rows", ">=", 1000.0), (2, "langs", "=", 4.0), (3, "empty_rate", "<=", 0.01), (4, "missing", ">=", 0.0), (5, "max_chars", "<=", 10.0)]


@query(
    "gate_report",
    f"""WITH m AS (SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'langs', count(DISTINCT lang) FROM documents UNION ALL SELECT 'empty_rate', avg(CASE WHEN n_chars = 0 THEN 1.0 ELSE 0.0 END) FROM documents UNION ALL SELECT 'max_chars', max(n_chars) FROM documents)
    SELECT CAST(seq AS BIGINT) AS seq, r.metric, value, coalesce(CASE op WHEN '>=' THEN value >= bound WHEN '<=' THEN value <= bound WHEN '=' THEN value = bound END, false) AS passed FROM (VALUES {values_sql(RULES)}) AS r(seq, metric, op, bound) LEFT JOIN m USING (metric)""",
)
def gate_report(t):
    one = t.documents.agg(rows_count().cast("double").alias("rows"), F.count_distinct("lang").cast("double").alias("langs"), F.avg(F.when(F.col("n_chars") == 0, 1.0).otherwise(0.0)).alias("empty_rate"), F.max("n_chars").cast("double").alias("max_chars"))
    metrics = one.unpivot([], ["rows", "langs", "empty_rate", "max_chars"], "metric", "value")
    return reports.gate(t.values(RULES, "seq long, metric string, op string, bound double"), metrics)


# ---------------------------------------------------------------- joins


ALIASES = [("deutschland", "germany"), ("great britain", "united kingdom"), ("usa", "united states")]


@query(
    "alias_lookup",
    f"""WITH a(alias, target) AS (VALUES {values_sql(ALIASES)}), k AS (SELECT lower(n_name) AS key, min(n_nationkey) AS id FROM nation GROUP BY 1), q AS (SELECT lower(n_name) AS name FROM nation UNION SELECT alias FROM a UNION SELECT 'nowhere')
    SELECT q.name, coalesce(k.id, k2.id) AS id FROM q LEFT JOIN k ON k.key = q.name LEFT JOIN a ON a.alias = q.name LEFT JOIN k k2 ON k2.key = a.target""",
)
def alias_lookup(t):
    names = t.nation.select(F.lower("n_name").alias("key"), F.col("n_nationkey").alias("id"), F.lit(1).alias("priority"))
    aliases = t.values(ALIASES, "alias string, target string")
    asked = names.select(F.col("key").alias("name")).union(aliases.select("alias")).union(t.values([("nowhere",)], "name string")).distinct()
    return lookups.alias_lookup(asked, "name", names, aliases.withColumnRenamed("alias", "key"))


@query(
    "meta_join_first_wins",
    """WITH f AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem)
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN f.l_returnflag ELSE o_orderstatus END AS flag, f.l_orderkey IS NOT NULL AS matched FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey AND k = 1""",
)
def meta_join_first_wins(t):
    base = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise("").alias("flag"))
    meta = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return lookups.fill_from_first(base, "o_orderkey", meta, ["flag"], "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").select("o_orderkey", "flag", "matched")


@query("evidence_override", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) AS k FROM labels) l ON l.doc_id = d.doc_id AND l.k = 1")
def evidence_override(t):
    base = t.documents.select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return lookups.override(base, "doc_id", t.labels, ["quality", "toxic"], F.desc("quality"), F.desc("toxic")).select("doc_id", "quality", "toxic")


@query("benchmark_exclusion", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM (SELECT [x FOR x IN string_split(text, chr(10)) IF length(x) >= 20] AS l FROM benchmark) b WHERE list_has_any(string_split(d.text, chr(10)), b.l))")
def benchmark_exclusion(t):
    lines = F.split("text", "\n")
    reference = t.benchmark.select(F.explode(lines).alias("token")).where(F.length("token") >= 20)
    return lookups.excluded(t.documents.select("doc_id", "text"), lines, reference).select("doc_id")


WINDOW8 = "[array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)]"
SPLIT_OF = "CAST(('0x' || left(sha256('s' || CAST({} AS VARCHAR)), 8)) AS BIGINT) / 4294967296.0"


@query(
    "benchmark_leak_gate",
    f"""WITH b AS (SELECT item_id, unnest({WINDOW8}) AS g FROM (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark) WHERE len(w) >= 8),
    d AS (SELECT doc_id, unnest({WINDOW8}) AS g FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS w FROM documents WHERE {SPLIT_OF.format("doc_id")} < 0.15) WHERE len(w) >= 8)
    SELECT item_id, count(DISTINCT doc_id) AS docs, min(doc_id) AS example FROM b JOIN d USING (g) GROUP BY 1""",
)
def benchmark_leak_gate(t):
    """Items that share eight words in a row with a document of the test split: no rows when nothing leaks."""
    def windows(df, key):
        w = F.col("w")
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.array_join(F.slice(w, i, 8), " "))
        return df.select(key, F.split("text", r"\s+").alias("w")).where("size(w) >= 8").select(key, F.explode(grams).alias("g"))

    test = t.documents.where(splitting.hashed_split(F.col("doc_id"), salt="s") == "test")
    items = lookups.sent(windows(t.benchmark, "item_id").distinct())
    return windows(test, "doc_id").join(items, "g").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("example"))


@query("poison_anti", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1 AND sha256(d.text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def poison_anti(t):
    labelled = t.documents.select("doc_id", F.sha2("text", 256).alias("digest")).join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return lookups.without_tainted(labelled, "digest", F.col("toxic") == 1).select("doc_id")


@query("relational_division", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def relational_division(t):
    return lookups.divided(t.orders.select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", t.orders.select("o_orderpriority"))


@query(
    "positional_agreement",
    "SELECT label, count(*) AS n, sum(CASE WHEN a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL AND a.label = b.l THEN 1 ELSE 0 END)::BIGINT AS agree, sum(CASE WHEN b.vec_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS alone FROM embeddings a LEFT JOIN (SELECT vec_id + 1 AS vec_id, label AS l FROM embeddings) b USING (vec_id) GROUP BY 1",
)
def positional_agreement(t):
    own = t.embeddings.select("vec_id", "label")
    moved = t.embeddings.select((F.col("vec_id") + 1).alias("vec_id"), F.col("label").alias("l"))
    both = lookups.by_position(own, moved, "vec_id").where("label IS NOT NULL")
    agree = F.coalesce(F.col("label") == F.col("l"), F.lit(False)).cast("long")
    return both.groupBy("label").agg(rows_count().alias("n"), F.sum(agree).alias("agree"), F.sum(F.col("l").isNull().cast("long")).alias("alone"))


# ---------------------------------------------------------------- components and duplicates


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS row, 'n' || c_nationkey || ':' || (c_custkey // 40) AS key FROM customer UNION SELECT c_custkey, 's' || c_mktsegment || ':' || (c_custkey // 25) FROM customer),
    l AS (SELECT DISTINCT a.row AS a, b.row AS b FROM e a JOIN e b USING (key)),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT a AS c_custkey, min(b) AS component FROM r GROUP BY 1""",
)
def components(t):
    return _linked_customers(t.customer)


def _linked_customers(customers):
    key = F.col("c_custkey")
    keys = F.array(F.concat(F.lit("n"), "c_nationkey", F.lit(":"), F.floor(key / 40)), F.concat(F.lit("s"), "c_mktsegment", F.lit(":"), F.floor(key / 25)))
    return graph.linked_rows(customers.select("c_custkey", keys.alias("keys")), "c_custkey", "keys")


@query("components_whole")
def components_whole(t):
    """The same as ``components``, held against union-find by a test."""
    return _linked_customers(t.customer)


@query("component_names")
def component_names(t):
    """Names of the customers' components by a salted digest; tests hold them against Python's hmac."""
    return t.customer.select("c_custkey", graph.hashed_name(F.concat_ws("\n", F.array_sort(F.array("c_name", "c_mktsegment"))), "salt").alias("name"))


@query("class_conflicts", "SELECT sha256(text) AS digest, string_agg(DISTINCT source, ',' ORDER BY source) AS labels FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def class_conflicts(t):
    return dedup.conflicts(t.documents.select(F.sha2("text", 256).alias("digest"), "source"), "digest", "source").select("digest", F.array_join("labels", ",").alias("labels"))


@query("exact_dedup_keep_largest", "SELECT lang, doc_id, n_chars, slot FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS slot, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def exact_dedup_keep_largest(t):
    return exact_dedup_whole_text(t)


@query("exact_dedup_whole_text", "SELECT lang, doc_id, n_chars, slot FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS slot, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def exact_dedup_whole_text(t):
    rows = t.documents.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
    return dedup.keep_largest(rows, ["lang", "digest"], "n_chars", "doc_id").select("lang", "doc_id", "n_chars", "slot")


def _bits(df):
    """A 64-bit pattern of the signs of a vector."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return df.select("vec_id", "label", bits.alias("hash"))


@query("sign_hash", "SELECT vec_id, label, CAST(length([x FOR x IN embedding IF x > 0]) AS INTEGER) AS ones FROM embeddings")
def sign_hash(t):
    return _bits(t.embeddings).select("vec_id", "label", F.bit_count("hash").alias("ones"))


NEAR_SQL = (
    "WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9à-ž]+') AS w FROM documents), "
    "c AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS word FROM w) GROUP BY ALL), "
    "d AS (SELECT doc_id, lang, n, CAST('0x' || left(md5(word), 15) AS BIGINT) AS d FROM c), "
    "h AS (SELECT doc_id, lang, CAST("
    + " + ".join(f"CASE WHEN 2 * sum(n * ((d >> {i}) & 1)) > sum(n) THEN {1 << i} ELSE 0 END" for i in range(60))
    + " AS BIGINT) AS h FROM d GROUP BY ALL), "
    "k AS (SELECT lang, h, min(doc_id) AS class, count(*) AS n FROM h GROUP BY ALL), "
    "l AS (SELECT a.lang, a.h, a.class, CAST(a.n - 1 + coalesce(sum(b.n), 0) AS BIGINT) AS links FROM k a LEFT JOIN k b ON b.lang = a.lang AND b.h <> a.h AND bit_count(xor(a.h, b.h)) <= 2 GROUP BY a.lang, a.h, a.class, a.n) "
    "SELECT d.doc_id, coalesce(l.class, d.doc_id) AS class, coalesce(l.links, 0) AS links FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN l ON l.lang = h.lang AND l.h = h.h"
)


@query("near_dup_pairs", NEAR_SQL)
def near_dup_pairs(t):
    """Documents within two bits of a simhash of all their words: each one's class of equal hashes and its number of links."""
    hashes = dedup.word_bits(t.documents, "doc_id", F.col("text"), "lang")
    return dedup.near_classes(hashes, "doc_id", ["lang"], "hash").withColumnRenamed("row", "doc_id")


def _whole_text_hash(t):
    """A 64-bit simhash of a text's words."""
    return t.documents.select("doc_id", "lang", "n_chars", "text").mapInArrow(dedup.text_hashes, "doc_id long, lang string, n_chars long, hash long")


@query("near_dup_pairs_whole_text")
def near_dup_pairs_whole_text(t):
    """Near classes by a 64-bit simhash made in batches; tests hold them against brute force."""
    return dedup.near_classes(_whole_text_hash(t), "doc_id", ["lang"], "hash").withColumnRenamed("row", "doc_id")


@query("near_dup_greedy")
def near_dup_greedy(t):
    place = F.lit(1 << 50) - F.col("n_chars") * F.lit(1 << 30) + F.col("doc_id")  # larger texts first
    return dedup.greedy_drop_hashes(_whole_text_hash(t).withColumn("position", place), "doc_id", ["lang"], "hash", "position")


@query(
    "strict_winner",
    """WITH d AS (SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY d.text) AS c, coalesce(l.q, 0) AS q FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id))
    SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN 'kept' WHEN q < max(q) OVER (PARTITION BY c) THEN 'looser_license' ELSE 'duplicate_photo_id' END AS verdict FROM d WINDOW w AS (PARTITION BY c ORDER BY q DESC, doc_id)""",
)
def strict_winner(t):
    quality = t.labels.groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("digest")).join(quality, "doc_id", "left").withColumn("q", F.coalesce("q", F.lit(0)))
    return dedup.strictest(rows, "digest", "q", "doc_id").select("doc_id", "verdict")


# ---------------------------------------------------------------- caps, fills, guards


@query("per_key_cap", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k <= 2")
def per_key_cap(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return caps.per_key(rows, ["l_orderkey"], 2, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(
    "priority_fill",
    """WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN n_regionkey = 3 THEN 1 ELSE 2 END AS pass FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT c_custkey, c_mktsegment, pass FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY pass, c_custkey) AS k FROM c) WHERE k <= 80""",
)
def priority_fill(t):
    nation = t.nation.select("n_nationkey", "n_regionkey")
    rows = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.when(F.col("n_regionkey") == 3, 1).otherwise(2).alias("pass"))
    return caps.priority_fill(rows, "c_custkey", ["c_mktsegment"], "pass", "c_custkey", 80)


ISLANDS = "WITH g AS (SELECT event_id, user_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, user_id, event_type, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM g"


@query("event_islands", ISLANDS)
def event_islands(t):
    return caps.islands(t.events.select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id")


@query(
    "collector_cap",
    f"""WITH RECURSIVE i AS ({ISLANDS}), s AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2),
    f AS (SELECT user_id, island, CASE WHEN n <= 30 THEN 30 - n ELSE 0 END AS room, true AS taken FROM s WHERE island = 1
          UNION ALL SELECT s.user_id, s.island, CASE WHEN s.n <= f.room THEN f.room - s.n ELSE f.room END, s.n <= f.room FROM f JOIN s ON s.user_id = f.user_id AND s.island = f.island + 1)
    SELECT event_id, user_id, event_type FROM (SELECT i.*, row_number() OVER (PARTITION BY i.user_id, i.island ORDER BY event_id) AS k FROM i JOIN f USING (user_id, island) WHERE taken) WHERE k <= 30""",
)
def collector_cap(t):
    return caps.whole_islands(t.events.select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id", 30).select("event_id", "user_id", "event_type")


@query(
    "unsafe_rate_guard",
    """WITH r AS (SELECT user_id, event_id, count(*) OVER w AS attempts, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, attempts, CAST(bad AS BIGINT) AS unsafe_so_far, max(attempts >= 20 AND bad > 0.05 * attempts) OVER (PARTITION BY user_id ORDER BY event_id) AS aborted FROM r""",
)
def unsafe_rate_guard(t):
    rows = t.events.select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return caps.unsafe_guard(rows, ["user_id"], "event_id", "bad").drop("bad")


STREAK = "SELECT event_id, user_id, bad, CASE WHEN bad THEN row_number() OVER (PARTITION BY user_id, b ORDER BY event_id) - CASE WHEN first_value(bad) OVER (PARTITION BY user_id, b ORDER BY event_id) THEN 0 ELSE 1 END ELSE 0 END AS streak FROM (SELECT event_id, user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)"


@query("failure_streak", f"SELECT event_id, user_id, CAST(streak AS BIGINT) AS streak FROM ({STREAK})")
def failure_streak(t):
    rows = t.events.select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return caps.failure_streaks(rows, ["user_id"], "event_id", "bad").select("event_id", "user_id", "streak")


@query(
    "fill_to_cap",
    f"""WITH s AS ({STREAK}), r AS (SELECT *, coalesce(sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER w, 0) AS good, coalesce(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER w, 0) AS failed, coalesce(max(streak) OVER w, 0) AS longest FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, user_id, NOT bad AS ok FROM r WHERE good < 10 AND failed < 30 AND longest < 4""",
)
def fill_to_cap(t):
    rows = t.events.select("event_id", "user_id", (F.col("event_type") != "error").alias("ok"))
    return caps.fill_to_cap(rows, ["user_id"], "event_id", "ok", 10, streak=4)


QUOTA_SQL = """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size <= 5 THEN 1 ELSE 0 END AS f FROM part),
    a AS (SELECT *, coalesce(sum(f) OVER u, 0) AS ahead, coalesce(sum(1 - f) OVER u, 0) AS place, greatest(0, 500 - sum(f) OVER w * 20) AS room, sum(1 - f) OVER w AS others FROM p WINDOW w AS (PARTITION BY p_brand), u AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, CASE WHEN f = 0 THEN greatest(0, least(greatest(1, least(30, room // greatest(others, 1))), room - place * greatest(1, least(30, room // greatest(others, 1))))) END AS even FROM a),
    c AS (SELECT *, greatest(0, room - coalesce(sum(even) OVER w, 0)) AS spare, coalesce(sum(30 - even) OVER u, 0) AS used FROM b WINDOW w AS (PARTITION BY p_brand), u AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT p_partkey, p_brand, f = 1 AS first, CAST(CASE WHEN f = 1 THEN greatest(0, least(20, 500 - ahead * 20)) ELSE even + greatest(0, least(30 - even, spare - used)) END AS BIGINT) AS quota FROM c"""


@query("fetch_quota", QUOTA_SQL)
def fetch_quota(t):
    rows = t.part.select("p_partkey", "p_brand", (F.col("p_size") <= 5).alias("first"))
    return caps.quotas(rows, ["p_brand"], "p_partkey", "first", 500, 30, 20)


# ---------------------------------------------------------------- splits


SPLIT_SQL = "CAST(('0x' || left(sha256('s' || CAST(o_custkey AS VARCHAR)), 8)) AS BIGINT) / 4294967296.0"


@query("split_assign_hash", f"SELECT o_orderkey, CASE WHEN {SPLIT_SQL} < 0.15 THEN 'test' WHEN {SPLIT_SQL} < 0.30 THEN 'val' ELSE 'train' END AS split FROM orders")
def split_assign_hash(t):
    return t.orders.select("o_orderkey", splitting.hashed_split(F.col("o_custkey"), salt="s").alias("split"))


@query(
    "split_integrity",
    """WITH s AS (SELECT o_custkey, CASE WHEN {0} < 0.15 THEN 'test' WHEN {0} < 0.30 THEN 'val' ELSE 'train' END AS split FROM orders)
    SELECT o_custkey, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""".format(SPLIT_OF.format("o_orderkey")),
)
def split_integrity(t):
    """Customers whose orders lie in several splits when orders are split one by one."""
    rows = t.orders.select("o_custkey", splitting.hashed_split(F.col("o_orderkey"), salt="s").alias("split"))
    return splitting.broken(rows, "o_custkey").select("o_custkey", F.array_join("splits", ",").alias("splits"))


@query("split_integrity_kept", "SELECT 0 AS broken, count(DISTINCT o_custkey) AS customers, count(*) AS rows FROM orders")
def split_integrity_kept(t):
    """None is broken when the customer decides."""
    rows = t.orders.select("o_custkey", splitting.hashed_split(F.col("o_custkey"), salt="s").alias("split"))
    per = rows.groupBy("o_custkey").agg(F.count_distinct("split").alias("k"), rows_count().alias("n"))
    return per.agg(F.count_if(F.col("k") > 1).cast("int").alias("broken"), rows_count().alias("customers"), F.sum("n").alias("rows"))


@query(
    "split_assign_exact",
    """WITH p AS (SELECT left(sha256(text), 16) AS c, min(lang) AS class, count(*) AS n, bool_or(contains(text, '@')) AS blocked FROM documents GROUP BY 1),
    q AS (SELECT *, sha256('0:' || class || ':' || c) AS place, sum(n) OVER (PARTITION BY class) AS rows, count(*) OVER (PARTITION BY class) AS parts FROM p),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY blocked, place, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
    s AS (SELECT *, parts >= 3 AND NOT blocked AND before < round_even(rows * 0.15, 0) AND before + n < rows AS test FROM r),
    u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY place, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later, sum(n) OVER (PARTITION BY class) AS rest FROM s WHERE NOT test)
    SELECT doc_id, CASE WHEN s.test THEN 'test' WHEN s.parts >= 3 AND later < round_even(s.rows * 0.15, 0) AND later + s.n < rest THEN 'val' ELSE 'train' END AS split
    FROM documents d JOIN s ON s.c = left(sha256(d.text), 16) LEFT JOIN u ON u.c = s.c""",
)
def split_assign_exact(t):
    """Copies stay together, and a text with an address is never tested on."""
    rows = t.documents.select("doc_id", "lang", F.substring(F.sha2("text", 256), 1, 16).alias("component"), F.contains("text", F.lit("@")).alias("blocked"))
    return splitting.split_components(rows, "lang", "component", F.col("blocked")).select("doc_id", "split")


# ---------------------------------------------------------------- array metrics



def logits():
    return F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10.0)


L = "[CAST(x AS DOUBLE) * 10.0 FOR x IN embedding[1:10]]"
ENERGY_SQL = "-(m + ln(list_sum([exp(x - m) FOR x IN l])))"


def _ranked(t):
    return t.embeddings.select("vec_id", "label", arrays.ranking(logits()).alias("order"), arrays.energy(logits()).alias("energy"), F.array_max(arrays.softmax(logits())).alias("best"))


PREDICTED = f"SELECT vec_id, label, l, {ENERGY_SQL} AS energy FROM (SELECT vec_id, label, {L} AS l, list_max({L}) AS m FROM embeddings)"
ORDERED = "SELECT vec_id, label, energy, [s.i FOR s IN list_sort([{'v': -l[i + 1], 'i': i} FOR i IN range(10)])] AS o FROM p"


@query("softmax_energy", f"SELECT vec_id, round(energy, 6) AS energy, round(exp(list_max(l) + energy), 6) AS best FROM ({PREDICTED})")
def softmax_energy(t):
    return _ranked(t).select("vec_id", F.round("energy", 6).alias("energy"), F.round("best", 6).alias("best"))


CLASSES = [f"c{i}" for i in range(10)]
GATE = {"energy_threshold": -3.5, "floor": 0.2, "high": 0.4, "margin": 0.05, "background": "c9", "unknown": "c8", "dangerous": ["g1"]}


@query(
    "decide_topk",
    f"""WITH p AS ({PREDICTED}), q AS (SELECT vec_id, o, energy, [exp(x + energy) FOR x IN l] AS pr FROM ({ORDERED.replace("SELECT vec_id", "SELECT l, vec_id")})),
    d AS (SELECT *, pr[o[1] + 1] AS best, pr[o[2] + 1] AS second, [i FOR i IN o IF i < 8][1:3] AS top FROM q),
    r AS (SELECT *, CASE WHEN o[1] = 9 OR energy > -3.5 THEN 'not_a_species' WHEN o[1] = 8 AND best >= 0.2 THEN 'unknown_species' WHEN best < 0.2 THEN 'unclear' ELSE '' END AS reason FROM d)
    SELECT vec_id, CASE WHEN reason = '' THEN 'candidates' ELSE 'rejected' END AS status, reason, 'c' || o[1] AS top, 'c' || top[1] || ',c' || top[2] || ',c' || top[3] AS top3, best < 0.4 OR best - second < 0.05 AS low_confidence,
    top[1] IN (1, 2) OR (top[2] IN (1, 2) AND pr[top[2] + 1] >= 0.10) OR (top[3] IN (1, 2) AND pr[top[3] + 1] >= 0.10) AS dangerous FROM r""",
)
def decide_topk(t):
    d = arrays.decide(logits(), CLASSES, {"c1": "g1", "c2": "g1"}, GATE)
    rows = t.embeddings.select("vec_id", d.alias("d"))
    return rows.select("vec_id", "d.status", "d.reason", "d.top", F.array_join("d.top3", ",").alias("top3"), "d.low_confidence", "d.dangerous")


@query("topk_accuracy", f"WITH p AS ({PREDICTED}), o AS ({ORDERED}), k AS (SELECT unnest(range(12))::INTEGER AS label) SELECT k.label, count(o.label) AS support, round(avg(CASE WHEN o.label IS NULL THEN NULL WHEN o.o[1] = o.label THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN o.label IS NULL THEN NULL WHEN list_contains(o.o[1:3], o.label) THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM k LEFT JOIN o ON o.label = k.label GROUP BY 1")
def topk_accuracy(t):
    labels = t.spark.range(12).select(F.col("id").cast("int").alias("label"))
    return reports.accuracy(_ranked(t), "label", "order", labels).select("label", "support", F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"))


@query("confusion_pairs", f"WITH p AS ({PREDICTED}), o AS ({ORDERED}) SELECT label, o[1]::INTEGER AS guess, count(*) AS n, round(count(*) / any_value(total), 6) AS rate FROM (SELECT *, count(*) OVER (PARTITION BY label) AS total FROM o) WHERE label <> o[1] GROUP BY 1, 2")
def confusion_pairs(t):
    rows = _ranked(t).select("label", F.element_at("order", 1).alias("guess"))
    return reports.confusions(rows, "label", "guess").withColumn("rate", F.round("rate", 6))


@query("keep_threshold", f"SELECT count(*) AS n, round(max(energy), 6) AS threshold FROM (SELECT energy, row_number() OVER (ORDER BY energy) AS k, count(*) OVER () AS c FROM ({PREDICTED})) WHERE k <= greatest(1, ceil(0.97 * c - 1e-9))".replace("count(*) AS n,", "any_value(c) AS n,"))
def keep_threshold(t):
    return reports.keep_threshold(_ranked(t), "energy").withColumn("threshold", F.round("threshold", 6))


@query("keep_rate", f"SELECT label, round(avg(CASE WHEN energy <= -3.2 THEN 1.0 ELSE 0.0 END), 6) AS kept FROM ({PREDICTED}) GROUP BY 1")
def keep_rate(t):
    return _ranked(t).groupBy("label").agg(F.round(F.avg((F.col("energy") <= -3.2).cast("double")), 6).alias("kept"))


@query(
    "wilson_bounds",
    """WITH c AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS DOUBLE) AS s FROM events GROUP BY 1), b AS (SELECT *, s / n AS p, 1.959963984540054 * 1.959963984540054 AS z2 FROM c)
    SELECT event_type, round(greatest(0.0, ((p + z2 / (2.0 * n)) - 1.959963984540054 * sqrt((p * (1.0 - p) + z2 / (4.0 * n)) / n)) / (1.0 + z2 / n)), 6) AS lower, round(least(1.0, ((p + z2 / (2.0 * n)) + 1.959963984540054 * sqrt((p * (1.0 - p) + z2 / (4.0 * n)) / n)) / (1.0 + z2 / n)), 6) AS upper FROM b""",
)
def wilson_bounds(t):
    counts = t.events.groupBy("event_type").agg(rows_count().alias("n"), F.sum((F.col("value") > 100).cast("long")).alias("s"))
    low, high = arrays.wilson(F.col("s"), F.col("n"))
    return counts.select("event_type", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


@query("bootstrap_bounds")
def bootstrap_bounds(t):
    counts = t.events.groupBy("event_type").agg(rows_count().alias("n"), F.sum((F.col("value") > 100).cast("long")).alias("s"))
    return reports.bootstrap(counts, "s", "n", "event_type")


@query("image_hashes")
def image_hashes(t):
    grey = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.element_at("embedding", i % F.size("embedding") + 1).cast("double") * 100)
    return t.embeddings.select(F.col("vec_id").alias("row"), grey.alias("grey")).mapInPandas(dedup.hash_bits, "row long, average long, difference long, perceptual long")


# ---------------------------------------------------------------- facets and journal

BAND = "CASE WHEN p_size IS NULL OR p_size % 7 = 0 THEN NULL WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'medium' ELSE 'large' END"


@query(
    "facet_filter",
    f"""WITH p AS (SELECT p_partkey, p_brand, p_type, {BAND} AS band FROM part), f AS (SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') THEN 0 ELSE 2 END AS a, CASE WHEN band IS NULL THEN 1 WHEN band IN ('small', 'large') THEN 0 WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END AS b FROM p)
    SELECT p_partkey, CASE WHEN greatest(a, b) = 0 THEN 'match' ELSE 'unverified' END AS outcome FROM f WHERE greatest(a, b) < 2""",
)
def facet_filter(t):
    size = F.col("p_size")
    band = F.when(size % 7 == 0, None).when(size <= 15, "small").when(size <= 35, "medium").otherwise("large")
    outcomes = [facets.facet(F.array("p_brand"), ["Brand#11", "Brand#12", "Brand#13", "Brand#21"]), facets.facet(F.array(band), ["small", "large"], F.col("p_partkey") % 5 == 0)]
    return facets.filtered(t.part.select("p_partkey", "p_brand", "p_size"), outcomes).select("p_partkey", "outcome")


@query("facet_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), 'brand#1')")
def facet_search(t):
    return t.part.where(facets.found("1", [F.col("p_name")]) | facets.found("BRAND#1", [], [F.array("p_brand")])).select("p_partkey")


@query("journal_upsert", "SELECT conv_id, turn, role, coalesce(n, length(text)) AS n FROM conversations LEFT JOIN (SELECT conv_id AS c, turn AS t, 0 AS n FROM conversations WHERE turn = 1) ON c = conv_id AND t = turn GROUP BY ALL")
def journal_upsert(t):
    key = F.concat_ws(":", "conv_id", "turn")
    base = t.conversations.select(key.alias("key"), "conv_id", "turn", "role", F.length("text").cast("long").alias("n")).distinct()
    updates = base.where("turn = 1").withColumn("n", F.lit(0).cast("long")).distinct()
    return journal.upsert(base, updates, "key").drop("key")


@query("journal_retain_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'signup' DESC, event_id DESC) AS k FROM events) WHERE k <= 8")
def journal_retain_n(t):
    return journal.newest(t.events.select("user_id", "event_id", "event_type"), ["user_id"], 8, F.col("event_type") == "signup", F.desc("event_id")).select("user_id", "event_id")


@query("journal_delete", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'seen' ELSE c_mktsegment END AS note FROM customer WHERE c_custkey <> 3")
def journal_delete(t):
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("note"))
    return journal.with_note(journal.without(rows, "c_custkey", 3), "c_custkey", 7, "note", " seen ")


# ---------------------------------------------------------------- flagship


@query(
    "curated_documents",
    """WITH d AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k, list_has_any(string_split(text, chr(10)), (SELECT list(x) FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE length(x) >= 20)) AS leaked FROM documents),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS s FROM d WHERE k = 1 AND NOT leaked)
    SELECT lang, coalesce(q, -1) AS quality, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM c LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id) WHERE s <= 30 GROUP BY 1, 2""",
)
def curated_documents(t):
    """Exact copies go, then documents with a benchmark line, then what exceeds a cap per source; the rest is counted by label."""
    lines = F.split("text", "\n")
    docs = t.documents.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("digest"), lines.alias("lines"))
    held = t.benchmark.select(F.explode(lines).alias("token")).where(F.length("token") >= 20)
    leaked = docs.select("doc_id", F.explode("lines").alias("token")).join(held, "token", "left_semi").select("doc_id").distinct()
    single = lookups.first_per(docs.drop("lines"), ["digest"], "doc_id").join(leaked, "doc_id", "left_anti")
    capped = caps.per_key(single, ["source"], 30, F.desc("n_chars"), "doc_id")
    quality = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = capped.join(quality, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))
    return joined.groupBy("lang", "quality").agg(rows_count().alias("n"), F.sum("n_chars").alias("chars"))
