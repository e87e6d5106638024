"""Queries on evaluation reports and the gates of a release."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, names
from ..operators import evaluation, gates, images, importing, lookups, reports
from ..operators.graph import checkpointed
from .base import query, values_sql
from .records import CLASSES, ENERGY_SQL, GATE, PREDICTED, L, logits

DECIDED = f"""p AS ({PREDICTED}), q AS (SELECT vec_id, label, energy, [s.i FOR s IN list_sort([{{'v': -l[i + 1], 'i': i}} FOR i IN range(10)])] AS o, [exp(x + energy) FOR x IN l] AS pr FROM p),
    w AS (SELECT *, pr[o[1] + 1] AS best, pr[o[2] + 1] AS second, [i FOR i IN o IF i < 8][1:3] AS top FROM q),
    d AS (SELECT vec_id, label, energy, o, best, NOT (o[1] = 9 OR energy > -3.5 OR (o[1] = 8 AND best >= 0.2) OR best < 0.2) AS candidates, best < 0.4 OR best - second < 0.05 AS low, 'c' || top[1] AS first,
      top[1] IN (1, 2) OR (top[2] IN (1, 2) AND pr[top[2] + 1] >= 0.10) OR (top[3] IN (1, 2) AND pr[top[3] + 1] >= 0.10) AS dangerous FROM w)"""
EDIBLE = ["c3", "c4", "c5", "c6"]
EDIBLE_SQL = "('c3', 'c4', 'c5', 'c6')"
SAFE = "NOT candidates OR low OR dangerous"
CONFIDENT = f"candidates AND NOT low AND NOT dangerous AND first IN {EDIBLE_SQL}"
STRICT = f"candidates AND NOT low AND first IN {EDIBLE_SQL}"


def decided(t):
    d = arrays.decide(logits(), CLASSES, {"c1": "g1", "c2": "g1"}, GATE)
    return t.embeddings.select("vec_id", "label", arrays.energy(logits()).alias("energy"), arrays.ranking(logits()).alias("order"), d.alias("d"))


@query("decision_outcomes", f"WITH {DECIDED} SELECT vec_id, {SAFE} AS safe, {CONFIDENT} AS confident, {STRICT} AS strict FROM d")
def decision_outcomes(t):
    d = F.col("d")
    return decided(t).select("vec_id", evaluation.safe(d).alias("safe"), evaluation.confident(d, EDIBLE).alias("confident"), evaluation.strict_top(d, EDIBLE).alias("strict"))


WILSON = "round(greatest(0.0, ((p + z / (2.0 * n)) - 1.959963984540054 * sqrt((p * (1.0 - p) + z / (4.0 * n)) / n)) / (1.0 + z / n)), 6) AS lower, round(least(1.0, ((p + z / (2.0 * n)) + 1.959963984540054 * sqrt((p * (1.0 - p) + z / (4.0 * n)) / n)) / (1.0 + z / n)), 6) AS upper"


@query(
    "open_set_buckets",
    f"""WITH {DECIDED}, e AS (SELECT CAST(unnest([0, 1, 2, 3, 4, 5, 77]) AS INTEGER) AS label), g AS (SELECT label, count(*) AS support, CAST(sum(CASE WHEN {SAFE} THEN 1 ELSE 0 END) AS BIGINT) AS safe, CAST(sum(CASE WHEN {CONFIDENT} THEN 1 ELSE 0 END) AS BIGINT) AS confident FROM d GROUP BY 1),
    j AS (SELECT coalesce(e.label, g.label) AS label, e.label IS NOT NULL AS expected, coalesce(support, 0) AS support, coalesce(safe, 0) AS safe, coalesce(confident, 0) AS confident FROM e FULL JOIN g ON g.label = e.label),
    b AS (SELECT *, CAST(support AS DOUBLE) AS n, safe / support AS p, 1.959963984540054 * 1.959963984540054 AS z FROM j WHERE support > 0), c AS (SELECT label, {WILSON} FROM b)
    SELECT label, expected, support, safe, confident, lower, upper, coalesce(lower < 0.9, true) AS below FROM j LEFT JOIN c USING (label)""",
)
def open_set_buckets(t):
    """Safe and confident outcomes of every expected name, also of those that were never met, with bounds of the safe rate."""
    expected = t.values([(i,) for i in (0, 1, 2, 3, 4, 5, 77)], "label int")
    d = F.col("d")
    out = evaluation.buckets(decided(t), "label", expected, {"safe": evaluation.safe(d), "confident": evaluation.confident(d, EDIBLE)}, "safe")
    out = out.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})
    return out.withColumn("below", F.coalesce(F.col("lower") < 0.9, F.lit(True)))


@query(
    "steal_rates",
    f"WITH {DECIDED}, c AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS label) SELECT c.label, count(d.label) AS support, CAST(count(*) FILTER (WHERE o[1] IN (8, 9)) AS BIGINT) AS taken, round(count(*) FILTER (WHERE o[1] IN (8, 9)) / nullif(count(d.label), 0), 6) AS rate FROM c LEFT JOIN d ON d.label = c.label GROUP BY 1",
)
def steal_rates(t):
    """How often the hidden classes take rows from each class; a class without rows keeps its row."""
    classes = t.spark.range(12).select(F.col("id").cast("int").alias("label"))
    return evaluation.steal_rates(decided(t), "label", "order", F.element_at("order", 1).isin(8, 9), classes).withColumn("rate", F.round("rate", 6))


@query("confident_toxic", f"WITH {DECIDED} SELECT CAST(count(*) FILTER (WHERE label IN (1, 2) AND {CONFIDENT}) AS BIGINT) AS confident, CAST(count(*) FILTER (WHERE label IN (1, 2)) AS BIGINT) AS toxic FROM d")
def confident_toxic(t):
    return _confident_toxic(decided(t))


def _confident_toxic(rows):
    toxic = F.col("label").isin(1, 2)
    return rows.agg(F.count_if(toxic & evaluation.confident(F.col("d"), EDIBLE)).alias("confident"), F.count_if(toxic).alias("toxic"))


REPORT = f"""{DECIDED}, v AS (SELECT max(energy) AS t FROM (SELECT energy, row_number() OVER (ORDER BY energy) AS k, count(*) OVER () AS c FROM d WHERE vec_id % 2 = 0) WHERE k <= greatest(1, ceil(0.97 * c - 1e-9))),
    a AS (SELECT label, avg(CASE WHEN o[1] = label THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN list_contains(o[1:3], label) THEN 1.0 ELSE 0.0 END) AS top3 FROM d WHERE vec_id % 2 = 1 GROUP BY 1),
    r AS (SELECT (SELECT avg(top1) FROM a WHERE label < 8) AS macro_top1, (SELECT avg(top3) FROM a WHERE label < 8) AS macro_top3, (SELECT t FROM v) AS threshold, (SELECT avg(CASE WHEN energy <= (SELECT t FROM v) THEN 1.0 ELSE 0.0 END) FROM d WHERE vec_id % 2 = 1) AS keep_rate,
      (SELECT CAST(count(*) FILTER (WHERE label IN (1, 2) AND {CONFIDENT}) AS DOUBLE) FROM d) AS confident_toxic),
    long AS (UNPIVOT r ON macro_top1, macro_top3, threshold, keep_rate, confident_toxic INTO NAME metric VALUE value)"""


def report(t):
    """The metrics of a report: rates on odd rows, the threshold fitted on even ones."""
    rows = checkpointed(decided(t))  # made once for all that follows
    fitted, held = rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")
    threshold = reports.keep_threshold(fitted, "energy").select("threshold")
    rates = held.groupBy("label").agg(
        evaluation.rate(F.element_at("order", 1) == F.col("label")).alias("top1"), evaluation.rate(F.array_contains(F.slice("order", 1, 3), F.col("label"))).alias("top3")
    )
    macro = rates.where("label < 8").agg(F.avg("top1").alias("macro_top1"), F.avg("top3").alias("macro_top3"))
    kept = held.join(F.broadcast(threshold)).agg(evaluation.rate(F.col("energy") <= F.col("threshold")).alias("keep_rate"))  # one row each from here on
    toxic = _confident_toxic(rows).select(F.col("confident").alias("confident_toxic"))
    one = macro.join(F.broadcast(threshold)).join(F.broadcast(kept)).join(F.broadcast(toxic))
    return evaluation.metrics(one.select("macro_top1", "macro_top3", "threshold", "keep_rate", "confident_toxic"))


@query("evaluation_report", f"WITH {REPORT} SELECT metric, round(value, 6) AS value FROM long")
def evaluation_report(t):
    return report(t).withColumn("value", F.round("value", 6))


@query("metric_delta", f"WITH {REPORT}, small AS (SELECT metric, CASE metric WHEN 'threshold' THEN NULL ELSE floor(value * 256 + 0.5) / 256 END AS value FROM long) SELECT metric, round(s.value - l.value, 6) AS delta FROM long l FULL JOIN small s USING (metric)")
def metric_delta(t):
    """A report against one with rounded values: right minus left, null unless both are finite."""
    full = report(t)
    small = full.select("metric", F.when(F.col("metric") != "threshold", names.half_up(F.col("value") * 256) / 256).otherwise(float("nan")).alias("value"))
    return evaluation.delta(full, small).withColumn("delta", F.round("delta", 6))


GATES = [(1, "macro_top1", ">=", 0.80), (2, "macro_top3", ">=", 0.90), (3, "keep_rate", ">=", 0.95), (4, "confident_toxic", "<=", 0.0), (5, "background_reject", ">=", 0.90)]


@query(
    "release_gates",
    f"""WITH {REPORT} SELECT CAST(seq AS BIGINT) AS seq, g.metric, round(value, 6) AS value, coalesce(CASE op WHEN '>=' THEN value >= bound ELSE value <= bound END, false) AS passed FROM (VALUES {values_sql(GATES)}) AS g(seq, metric, op, bound) LEFT JOIN long USING (metric)""",
)
def release_gates(t):
    """Floors of the report; a metric that nobody measured fails."""
    return reports.gate(t.values(GATES, "seq long, metric string, op string, bound double"), report(t)).withColumn("value", F.round("value", 6))


FLOORS = [(1, "0", 20), (2, "1", 60), (3, "2", 1000), (4, "12", 1), (5, "3", 10)]


@query(
    "class_floors",
    f"WITH c AS (SELECT CAST(label AS VARCHAR) AS name, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(seq AS BIGINT) AS seq, f.name, c.n AS value, CAST(floor AS BIGINT) AS floor FROM (VALUES {values_sql(FLOORS)}) AS f(seq, name, floor) LEFT JOIN c USING (name) WHERE n IS NULL OR n < floor",
)
def class_floors(t):
    counts = t.embeddings.groupBy(F.col("label").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return gates.below_floor(counts, t.values(FLOORS, "seq long, name string, floor long"), "name", "n")


GROUPS = [("a", "0"), ("a", "1"), ("b", "2"), ("b", "99"), ("c", "3"), ("c", "4"), ("c", "5")]


@query(
    "group_floors",
    f"WITH c AS (SELECT CAST(label AS VARCHAR) AS name, count(*) AS n FROM embeddings GROUP BY 1), g(grp, name) AS (VALUES {values_sql(GROUPS)}) SELECT grp, CASE WHEN count(*) = count(n) THEN CAST(sum(n) AS BIGINT) END AS total, coalesce(CASE WHEN count(*) = count(n) THEN sum(n) END < 16, true) AS short FROM g LEFT JOIN c USING (name) GROUP BY 1",
)
def group_floors(t):
    """Sums over groups; one missing member suppresses its group's sum."""
    counts = t.embeddings.groupBy(F.col("label").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return gates.group_floors(t.values(GROUPS, "grp string, name string"), counts, 16)


@query("credits_reconciled", "SELECT count(*) AS n, coalesce(bool_or(source = 'src0'), false) AS forbidden, count(*) = (SELECT count(DISTINCT doc_id) FROM documents) AS agrees FROM documents")
def credits_reconciled(t):
    announced = t.documents.agg(F.count_distinct("doc_id")).first()[0]  # one number
    return gates.reconciled(t.documents, announced, F.col("source") == "src0")


@query("credits_complete", "SELECT coalesce(bool_and(coalesce(trim(text), '') <> ''), false) AS complete, 'documents' AS what FROM documents UNION ALL SELECT coalesce(bool_and(false), false), 'none' FROM documents WHERE doc_id < 0")
def credits_complete(t):
    """All rows must hold, and an empty table doesn't."""
    filled = F.trim("text") != ""
    none = evaluation.every(t.documents.where("doc_id < 0"), filled).withColumn("what", F.lit("none"))
    return evaluation.every(t.documents, filled).withColumn("what", F.lit("documents")).unionByName(none)


@query(
    "energy_gate",
    f"""WITH e AS (SELECT vec_id, label, {ENERGY_SQL} AS energy FROM (SELECT vec_id, label, {L} AS l, list_max({L}) AS m FROM embeddings)), k AS (SELECT label, energy, row_number() OVER (PARTITION BY label ORDER BY energy) AS k, count(*) OVER (PARTITION BY label) AS c FROM e),
    r AS (SELECT label, max(c) AS n, max(energy) FILTER (WHERE k <= ceil(0.97 * c - 1e-9)) AS t FROM k GROUP BY 1)
    SELECT CAST(label AS INTEGER) AS label, n, CASE WHEN n < 8 THEN 'too_few' WHEN label % 4 = 0 THEN 'missing' WHEN label % 4 = 1 THEN 'differs' ELSE 'same' END AS outcome FROM r""",
)
def energy_gate(t):
    """Thresholds that were recorded for each label, some of other rows and some not at all, against those that the values give."""
    energies = t.embeddings.select("label", "vec_id", arrays.energy(logits()).alias("energy"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("energy"))
    size = F.count(F.lit(1)).over(Window.partitionBy("label"))
    ranked = energies.select("label", "energy", place.alias("k"), F.ceil(size * 0.97 - 1e-9).alias("at"))
    recorded = ranked.where(F.col("k") == F.col("at") - F.when(F.col("label") % 4 == 1, 1).otherwise(0)).where("label % 4 <> 0").select("label", F.col("energy").alias("recorded"))
    return gates.recorded_threshold(energies, "label", "energy", recorded)


@query(
    "device_agreement",
    f"""WITH {DECIDED}, s AS (SELECT vec_id - 1 AS vec_id, first AS f, candidates AS c, low AS l, dangerous AS g FROM d), j AS (SELECT d.*, s.* EXCLUDE vec_id FROM d JOIN s USING (vec_id)),
    r AS (SELECT avg(CASE WHEN candidates = c THEN 1.0 ELSE 0.0 END) AS status, avg(CASE WHEN low = l THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN first IS NOT DISTINCT FROM f THEN 1.0 ELSE 0.0 END) AS first, avg(CASE WHEN dangerous = g THEN 1.0 ELSE 0.0 END) AS dangerous FROM j)
    SELECT metric, round(value, 6) AS value, value >= 0.5 AS passed FROM (UNPIVOT r ON status, low, first, dangerous INTO NAME metric VALUE value)""",
)
def device_agreement(t):
    """Decisions on one device against those on another, position by position."""
    a = decided(t).select("vec_id", F.col("d").alias("a"))
    b = decided(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("d").alias("b"))
    pairs = lookups.by_position(a, b, "vec_id").where("a IS NOT NULL AND b IS NOT NULL")
    first = lambda d: F.get(d["top3"], 0)
    x, y = F.col("a"), F.col("b")
    rates = {"status": x["status"] == y["status"], "low": x["low_confidence"] == y["low_confidence"], "first": first(x).eqNullSafe(first(y)), "dangerous": x["dangerous"] == y["dangerous"]}
    return gates.agreement(pairs, rates, 0.5).withColumn("value", F.round("value", 6))


SHARES = [("AF",), ("RF",), ("ZZ",)]


@query(
    "share_blockers",
    """WITH s AS (SELECT l_returnflag || l_linestatus AS label, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT label, max(n) / sum(n) AS share FROM s GROUP BY 1), a(label) AS (VALUES ('AF'), ('RF'), ('ZZ'))
    SELECT label, CASE WHEN label IN (SELECT label FROM a) THEN 'blocker' ELSE 'stop' END AS kind FROM r WHERE share > 0.012""",
)
def share_blockers(t):
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("label"), "l_suppkey")
    known = t.values(SHARES, "label string")
    return gates.blockers(reports.largest_share(rows, "label", "l_suppkey", 0.012, known), known, "label")


@query(
    "install_target",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice < 200000 THEN 'small' WHEN o_totalprice > 100000 THEN 'full' ELSE 'none' END AS target FROM orders",
)
def install_target(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", gates.install_target(F.col("o_orderstatus") == "O", price > 100000, F.when(price < 200000, True)).alias("target"))


@query("owned_twice", "SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def owned_twice(t):
    return gates.owned_twice(t.lineitem, "l_partkey", "l_returnflag").withColumn("owners", F.array_join("owners", ","))


PINNED = ["click", "view", "error", "never"]


@query("pinned_members", "WITH p(event_type) AS (VALUES ('click'), ('view'), ('error'), ('never')), e AS (SELECT DISTINCT event_type FROM events) SELECT event_type, 'missing' AS fault FROM p WHERE event_type NOT IN (SELECT event_type FROM e) UNION ALL SELECT event_type, 'unknown' FROM e WHERE event_type NOT IN (SELECT event_type FROM p)")
def pinned_members(t):
    return gates.unlike_pinned(t.events, t.values([(x,) for x in PINNED], "event_type string"), "event_type")


@query("held_out_names", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS names, count(*) AS listed FROM part WHERE p_size > 25 GROUP BY 1")
def held_out_names(t):
    """Derived lists: distinct names in order, and how many were listed."""
    names_of = F.array_join(F.array_sort(F.collect_set("p_type")), "|")
    return t.part.where("p_size > 25").groupBy("p_brand").agg(names_of.alias("names"), F.count(F.lit(1)).alias("listed"))


@query("rare_exceptions", "SELECT c_mktsegment, c_nationkey, count(*) AS accepted, count(*) < 50 AND c_nationkey IN (1, 2, 3) AND bool_and(c_acctbal > -990) AS applies FROM customer GROUP BY c_mktsegment, c_nationkey")
def rare_exceptions(t):
    """The lower floor applies to listed names below the usual floor, all of whose rows were accepted."""
    counts = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("accepted"), F.bool_and(F.col("c_acctbal") > -990).alias("whole"))
    return counts.select("c_mktsegment", "c_nationkey", "accepted", ((F.col("accepted") < 50) & F.col("c_nationkey").isin(1, 2, 3) & F.col("whole")).alias("applies"))


@query(
    "decision_journal",
    f"""WITH {DECIDED} SELECT vec_id, CASE WHEN candidates THEN 'candidates' ELSE 'rejected' END AS kind, CASE WHEN candidates THEN first END AS name, round(best, 6) AS score FROM d""",
)
def decision_journal(t):
    """A decision as a row of the journal."""
    best = F.array_max(arrays.softmax(logits()))
    d = arrays.decide(logits(), CLASSES, {"c1": "g1", "c2": "g1"}, GATE)
    rows = t.embeddings.select("vec_id", d.alias("d"), best.alias("best"))
    return rows.select("vec_id", F.col("d.status").alias("kind"), F.when(F.col("d.status") == "candidates", F.get("d.top3", 0)).alias("name"), F.round("best", 6).alias("score"))


@query(
    "tagged_union",
    """WITH j AS (SELECT vec_id, embedding[1:4] AS e FROM embeddings), c AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS i, e FROM j), v AS (SELECT vec_id, 'n' || i AS id, round(CAST(e[i + 1] AS DOUBLE), 4) AS score FROM c WHERE i <> 2 AND NOT (i = 1 AND vec_id % 3 = 0))
    SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'species' WHEN 1 THEN 'rejected' ELSE 'unknown' END AS kind, string_agg(id, ',' ORDER BY score DESC, id) AS ids FROM v GROUP BY ALL""",
)
def tagged_union(t):
    """Lenient parse of a tagged union: bad elements are dropped, an unknown kind gets the default."""
    value = lambda i: F.format_string("%.4f", F.element_at("embedding", i + 1).cast("double"))
    item = lambda i, name, score: F.concat(F.lit('{"id":"'), name, F.lit('","score":'), score, F.lit("}"))
    parts = [item(0, F.lit("n0"), value(0)), item(1, F.when(F.col("vec_id") % 3 == 0, "").otherwise("n1"), value(1)), item(2, F.lit("n2"), F.lit("null")), item(3, F.lit("n3"), value(3))]
    kind = F.when(F.col("vec_id") % 4 == 0, "species").when(F.col("vec_id") % 4 == 1, "rejected").otherwise("other")
    json = F.concat(F.lit('{"kind":"'), kind, F.lit('","candidates":['), F.concat_ws(",", *parts), F.lit("]}"))
    parsed = t.embeddings.select("vec_id", F.from_json(json, "kind string, candidates array<struct<id:string,score:double>>", {"mode": "PERMISSIVE"}).alias("p"))
    out = parsed.select("vec_id", importing.tagged(F.col("p"), ["species", "rejected", "unknown"]).alias("u"))
    return out.select("vec_id", "u.kind", F.array_join(F.transform("u.candidates", lambda c: c["id"]), ",").alias("ids"))


@query(
    "image_resize",
    """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) * 100.0 + 100.0 FOR x IN embedding] AS p FROM embeddings),
    s AS (SELECT vec_id, [(p[16 * (i // 4) + 2 * (i % 4) + 1] + p[16 * (i // 4) + 2 * (i % 4) + 2] + p[16 * (i // 4) + 2 * (i % 4) + 9] + p[16 * (i // 4) + 2 * (i % 4) + 10]) / 4 FOR i IN range(16)] AS q FROM e)
    SELECT vec_id, round(list_sum(q), 4) AS total, round(list_sum([least(255.0, greatest(0.0, floor(v + 0.5))) / 127.5 - 1.0 FOR v IN q]), 4) AS ranged FROM s""",
)
def image_resize(t):
    """Images of 8 x 8 averaged to 4 x 4, and their bytes in a model's range."""
    grey = F.transform("embedding", lambda x: x.cast("double") * 100.0 + 100.0)
    small = images.resized(t.embeddings.select("vec_id", grey.alias("pixels")), "vec_id", "pixels", 8, 8, (4, 4))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 4)
    return small.select(F.col("row").alias("vec_id"), total(F.col("pixels")).alias("total"), total(images.model_range(F.col("pixels"))).alias("ranged"))
