"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(c.low, s.doc_id)) AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id
"""

OP4 = rf"""
WITH b AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, {_LOW} AS low FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY 1),
x AS (SELECT doc_id, source, t, unnest(string_split(low, chr(10))) AS line FROM b),
y AS (SELECT doc_id, source, t, array_to_string(regexp_extract_all(line, {_WORDS}), ' ') AS line, len(regexp_extract_all(line, {_WORDS})) AS words FROM x),
h AS (SELECT source, count(DISTINCT t) AS docs FROM b GROUP BY 1),
f AS (SELECT y.source, line FROM y JOIN h ON h.source IS NOT DISTINCT FROM y.source WHERE line <> '' GROUP BY y.source, line, docs HAVING count(DISTINCT t) > 20 AND 100 * count(DISTINCT t) > 10 * docs),
lost AS (SELECT doc_id, sum(words) AS n FROM y JOIN f ON f.source IS NOT DISTINCT FROM y.source AND f.line = y.line GROUP BY 1),
q AS (SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len([z FOR z IN string_split(t, chr(10)) IF regexp_matches(z, '[^\x20\x09-\x0D]')]) - len(list_distinct([z FOR z IN string_split(t, chr(10)) IF regexp_matches(z, '[^\x20\x09-\x0D]')])) AS BIGINT) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
      FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost < 50 * n_words AS kept FROM q
"""

_NAMES = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_NAMES}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({_LOW}, {_NAMES}) AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, item_id, i, dw.size FROM dw JOIN bw ON bw.g = dw.g AND bw.size = dw.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS n, count(*) AS v, sum(total) AS all_n FROM x GROUP BY 1, 2),
p AS (SELECT x.lang, x.source, x.term, x.n, CAST(1 + (1000000000 * CAST(x.n + 2 AS HUGEINT)) // (s.n + 2 * s.v) AS BIGINT) AS p,
      CAST(1 + (1000000000 * CAST(x.total + 2 AS HUGEINT)) // (s.all_n + 2 * s.v) AS BIGINT) AS q FROM x JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

OP12 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS r FROM b GROUP BY 1, 2),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
m AS (SELECT doc_id, w, CAST(100 - 25 + (25 * len(w) * s.n) // s.l AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
t AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(w) AS term FROM m) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
o AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) GROUP BY 1, 2),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM o WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


def op9(rules: list[tuple[str, str, str]]) -> str:
    """SQL of the URL verdicts under ``rules``: verdict, host and path of each."""
    return """
WITH rules(says, rhost, rpath) AS (VALUES {values}),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
),
own AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
fit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, says,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS n
  FROM own JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT o.page_id, o.host, o.path, f.rule, coalesce(f.says, 'allow') AS verdict
FROM own o LEFT JOIN fit f ON f.n = 1 AND f.page_id = o.page_id AND f.host = o.host AND f.path = o.path
""".format(values=", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules))
