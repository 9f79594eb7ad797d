"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

OP9 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY bare) AS group_size,
  row_number() OVER w = 1 AS kept,
  sha256(bare) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id)
"""

OP2 = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, sum(source_size) OVER () AS total,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT *, cap < weight * level AS is_full FROM l),
w AS (
  SELECT *, (total - coalesce(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (), 0)) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS water FROM f),
t AS (
  SELECT source, source_size,
    coalesce(least(CAST(cap AS DOUBLE), CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * water END), 0) AS target FROM w),
n AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
j AS (
  SELECT d.*, n.source_size, n.target, n.whole, n.target - CAST(n.whole * n.source_size AS DOUBLE) AS need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN n ON n.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, upto <= need AS extra FROM j),
g AS (SELECT *, need - coalesce(sum(CASE WHEN extra THEN size END) OVER (PARTITION BY source), 0) AS rest FROM e),
h AS (
  SELECT *, NOT extra AND size > 0 AND abs(size - rest) < rest AS able FROM g),
k AS (
  SELECT *, able AND row_number() OVER (PARTITION BY source, able ORDER BY abs(size - rest), o, doc_id) = 1 AS last_one FROM h)
SELECT doc_id, source, size, source_size, target,
  CAST(whole + CASE WHEN (extra AND need > 0) OR last_one THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CAST((whole + CASE WHEN (extra AND need > 0) OR last_one THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS c FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, coalesce(sum(c.c), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (g.n + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.c + 2) // (l.n + 2 * l.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM f)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""

ORACLE: dict[str, str] = {"op2_warc": OP2, "op5_mixing": OP5, "op9_exact_dedup": OP9, "op12_source_divergence": OP12}
