"""SQL for the operators that SQL can express."""

from __future__ import annotations

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (
  SELECT doc_id, len(sh) AS n FROM s
), e AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9
  UNION
  SELECT a.doc_id, b.doc_id FROM n a JOIN n b ON a.n = b.n AND a.doc_id <> b.doc_id WHERE a.n = 0
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), cls AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
), counted AS (
  SELECT x, count(*) AS n_links, count(DISTINCT CASE WHEN a.text <> b.text THEN b.text END) AS n_text_links
  FROM links JOIN w a ON a.doc_id = x JOIN w b ON b.doc_id = y GROUP BY x
)
SELECT doc_id, least(doc_id, coalesce(cls.y, doc_id)) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_text_links, 0)::BIGINT AS n_text_links
FROM w LEFT JOIN cls ON cls.x = doc_id LEFT JOIN counted ON counted.x = doc_id
"""

OP5_SQL = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)
), first AS (
  SELECT m, min((doc_id, i)) AS f FROM win GROUP BY m HAVING count(*) > 1
), later AS (
  SELECT doc_id, i FROM win JOIN first USING (m) WHERE (doc_id, i) <> f
), island AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later)
), gone AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 100 AS e FROM island GROUP BY doc_id, k
), per AS (
  SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, h, n_removed, n_spans,
    CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 2),
      lambda j: substr(h, 2 * coalesce(ends[j - 1], 0) + 1, 2 * (coalesce(starts[j], length(h) // 2) - coalesce(ends[j - 1], 0)))), '') END AS rest
  FROM d LEFT JOIN per USING (doc_id)
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

OP9_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, round(sqrt(count(*)) * 1000)::BIGINT AS v FROM documents GROUP BY source
), unit AS (
  SELECT list_reduce(list(v), lambda x, y: gcd(x, y)) AS g FROM sizes
), whole AS (
  SELECT list(v // g ORDER BY source) AS s, list((n + 3) // 4 ORDER BY source) AS b, sum(v // g)::BIGINT AS p, sum(v // g) <= greatest(1000, 2 * count(*)) AS repeats FROM sizes, unit
), plan AS (
  SELECT -1::BIGINT AS t, 0::BIGINT AS i, 0::BIGINT AS k, list_transform(s, lambda x: 0::BIGINT) AS done, s, b, p, repeats,
    list_max(list_transform(range(1, len(s) + 1), lambda j: (b[j] * p + s[j] - 1) // s[j])) AS last FROM whole
  UNION ALL
  SELECT t, i, done[i] AS k, list_transform(range(1, len(s) + 1), lambda j: done[j] + CASE WHEN j = i THEN 1 ELSE 0 END) AS done, s, b, p, repeats, last FROM (
    SELECT t + 1 AS t, done, s, b, p, repeats, last, list_min(list_transform(range(1, len(s) + 1), lambda j:
      CASE WHEN (repeats OR done[j] < b[j]) AND done[j] * p // s[j] <= t + 1 THEN ((done[j] + 1) * p + s[j] - 1) // s[j] * 1000000 + j ELSE 9000000000000000 END)) % 1000000 AS i
    FROM plan WHERE t + 1 < last)
), ranked AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source) AS i,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents
), placed AS (
  SELECT doc_id, source, r, r // 4 AS block, plan.t AS slot FROM ranked JOIN plan ON plan.i = ranked.i AND plan.k = r // 4 AND plan.t >= 0
)
SELECT doc_id, source, block, slot, row_number() OVER (ORDER BY slot, r) - 1 AS position FROM placed
"""
