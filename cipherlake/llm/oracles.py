"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
best AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, b.component_id, w.doc_id = b.component_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN best b ON b.node = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_minhash_near_dedup": OP8}
