"""DuckDB SQL of the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

_D = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
# The node types of functions and methods.
_FUNCTIONS = "('function_definition', 'function_declaration', 'function_item', 'method_declaration', 'method_definition')"
_BAGS = f"""
texts AS (SELECT DISTINCT chunk_no, text FROM chunks WHERE chunk_type IN {_FUNCTIONS} AND chunk_no IS NOT NULL AND text IS NOT NULL),
words AS (SELECT chunk_no, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM texts),
bags AS (SELECT chunk_no, w, count(*) AS n FROM words GROUP BY chunk_no, w),
sizes AS (SELECT chunk_no, sum(n) AS size FROM bags GROUP BY chunk_no),
shared AS (SELECT a.chunk_no AS x, b.chunk_no AS y, sum(least(a.n, b.n)) AS n FROM bags a JOIN bags b ON a.w = b.w AND a.chunk_no < b.chunk_no GROUP BY 1, 2),
alike AS (SELECT x, y FROM shared JOIN sizes p ON p.chunk_no = x JOIN sizes q ON q.chunk_no = y WHERE 10 * n >= 7 * greatest(p.size, q.size))"""

SQL = {
    "p3_found": f"""
WITH valid AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM chunk_vectors WHERE vec_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_D}, 12), b.vec_id) AS r FROM valid a JOIN valid b ON a.vec_id <> b.vec_id)
SELECT DISTINCT least(q, n) AS vec_a, greatest(q, n) AS vec_b FROM near WHERE r <= 5""",
    "p5_found": f"WITH {_BAGS} SELECT x AS chunk_a, y AS chunk_b FROM alike",
    "p5_classes": f"""
WITH {_BAGS},
keyed AS (SELECT chunk_no, string_agg(w || ' ' || n, ' ' ORDER BY w) AS k FROM bags GROUP BY chunk_no),
classes AS (SELECT chunk_no, min(chunk_no) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS class_size FROM keyed),
links AS (SELECT DISTINCT p.class_id AS c, q.class_id AS d FROM alike JOIN classes p ON p.chunk_no = x JOIN classes q ON q.chunk_no = y WHERE p.class_id <> q.class_id),
each AS (SELECT c, count(*) AS n FROM (SELECT c, d FROM links UNION SELECT d, c FROM links) GROUP BY c)
SELECT chunk_no, class_id, class_size, coalesce(n, 0) AS like_classes FROM classes LEFT JOIN each ON c = class_id""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
