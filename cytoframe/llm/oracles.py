"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cytoframe.llm.mixing import BLOCKS, SHARD_ROWS

OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0  -- a query whose row repeats answers once
), s AS (
  SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h FROM documents
), k AS (SELECT greatest(0, CAST(ceil(ln(greatest(count(*), 1) / greatest({SHARD_ROWS}.0, floor(sqrt(count(*))))) / ln(16) - 1e-12) AS INTEGER)) AS digits FROM d
), sh AS (SELECT d.*, h[1:digits] AS shard FROM d, k
), p AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM sh GROUP BY ALL
), s0 AS (
  SELECT source, CAST(sum(shard_size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM p GROUP BY 1
), s1 AS (SELECT *, (place - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS all_size FROM s0
), s2 AS (
  -- the water level: least over the sources of what is left by those capped before it, a weight
  SELECT a.*, (SELECT min(CASE WHEN f.free > 0 THEN (f.all_size - f.spent) / CAST(f.free AS DOUBLE) END) FROM (
      SELECT c.all_size, coalesce((SELECT sum(3 * o.source_size) FROM s1 o WHERE 6 * o.source_size / o.weight < 6 * c.source_size / c.weight), 0) AS spent,
             (SELECT sum(o.weight) FROM s1 o WHERE 6 * o.source_size / o.weight >= 6 * c.source_size / c.weight) AS free FROM s1 c) f
      WHERE f.spent <= f.all_size) AS level FROM s1 a
), s3 AS (SELECT *, 3.0 * source_size < level * weight * (1 - 1e-12) AS capped FROM s2
), s4 AS (
  SELECT *, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST((all_size - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)) * weight AS DOUBLE) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target,
         greatest(1, all_size // {BLOCKS}) AS block FROM s3
), s5 AS (SELECT *, all_size // block AS seats, CAST(count(*) OVER () AS DOUBLE) AS n FROM s4
), q1 AS (
  SELECT place, unnest(range(CAST(greatest(0, floor(target * (seats - n) / all_size) - 1) AS BIGINT), CAST(floor(target * (seats + n) / all_size) + 2 AS BIGINT))) AS j, target, seats,
         CAST(greatest(0, floor(target * (seats - n) / all_size) - 1) AS BIGINT) AS base FROM s5 WHERE target > 0
), q2 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, place, j) AS rn FROM q1
), b1 AS (SELECT sum(base) AS base FROM (SELECT DISTINCT place, base FROM q1)
), w1 AS (SELECT place, any_value(q2.base) + count(*) FILTER (rn <= seats - b1.base) AS source_seats FROM q2, b1 GROUP BY 1
), t AS (
  SELECT p.*, s5.place, s5.source_size, s5.target, s5.block, coalesce(w1.source_seats, 0) AS source_seats, CAST(count(*) OVER (PARTITION BY s5.place) AS DOUBLE) AS n
  FROM p JOIN s5 ON p.source IS NOT DISTINCT FROM s5.source LEFT JOIN w1 ON w1.place = s5.place
), q3 AS (
  SELECT place, shard, shard_size, source_seats, CAST(greatest(0, floor(shard_size * (source_seats - n) / source_size) - 1) AS BIGINT) AS base,
         unnest(range(CAST(greatest(0, floor(shard_size * (source_seats - n) / source_size) - 1) AS BIGINT), CAST(floor(shard_size * (source_seats + n) / source_size) + 2 AS BIGINT))) AS j
  FROM t WHERE shard_size > 0
), q4 AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY CAST(shard_size AS DOUBLE) / (2 * j + 1) DESC, shard, j) AS rn FROM q3
), b2 AS (SELECT place, sum(base) AS base FROM (SELECT DISTINCT place, shard, base FROM q3) GROUP BY 1
), w2 AS (SELECT q4.place, shard, any_value(q4.base) + count(*) FILTER (rn <= source_seats - b2.base) AS quota FROM q4 JOIN b2 USING (place) GROUP BY ALL
), z AS (
  SELECT t.*, least(coalesce(quota, 0) * block, 3 * shard_size) AS want FROM t LEFT JOIN w2 ON w2.place = t.place AND w2.shard = t.shard
), o AS (
  SELECT sh.*, z.source_size, z.target, z.want, z.shard_size, sum(size) OVER (PARTITION BY z.place, z.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sh JOIN z ON sh.source IS NOT DISTINCT FROM z.source AND sh.shard = z.shard
)
SELECT doc_id, size, source_size, target, source,
       CAST(CASE WHEN shard_size = 0 THEN 0 ELSE size * (want // shard_size) + greatest(0, least(upto, want % shard_size) - (upto - size)) END AS BIGINT) AS taken
FROM o
"""
