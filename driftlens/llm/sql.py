"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ARCHIVES = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', CAST(1 + (
      ((16 * (instr('0123456789abcdef', substr(hex, CAST(i * 5 // 4 AS INTEGER) + 1, 1)) - 1)
        + (instr('0123456789abcdef', substr(hex || '0', CAST(i * 5 // 4 AS INTEGER) + 2, 1)) - 1))
        // CAST(power(2, 3 - (i * 5) % 4) AS INTEGER)) % 32) AS INTEGER), 1)), '') AS payload_digest
  FROM p
), f AS (SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM d GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN n > 1 AND d.page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND d.page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, 3 * source_size / weight AS ratio FROM s
), l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM r WINDOW w AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
    least(cap, weight * (SELECT level FROM l x WHERE x.level <= x.ratio ORDER BY x.ratio, x.level LIMIT 1)) AS target,
    CAST(('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, ((d.doc_id % 1024) + 1024) % 1024 NULLS LAST, d.doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(n * e + u) - floor((n - 1) * e + u)) * size AS BIGINT) AS taken FROM k
"""

NEARDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, coalesce((SELECT n FROM n WHERE n.doc_id = r.a), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM r GROUP BY a
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS z FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.z * y.z) >= 0.95
),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)
"""

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

ORACLE_SQL = {"op7_vectors": VECTORS, "op1_neardup": NEARDUP, "op5_archives": ARCHIVES, "op8_mixing": MIXING, "op13_exact": EXACT}
