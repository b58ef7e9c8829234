"""SQL of the results that SQL can state, for DuckDB."""

# The unsigned crc32 of a short ASCII text: eight shifts a byte.
_CRC = r"""xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)),
    4294967295::BIGINT), 4294967295::BIGINT)"""

MERKLE_SQL = r"""
WITH RECURSIVE
shown AS (
  SELECT doc_id, source, doc_id::VARCHAR AS k, CRC_OF_K % 2 = 0 AS edited,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS f,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, replace(text, chr(10), '')] AS e FROM documents),
hashed AS (
  SELECT doc_id, source,
    sha256(array_to_string(list_transform(f, lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS leaf,
    CASE WHEN edited THEN sha256(array_to_string(list_transform(e, lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) END AS edit FROM shown),
leaves AS (
  SELECT *, (dense_rank() OVER (ORDER BY source NULLS FIRST))::BIGINT AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, edit NULLS FIRST) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n FROM hashed),
low AS (
  SELECT g, 0 AS lvl, i, n, leaf AS d FROM leaves
  UNION ALL SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, lvl, i // 3, n),
subroots AS (SELECT g, d FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, g - 1 AS i, count(*) OVER () AS n, d FROM subroots
  UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 3, n),
every AS (SELECT g, lvl, i, n, d FROM low UNION ALL SELECT 0, lvl, i, n, d FROM high),
steps AS (
  SELECT g, lvl, i, n,
    coalesce(string_agg(d, '') OVER (PARTITION BY g, lvl, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (PARTITION BY g, lvl, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM every WHERE n > 1),
walk AS (
  SELECT doc_id, leaf, g AS own, i AS own_i, g, 0 AS lvl, i, n, coalesce(edit, leaf) AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, w.own_i,
         CASE WHEN w.n > 1 THEN w.g ELSE 0 END, CASE WHEN w.n > 1 THEN w.lvl + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.i // 3 ELSE w.own - 1 END, CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE t.n END,
         CASE WHEN w.n > 1 THEN sha256(s.l || w.node || s.r) ELSE w.node END, CASE WHEN w.n > 1 THEN w.proof || s.l || s.r ELSE w.proof END
  FROM walk w LEFT JOIN steps s ON s.g = w.g AND s.lvl = w.lvl AND s.i = w.i
  CROSS JOIN (SELECT count(*) AS n FROM subroots) t WHERE w.n > 1 OR w.g > 0)
SELECT w.doc_id, w.leaf, s.d AS subroot, r.d AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.d AS verified
FROM walk w JOIN subroots s ON s.g = w.own CROSS JOIN (SELECT d FROM high WHERE n = 1) r
WHERE w.g = 0 AND w.n = 1
""".replace("CRC_OF_K", _CRC)

TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts,
         conv_id::VARCHAR AS k FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT conv_id, ts, conv_id - conv_id % 20 AS base, CRC_OF_K % 4 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM headed c LEFT JOIN own b ON b.conv_id = c.base),
nodes AS (
  SELECT ts[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN len(ts) = d THEN conv_id END, ',' ORDER BY conv_id), '') AS ends
  FROM rebuilt, unnest(range(0, len(ts) + 1)) u(d) GROUP BY 1, 2),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (
  SELECT a.*, coalesce(k.n, 0) AS n_children, u.conv_id AS parent_conv_id,
         CASE WHEN a.d = 0 THEN 0 ELSE (a.n_convs - 1) * len(regexp_extract_all(a.p[a.d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes a LEFT JOIN kids k ON k.d = a.d AND k.p = a.p LEFT JOIN nodes u ON u.d = a.d - 1 AND u.p = a.p[1:a.d - 1])
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM full_nodes a JOIN full_nodes b ON b.d >= a.d AND b.p[1:a.d] = a.p
GROUP BY a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.ends
""".replace("CRC_OF_K", _CRC)
