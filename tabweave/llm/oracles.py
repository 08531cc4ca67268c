"""SQL for DuckDB that gives the rows of the corpus queries that SQL can express."""

SUFFIX_DEDUP = """
WITH h AS (SELECT doc_id, HEX(ENCODE(COALESCE(text, ''))) AS h FROM documents),
i AS (SELECT doc_id, h, UNNEST(RANGE(0, GREATEST(LENGTH(h) // 2 - 399, 0))) AS p FROM h),
k AS (SELECT doc_id, p, MD5(SUBSTR(h, 2 * p + 1, 800)) AS key FROM i),
f AS (SELECT doc_id, p, COUNT(*) OVER (PARTITION BY key) AS c FROM k),
a AS (SELECT doc_id, p, p - ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY p) AS grp FROM f WHERE c > 1),
r AS (SELECT doc_id, MIN(p) AS lo, MAX(p) + 400 AS hi FROM a GROUP BY doc_id, grp),
o AS (SELECT doc_id, lo, hi, MAX(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
q AS (SELECT doc_id, lo, hi, SUM(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo) AS n FROM o),
s AS (SELECT doc_id, n, MIN(lo) AS lo, MAX(hi) AS hi FROM q GROUP BY doc_id, n),
e AS (SELECT doc_id, lo, hi, COALESCE(LAG(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS start FROM s),
j AS (SELECT e.doc_id, COUNT(*) AS n_spans, SUM(hi - lo) AS n_removed, STRING_AGG(SUBSTR(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (lo - start) AS BIGINT)), '' ORDER BY lo) || SUBSTR(ANY_VALUE(h), CAST(2 * MAX(hi) + 1 AS BIGINT)) AS kept FROM e JOIN h ON h.doc_id = e.doc_id GROUP BY e.doc_id),
b AS (SELECT doc_id, h, UNNEST(RANGE(0, GREATEST(LENGTH(h) // 2 - 159, 0))) AS p FROM h),
t AS (SELECT doc_id, MD5(SUBSTR(h, 2 * p + 1, 320)) AS key FROM b WHERE p = 0 OR SUBSTR(h, 2 * p - 1, 2) = '0A' OR (p >= 2 AND SUBSTR(h, 2 * p - 3, 4) = '2E20')),
x AS (SELECT key FROM t GROUP BY key HAVING COUNT(DISTINCT doc_id) > 1),
y AS (SELECT doc_id, COUNT(*) AS n_shared FROM t JOIN x USING (key) GROUP BY doc_id)
SELECT h.doc_id, CAST(LENGTH(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans, SHA256(UNHEX(COALESCE(kept, h))) AS kept_sha256, COALESCE(n_shared, 0) AS n_shared FROM h LEFT JOIN j ON j.doc_id = h.doc_id LEFT JOIN y ON y.doc_id = h.doc_id
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT doc_id, ws, UNNEST(RANGE(0, GREATEST(LEN(ws) - 19, 0))) AS p FROM w),
k AS (SELECT doc_id, p, MD5(ARRAY_TO_STRING(ws[p + 1 : p + 20], ' ')) AS key FROM i),
f AS (SELECT doc_id, p, ROW_NUMBER() OVER (PARTITION BY key ORDER BY doc_id, p) AS r FROM k),
g AS (SELECT DISTINCT doc_id, p + j AS ix FROM f, RANGE(20) t(j) WHERE r > 1),
u AS (SELECT doc_id, UNNEST(ws) AS word, UNNEST(RANGE(LEN(ws))) AS ix FROM w),
m AS (SELECT u.doc_id, word, u.ix, g.ix IS NOT NULL AS gone FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.ix = u.ix),
s AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, STRING_AGG(word, ' ' ORDER BY ix) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, LEN(ws) AS n_words, COALESCE(n_removed, 0) AS n_removed, SHA256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""

PREFIX_TRIE = r"""
WITH t AS (SELECT conv_id, LIST({'r': COALESCE(role, ''), 't': COALESCE(text, '')} ORDER BY turn NULLS FIRST) AS ts FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, ts, LIST_TRANSFORM(RANGE(0, 8 * LENGTH(CAST(conv_id AS VARCHAR))), lambda k: (ASCII(SUBSTR(CAST(conv_id AS VARCHAR), CAST(k // 8 + 1 AS BIGINT), 1)) >> CAST(k % 8 AS INTEGER)) & 1) AS bits FROM t),
c AS (SELECT conv_id, ts, XOR(LIST_REDUCE(LIST_PREPEND(CAST(4294967295 AS BIGINT), LIST_TRANSFORM(bits, lambda x: CAST(x AS BIGINT))), lambda x, y: CASE WHEN (x & 1) <> y THEN XOR(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END), CAST(4294967295 AS BIGINT)) % 4 AS h FROM b),
m AS (SELECT c.conv_id, CASE WHEN c.conv_id % 20 = 0 THEN c.ts ELSE LIST_CONCAT(COALESCE(f.ts[1:c.h], []), c.ts[c.h + 1:]) END AS ts FROM c LEFT JOIN t AS f ON f.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, ts, UNNEST(RANGE(0, LEN(ts) + 1)) AS d FROM m),
q AS (SELECT conv_id, d, LEN(ts) = d AS is_end, ts[1:d] AS k, CASE WHEN d > 0 THEN ts[1:d - 1] END AS up, CASE WHEN d > 0 THEN LEN(REGEXP_EXTRACT_ALL(ts[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM p),
n AS (SELECT d, k, ANY_VALUE(up) AS up, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, ANY_VALUE(words) AS words, SHA256(COALESCE(STRING_AGG(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM q GROUP BY d, k),
s AS (SELECT d - 1 AS d, up AS k, COUNT(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
w AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN s ON s.d = n.d AND s.k = n.k),
a AS (SELECT k AS low, UNNEST(RANGE(0, d + 1)) AS d, n_convs, words, n_children FROM w),
g AS (SELECT d, low[1:d] AS k, COUNT(*) FILTER (n_children = 0) AS n_leaves, SUM((n_convs - 1) * words) AS saved_tokens FROM a GROUP BY d, low[1:d])
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, g.n_leaves, CAST(g.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN g ON g.d = w.d AND g.k = w.k LEFT JOIN w AS u ON u.d = w.d - 1 AND u.k = w.up
"""
