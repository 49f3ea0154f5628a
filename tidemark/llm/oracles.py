"""DuckDB SQL for the text queries that SQL can express."""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.d
"""

#: All pairs that share a shingle, and everything reachable over links.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM d UNION SELECT r.node, d.b FROM r JOIN d ON r.other = d.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m.other, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT node, min(other) AS other FROM r GROUP BY 1) m ON m.node = s.doc_id
"""

#: The same for five-word shingles and a similarity of 0.85.
NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM d UNION SELECT r.node, d.b FROM r JOIN d ON r.other = d.a),
c AS (SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m.other, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT node, min(other) AS other FROM r GROUP BY 1) m ON m.node = s.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c
"""

#: Checksums bit by bit from their polynomial, pairs of near words from patterns, and paths of forms.
SPELLING = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], list_transform(range(8), lambda j: CAST(0 AS BIGINT))), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM o, t),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h) GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
k AS (SELECT DISTINCT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS star, left(word, i - 1) || substr(word, i + 1) AS gone FROM i),
p AS (SELECT x.word, x.n, y.word AS other, y.n AS m FROM k x JOIN k y ON x.star = y.star AND x.word <> y.word UNION SELECT k.word, k.n, w.word, w.n FROM k JOIN w ON k.gone = w.word UNION SELECT w.word, w.n, k.word, k.n FROM k JOIN w ON k.gone = w.word),
b AS (SELECT word, any_value(n) AS n, count(*) AS n_near, (list(struct_pack(m := -m, other := other) ORDER BY -m, encode(other)))[1] AS top FROM p GROUP BY 1),
f AS (SELECT word, n_near, CASE WHEN -top.m >= 5 * n THEN top.other END AS form, CASE WHEN -top.m >= 5 * n THEN -top.m END AS form_n FROM b),
g AS (SELECT word, word AS root, 0 AS step FROM w UNION ALL SELECT g.word, f.form, g.step + 1 FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(root, step) AS root FROM g GROUP BY 1)
SELECT w.word, f.form, l.root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM w JOIN l USING (word) LEFT JOIN f USING (word)
"""

#: Every window that starts at a shared shingle (or is the document's last), compared exactly.
LEAKS = r"""
WITH i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT item_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS g FROM i WHERE len(w) >= 5),
gs AS (SELECT item_id, n, unnest(g) AS h, unnest(range(0, len(g))) AS o FROM g),
t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, len(w) AS size, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS s FROM t WHERE len(w) >= 5),
x AS (SELECT doc_id, size, unnest(s) AS h, unnest(range(0, len(s))) AS p FROM s),
c AS (SELECT DISTINCT x.doc_id, gs.item_id, gs.n, greatest(0, least(p, size - gs.n)) AS start FROM x JOIN gs ON x.h = gs.h),
v AS (SELECT c.doc_id, c.item_id, c.start, s.s[c.start + 1:c.start + c.n - 4] AS a, g.g AS b FROM c JOIN s USING (doc_id) JOIN g USING (item_id)),
k AS (SELECT doc_id, item_id, start, len(a) + len(b) AS both_, list_sum(list_transform(list_distinct(b), lambda y: least(len(list_filter(a, lambda z: z = y)), len(list_filter(b, lambda z: z = y))))) AS same FROM v),
m AS (SELECT doc_id, item_id, start, same / (both_ - same) AS similarity FROM k)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start, (-similarity, start)) AS INTEGER) AS start FROM m WHERE similarity >= 0.8 GROUP BY 1, 2
"""
