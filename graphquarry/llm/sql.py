"""DuckDB SQL for the queries that SQL can express."""

#: The alphabet of base32, a fixed value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP1 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{BASE32}',
    (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(len(ws) - least(len(ws), 10) + 1), lambda i: array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' '))) AS win FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM w),
x AS (SELECT doc_id, n, unnest(list_transform(range(len(ws) - n + 1), lambda i: {{'i': i, 'win': array_to_string(ws[i + 1 : i + n], ' ')}}), recursive := true) FROM d, sizes WHERE len(ws) >= n),
h AS (SELECT DISTINCT x.doc_id, x.i, x.n, w.item_id FROM x JOIN w ON x.win = w.win AND x.n = w.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP9 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(list_transform(range(len(ws) - 34), lambda i: {'i': i, 'h': md5(array_to_string(ws[i + 1 : i + 35], ' '))}), recursive := true) FROM d WHERE len(ws) >= 35),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM x JOIN r USING (h)),
l AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(len(ws)), lambda i: NOT list_contains(ps, i)), lambda i: ws[i + 1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[i + 1 : i + 4], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
  AND a.n * 100 >= 85 * b.n AND b.n * 100 >= 85 * a.n GROUP BY ALL),
e AS (SELECT x, y FROM o WHERE 100 * shared >= 85 * (total - shared)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.doc_id AND r.c < b.y)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(min(c), s.doc_id) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(sh)"""

SPACED = "[^\\x20\\x09-\\x0D]+"

OP11 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
f AS (SELECT doc_id, part, x, min(doc_id) OVER (PARTITION BY x) AS least, regexp_extract_all(x, '{SPACED}') AS ws FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {{
    'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * len(x),
    'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(doc_id > least, false) }} AS bad FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, bad, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
o AS (SELECT a.z || b.z || c.z || d.z || e.z AS filter_order FROM s a, s b, s c, s d, s e
  WHERE a.z <> b.z AND c.z NOT IN (a.z, b.z) AND d.z NOT IN (a.z, b.z, c.z) AND e.z NOT IN (a.z, b.z, c.z, d.z)),
k AS (SELECT filter_order, step, substr(filter_order, step, 1) AS z, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT part, filter_order, step, z, n, good, toxic, bad[z] AS fails, len(list_filter(before, lambda b: b <> '' AND bad[b])) > 0 AS gone,
  len(list_filter(map_values(bad), lambda b: b)) = 1 AS once FROM c, k),
g AS (SELECT part, filter_order, step, z,
  coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND once), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, z))::BIGINT AS shapley FROM g"""

OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, x, len(x) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || x[1:a] || '<S>' || x[b + 1:] || '<M>' || x[a + 1:b]
    ELSE '<S>' || x[b + 1:] || '<P>' || x[1:a] || '<M>' || x[a + 1:b] END) AS output_sha256, sha256(x) AS restored_sha256 FROM c"""

ORACLES = {"op1_warc_index": OP1, "op5_decontamination": OP5, "op9_substring_dedup": OP9, "op10_ngram_jaccard": OP10, "op11_filter_audit": OP11, "op12_exact_topk": OP12, "op13_fill_in_middle": OP13}
