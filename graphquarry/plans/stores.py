"""More registered queries: names resolved by vectors, guards, registry scans, payloads, previews and prototype ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards
from ..operators import graph, registry, retrieval
from .registry import ENDS, RANKED_SQL, RESOLVE_KEY_SQL, nth, query, ranked, table

# ---- graph -----------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
w AS (SELECT a.n, list({'s': round(list_cosine_similarity(a.e, b.e), 6), 'i': -b.n}) AS near FROM v a JOIN v b ON b.n < a.n AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.3 GROUP BY a.n),
g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS heads, 0::BIGINT AS head UNION ALL
SELECT n, CASE WHEN best IS NULL THEN list_append(heads, n) ELSE heads END, coalesce(-best.i, n) FROM (SELECT v.n, g.heads, list_max(list_filter(coalesce(w.near, []), lambda p: list_contains(g.heads, -p.i))) AS best FROM g JOIN v ON v.n = g.n + 1 LEFT JOIN w ON w.n = v.n))
SELECT 'v' || a.vec_id AS name, a.vec_id AS pos, 'v' || b.vec_id AS canonical FROM g JOIN v a ON a.n = g.n JOIN v b ON b.n = g.head""")
def similar_names(spark, sf_dir):
    """Each vector is a name's. They are independent, so 0.85 would link none; 0.3 links about one pair in 125."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.col("embedding").alias("vector"))
    return graph.resolve_similar(rows, 0.3)


#: Names of which two in a row share a key, and endings that are a name alone; the likeness of first names decides the rest.
RESOLVED_SQL = f"""WITH RECURSIVE m AS (SELECT vec_id AS pos, CASE WHEN vec_id % 50 = 7 THEN {list(ENDS)}[vec_id % {len(ENDS)} + 1] ELSE 'Firm ' || (vec_id // 2) || {list(ENDS)}[vec_id % {len(ENDS)} + 1] END AS name, embedding::DOUBLE[] AS e FROM embeddings),
y AS (SELECT *, {RESOLVE_KEY_SQL} AS key FROM m),
k AS (SELECT key, min(pos) AS pos, arg_min(name, pos) AS name, arg_min(e, pos) AS e, row_number() OVER (ORDER BY min(pos)) AS n FROM y WHERE key <> '' GROUP BY key),
w AS (SELECT a.n, list({{'s': round(list_cosine_similarity(a.e, b.e), 6), 'i': -b.n}}) AS near FROM k a JOIN k b ON b.n < a.n AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.3 GROUP BY a.n),
g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS heads, 0::BIGINT AS head UNION ALL
SELECT n, CASE WHEN best IS NULL THEN list_append(heads, n) ELSE heads END, coalesce(-best.i, n) FROM (SELECT k.n, g.heads, list_max(list_filter(coalesce(w.near, []), lambda p: list_contains(g.heads, -p.i))) AS best FROM g JOIN k ON k.n = g.n + 1 LEFT JOIN w ON w.n = k.n)),
r AS (SELECT y.name, y.pos, coalesce(h.name, y.name) AS canonical, coalesce(h.name <> y.name, false) AS merged FROM y LEFT JOIN k ON k.key = y.key LEFT JOIN g ON g.n = k.n LEFT JOIN k h ON h.n = g.head)"""


def resolved(spark, sf_dir):
    v, key = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    name = F.when(key % 50 == 7, nth(ENDS, key)).otherwise(F.concat(F.lit("Firm "), F.expr("vec_id div 2"), nth(ENDS, key)))
    return graph.resolve_entities(v.select(name.alias("name"), key.alias("pos"), F.col("embedding").alias("vector")), 0.3)


@query(f"{RESOLVED_SQL} SELECT * FROM r")
def resolved_entities(spark, sf_dir):
    """Names by their key and by the likeness of their vectors, in one order of arrival."""
    return resolved(spark, sf_dir)


@query(f"{RESOLVED_SQL} SELECT count(*) FILTER (merged) AS merged_pairs, count(DISTINCT canonical) AS names FROM r")
def resolution_counts(spark, sf_dir):
    return graph.merged_pairs(resolved(spark, sf_dir))


# ---- guards ----------------------------------------------------------------------------------------------------------

#: Statements that stand around a name, one after the other.
STATEMENTS = ("MATCH (n {name: '%'}) RETURN n;;", " optional  match (n) where n.name = '%' return n ", "MATCH (n) SET n.x = '%' RETURN n", "MATCH (n) RETURN '%'; MATCH (m) RETURN m", "EXPLAIN MATCH (n {name: '%'}) RETURN n", "RETURN 'delete %'", "", "load  csv from '%' as r return r", "WITH '%' AS created RETURN created")
SHOWN_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in STATEMENTS) + "]"


@query(f"""WITH x AS (SELECT s_suppkey, trim(replace({SHOWN_SQL}[s_suppkey % {len(STATEMENTS)} + 1], '%', s_name)) AS q FROM supplier),
s AS (SELECT *, CASE WHEN q = '' OR contains(rtrim(q, ';'), ';') THEN 'not_single' WHEN regexp_matches(q, '\\b({"|".join(guards.WRITING)})\\b', 'i') THEN 'writes' WHEN NOT regexp_matches(q, '^({"|".join(guards.READING)})\\b', 'i') THEN 'not_a_query' ELSE 'accepted' END AS state FROM x)
SELECT s_suppkey, state, CASE WHEN state = 'accepted' THEN trim(rtrim(q, ';')) END AS statement FROM s""")
def read_only_statements(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.replace(F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("s_suppkey") % len(STATEMENTS) + 1).cast("int")), F.lit("%"), F.col("s_name"))
    return s.select("s_suppkey", guards.read_only_state(text).alias("state"), guards.read_only_text(text).alias("statement"))


# ---- registry --------------------------------------------------------------------------------------------------------


def held(spark, sf_dir):
    """Documents stand for registered files."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("original_name"), F.sha2("text", 256).alias("sha"), (F.col("doc_id") * 37 % 101).alias("created_at"))


@query("SELECT doc_id AS file_id, source AS original_name, sha256(text) AS sha, doc_id * 37 % 101 AS created_at FROM documents ORDER BY created_at DESC, file_id")
def registry_newest(spark, sf_dir):
    return registry.newest_first(held(spark, sf_dir))


@query("SELECT doc_id AS file_id, source AS original_name, sha256(text) AS sha, doc_id * 37 % 101 AS created_at FROM documents WHERE sha256(text) = (SELECT sha256(arg_min(text, doc_id)) FROM documents)")
def registry_by_hash(spark, sf_dir):
    """The files with the content of the first document."""
    rows = held(spark, sf_dir)
    return registry.find(rows, sha=rows.agg(F.min_by("sha", "file_id")).first()[0])


@query("SELECT doc_id AS file_id, source AS original_name, sha256(text) AS sha, doc_id * 37 % 101 AS created_at FROM documents WHERE doc_id % 3 <> 0")
def registry_delete(spark, sf_dir):
    rows = held(spark, sf_dir)
    return registry.remove(rows, rows.where("file_id % 3 = 0").unionByName(rows.where("file_id % 6 = 0")))


@query("""WITH x AS (SELECT 'up/f' || doc_id || ['.txt', '.MD', '.exe', '', '.csv'][doc_id % 5 + 1] AS path, coalesce(text, '') AS t, ['.txt', '.md', NULL, NULL, '.csv'][doc_id % 5 + 1] AS suffix FROM documents),
s AS (SELECT *, CASE WHEN suffix IS NULL THEN 'unsupported' WHEN octet_length(encode(t)) > 2000 THEN 'too_large' ELSE 'accepted' END AS outcome FROM x)
SELECT path, substr(path, 4) AS original_name, CASE WHEN outcome = 'accepted' THEN 32 + length(suffix) END::INT AS stored_length, CASE WHEN outcome = 'accepted' THEN sha256(t) END AS sha256, octet_length(encode(t)) AS size, outcome FROM s""")
def uploads(spark, sf_dir):
    """Documents stand for uploaded files, of which those over 2000 bytes are refused, as the feature states."""
    ends = F.element_at(F.array(*map(F.lit, (".txt", ".MD", ".exe", "", ".csv"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("up/f"), F.col("doc_id"), ends).alias("path"), F.col("text").cast("binary").alias("content"))
    return registry.take_uploads(files, 2000).select("path", "original_name", F.char_length("stored_name").alias("stored_length"), "sha256", "size", "outcome")


@query("""SELECT s_nationkey AS source, s_suppkey AS chunk_id, s_name AS content FROM supplier WHERE s_nationkey % 4 <> 0 AND s_nationkey % 3 <> 1 AND s_nationkey < 23""")
def snapshot_commit(spark, sf_dir):
    """Nations stand for files: some are rejected, some unreviewed, and some stores fail."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 23")
    key = F.col("n_nationkey")
    ingests = nation.select(key.alias("path"), F.when(key % 3 == 0, F.lit(None)).otherwise(key % 3 != 1).alias("approved"), F.lit(True).alias("vectors_stored"), (key % 4 != 0).alias("graph_stored"))
    return registry.committed(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("chunk_id"), F.col("s_name").alias("content")), ingests)


# ---- retrieval -------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id || '#chunk-0' AS chunk_id, doc_id, 'text' AS doc_type, 0 AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source, '' AS heading_path, CASE WHEN doc_id % 2 = 0 THEN true ELSE false END AS is_table, false AS is_image, 0 AS page FROM documents""")
def chunk_payloads(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id"), F.lit("#chunk-0")).alias("chunk_id"), "doc_id", F.lit("text").alias("doc_type"), F.lit(0).alias("chunk_index"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 2 == 0, True).alias("is_table"), "text")
    return retrieval.payloads(rows)


@query("""WITH x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(text, '') AS t FROM conversations)
SELECT conv_id AS query_id, string_agg('[' || n || '] ' || substr(t, 1, 200), chr(10) || chr(10) ORDER BY n) AS preview, string_agg(substr(t, 1, 120), chr(10) ORDER BY n) AS short FROM x WHERE n <= 5 GROUP BY conv_id""")
def prompt_previews(spark, sf_dir):
    """Turns stand for contexts; five of them, cut, as the feature states."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("content"))
    return retrieval.previews(rows).join(retrieval.previews(rows, 120, numbered=False).withColumnRenamed("preview", "short"), "query_id")


WEIGHTED_SQL = f"""WITH {RANKED_SQL}, l AS (SELECT query_id, 'vector' AS kind, rank AS pos, vec_id, score FROM r WHERE rank <= 5 UNION ALL SELECT query_id, 'graph', rank, vec_id, 0.3::DOUBLE * 1.2::DOUBLE FROM r WHERE rank BETWEEN 3 AND 10),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind DESC, pos) AS rank FROM l)"""


def prototype_lists(spark, sf_dir):
    near = ranked(spark, sf_dir, 10).withColumnRenamed("rank", "pos")
    graph_list = near.where("pos >= 3").withColumn("score", F.lit(0.3)).withColumn("kind", F.lit("graph"))
    return retrieval.weighted_lists(near.where("pos <= 5").withColumn("kind", F.lit("vector")).unionByName(graph_list))


@query(f"{WEIGHTED_SQL} SELECT query_id, kind, pos, vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 8")
def prototype_rerank(spark, sf_dir):
    """The third to tenth nearest stand for what a graph gives, with one score."""
    return prototype_lists(spark, sf_dir).select("query_id", "kind", "pos", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"{WEIGHTED_SQL} SELECT query_id, round(avg(score), 6) AS free, round(least(avg(score), 1.0), 6) AS confidence FROM t WHERE rank <= 8 GROUP BY query_id")
def prototype_confidence(spark, sf_dir):
    rows = prototype_lists(spark, sf_dir)
    return retrieval.mean_confidence(rows).join(retrieval.mean_confidence(rows, clamped=False).withColumnRenamed("confidence", "free"), "query_id")


@query(f"""WITH {RANKED_SQL}, h AS (SELECT query_id, count(*) AS n, string_agg(vec_id, ',' ORDER BY rank) AS ids, round(avg(greatest(0.0, least(score, 1.0))) FILTER (rank <= 3), 4) AS s FROM r WHERE rank <= 8 AND query_id % 40 = 0 GROUP BY query_id)
SELECT vec_id AS query_id, coalesce(n, 0)::INT AS n_contexts, coalesce(ids, '') AS ids, 'answer from ' || coalesce(n, 0) AS answer, coalesce(s, 0.0)::DOUBLE AS confidence FROM embeddings LEFT JOIN h ON h.query_id = vec_id WHERE vec_id % 20 = 0""")
def qa_results(spark, sf_dir):
    """Every other question finds nothing."""
    found = ranked(spark, sf_dir, 8).where("query_id % 40 = 0")
    questions = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    out = retrieval.results(questions, found, F.concat(F.lit("answer from "), F.size("contexts")))
    return out.select("query_id", F.size("contexts").alias("n_contexts"), F.array_join(F.transform("contexts", lambda c: c["vec_id"].cast("string")), ",").alias("ids"), "answer", "confidence")
