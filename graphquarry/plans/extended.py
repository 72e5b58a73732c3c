"""More registered queries: hybrid retrieval, graph rows, extraction, change handlers, reports and file ingest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extraction, graph, incremental, reports, retrieval
from ..sources import office
from .registry import MENTIONS_SQL, RANKED_SQL, graph_tables, query, ranked, shared_folder, table

# ---- hybrid retrieval ------------------------------------------------------------------------------------------------


#: Nearest vectors of each query and of its label's first vector (score first, then that list's order), and five rows of the label.
FUSED_LISTS_SQL = f"""{RANKED_SQL}, lab AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0), least AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings QUALIFY pos <= 5),
v AS (SELECT query_id, 1 AS list_id, rank AS pos, vec_id, score, 'vector' AS kind FROM r WHERE rank <= 5),
g AS (SELECT query_id, 2 AS list_id, pos, vec_id, 2.0::DOUBLE AS score, 'graph' AS kind FROM lab JOIN least USING (label)),
l AS (SELECT * FROM v UNION ALL SELECT * FROM g),
f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + pos)) AS raw, min(list_id * 1000 + pos) AS first, arg_min(score, list_id * 1000 + pos) AS original_score, CASE WHEN count(DISTINCT kind) > 1 THEN 'hybrid' ELSE min(kind) END AS retrieval_type, coalesce(list('s' || list_id || '|' || vec_id || '|0' ORDER BY list_id, pos), []) AS citations FROM l GROUP BY ALL),
n AS (SELECT query_id, count(DISTINCT list_id) AS n FROM l GROUP BY query_id),
x AS (SELECT *, round(least(1.0, raw / (n / 61.0::DOUBLE)), 6) AS score FROM f JOIN n USING (query_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM x)"""


def two_lists(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    own = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    row = lambda df, n, kind: df.select("query_id", F.lit(n).alias("list_id"), "pos", F.col("vec_id").cast("string").alias("chunk_id"), F.lit("").alias("content"), F.lit(f"s{n}").alias("source"), "score", F.lit(kind).alias("retrieval_type"), F.lit(0).alias("page"), F.lit("").alias("heading_path"))
    near = row(ranked(spark, sf_dir, 5).withColumnRenamed("rank", "pos"), 1, "vector")
    least = v.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("pos <= 5").select("label", "pos", "vec_id")
    return near, row(own.join(least, "label").withColumn("score", F.lit(2.0)), 2, "graph")


@query(f"WITH {FUSED_LISTS_SQL} SELECT query_id, rank, 'chunk:' || vec_id AS key, score, original_score, retrieval_type, citations FROM t WHERE rank <= 8")
def hybrid_fusion(spark, sf_dir):
    """Each query's five nearest vectors, fused with five rows of its label; the score first seen stays, though the other is higher."""
    near, linked = two_lists(spark, sf_dir)
    return retrieval.hybrid_fuse(near.unionByName(linked), 8).drop("content", "source").withColumn("citations", retrieval.citation_text(F.col("citations")))


@query(f"WITH {FUSED_LISTS_SQL.replace('2.0::DOUBLE', '1.0::DOUBLE')} SELECT query_id, rank, 'chunk:' || vec_id AS key, score, original_score, retrieval_type, citations FROM t WHERE rank <= 8")
def hybrid_retrieve(spark, sf_dir):
    """Every 20th vector's five nearest, fused with five rows of its label, which stand for what a graph gives: all eight ranks."""
    near, linked = two_lists(spark, sf_dir)
    found = retrieval.hybrid_fuse(near.unionByName(linked.withColumn("score", F.lit(1.0))), 8)
    return found.drop("content", "source").withColumn("citations", retrieval.citation_text(F.col("citations")))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey::VARCHAR AS chunk_id, 'firm ' || s_name || ' of ' || n_name AS content, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
q AS (SELECT n_nationkey::BIGINT AS query_id, 'who is in ' || n_name AS question, (SELECT arg_min('firm ' || s_name || ' of ' || n_name, s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS text FROM nation)
SELECT query_id, 1 AS rank, 'vector' AS retrieval_type, text AS content, 's' || (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = query_id) AS source, 1.0::DOUBLE AS original_score FROM q WHERE text IS NOT NULL""")
def hybrid_questions(spark, sf_dir):
    """Questions through the whole path: rewritten queries embedded and searched among embedded chunks, entities searched in the
    graph, both fused, and reranked by the words that question and content share. Each asks for a chunk by its text, so that
    the first context is known: with it the SQL compares. Without a reranker the nearest chunk is first."""
    from ..functions.embedding import embed, embed_rows
    from ..operators import paths, vector_index
    from .graphs import links

    nation, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    chunks = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("chunk_id"), F.concat(F.lit("firm "), "s_name", F.lit(" of "), "n_name").alias("content"), F.concat(F.lit("s"), "s_suppkey").alias("source"), "s_nationkey", "s_suppkey")
    first = chunks.groupBy("s_nationkey").agg(F.min_by("content", "s_suppkey").alias("text"))
    questions = nation.join(first, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("who is in "), "n_name").alias("question"), F.array("text", F.lit(" ")).alias("queries"), F.array("n_name").alias("entities"))
    index = vector_index.build(embed_rows(chunks, "chunk_id", "content"), key="chunk_id", vector="embedding")
    near = retrieval.vector_contexts(index, chunks, questions, embed)
    linked = paths.graph_contexts(*links(spark, sf_dir), questions)
    found = retrieval.retrieve(questions, near, linked)
    return found.where("rank = 1").select("query_id", "rank", "retrieval_type", "content", "source", F.round("original_score", 6).alias("original_score"))


@query(f"WITH {FUSED_LISTS_SQL} SELECT query_id, rank, 'chunk:' || vec_id AS key, score, original_score, retrieval_type, citations FROM t WHERE rank <= 5")
def typed_fusion(spark, sf_dir):
    """The same contexts as one list, taken apart by their types."""
    near, linked = two_lists(spark, sf_dir)
    mixed = near.withColumn("pos", F.col("pos") * 2).unionByName(linked.withColumn("pos", F.col("pos") * 2 + 1)).drop("list_id")
    return retrieval.by_type_fused(mixed, 5).drop("content", "source").withColumn("citations", retrieval.citation_text(F.col("citations")))


@query(f"""WITH {FUSED_LISTS_SQL}, c AS (SELECT *, rank <= 4 AND (query_id % 60 <> 0 OR count(*) FILTER (rank <= 4 AND vec_id % 2 = 0) OVER (PARTITION BY query_id) = 0) AS judged FROM t),
j AS (SELECT *, CASE WHEN judged THEN round(1 / (1 + exp(-(vec_id % 7 - 3)::DOUBLE)), 6) ELSE score END AS s2 FROM c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY NOT judged, CASE WHEN judged THEN -s2 END, rank) AS rank, 'chunk:' || vec_id AS key, s2 AS score, original_score FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY NOT judged, CASE WHEN judged THEN -s2 END, rank) <= 6""")
def hybrid_rerank(spark, sf_dir):
    """The four first of each query reranked by a score of their id; the reranker fails for every third query, which stays."""
    near, linked = two_lists(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("").alias("question"))
    number = F.substring_index("key", ":", -1).cast("long")
    rerank = lambda rows: rows.withColumn("raw", F.when((F.col("query_id") % 60 != 0) | (number % 2 == 1), (number % 7 - 3).cast("double")))
    return retrieval.reranked(retrieval.hybrid_fuse(near.unionByName(linked)), asked, rerank, 6, 4).select("query_id", "rank", "key", "score", "original_score")


@query("""SELECT doc_id AS index, substr(text, 1, 500) AS content, CASE WHEN doc_id % 3 = 0 THEN 'name-' || doc_id ELSE '/up/f' || doc_id END AS source, round(n_chars / 7000.0::DOUBLE, 4) AS score, lang AS type, source AS chunk_id FROM documents""".replace("AS index", 'AS "index"').replace("source AS chunk_id FROM", "source AS chunk_id, 0 AS page, '' AS heading_path, ['/up/c|' || doc_id || '|0', CASE WHEN doc_id % 3 = 0 THEN 'name-' || doc_id ELSE '/up/f' || doc_id END || '||2'] AS citations FROM"))
def shown_sources(spark, sf_dir):
    """Sources by their registered names, for the files that were taken in."""
    docs = table(spark, sf_dir, "documents")
    held = docs.where("doc_id % 3 <> 1").select(F.concat(F.lit("f"), "doc_id").alias("file_id"), F.concat(F.lit("name-"), "doc_id").alias("original_name"), F.when(F.col("doc_id") % 3 == 0, "success").otherwise("failed").alias("status"))
    rows = docs.select(F.col("doc_id").alias("rank"), F.col("text").alias("content"), F.concat(F.lit("/up/f"), "doc_id").alias("source"), (F.col("n_chars") / F.lit(7000.0)).alias("score"), F.col("lang").alias("retrieval_type"), F.col("source").alias("chunk_id"), F.array(F.struct(F.lit("/up/c").alias("source"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(0).alias("page"), F.lit("").alias("heading_path")), F.struct(F.concat(F.lit("/up/f"), "doc_id").alias("source"), F.lit("").alias("chunk_id"), F.lit(2).alias("page"), F.lit("").alias("heading_path"))).alias("citations"))
    return retrieval.source_payloads(rows, held).withColumn("citations", retrieval.citation_text(F.col("citations")))


@query("SELECT source AS query_id, count(*) FILTER (doc_id % 3 IN (0, 2)) AS vector, count(*) FILTER (doc_id % 3 IN (1, 2)) AS graph FROM documents GROUP BY source")
def evidence_counts(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "vector").when(F.col("doc_id") % 3 == 1, "graph").otherwise("hybrid")
    return retrieval.evidence_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), kind.alias("retrieval_type")))


@query("""SELECT conv_id, turn, CASE WHEN t LIKE '%factoid%' THEN 'factoid' WHEN t LIKE '%analytical%' THEN 'analytical' WHEN t LIKE '%comparative%' THEN 'comparative' WHEN t LIKE '%procedural%' THEN 'procedural' WHEN t LIKE '%exploratory%' THEN 'exploratory' ELSE 'factoid' END AS intent
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) || ['', ' Analytical', ' PROCEDURAL comparative', ' exploratory', ' none'][turn % 5 + 1] AS t0, lower(t0) AS t FROM conversations)""")
def intent_fallback(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("", " Analytical", " PROCEDURAL comparative", " exploratory", " none"))), (F.col("turn") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.intent_of(F.concat(F.coalesce("text", F.lit("")), said)).alias("intent"))


# ---- graph changes and extraction ------------------------------------------------------------------------------------


@query(f"""WITH {MENTIONS_SQL}, x AS (SELECT n_name AS name, n_nationkey FROM nation WHERE n_nationkey < 10)
SELECT coalesce(x.name, e.name) AS name, CASE WHEN x.name IS NULL THEN e.type ELSE 'Held' END AS type, CASE WHEN coalesce(e.description, '') <> '' THEN e.description WHEN x.name IS NOT NULL THEN 'held' ELSE '' END AS description, e.version,
CASE WHEN x.name IS NULL THEN ol.provenance ELSE list_distinct_ordered END AS provenance, CASE WHEN x.name IS NULL THEN [e.name] ELSE ['old', e.name] END AS aliases, CASE WHEN x.name IS NULL THEN 9 ELSE 1 END::BIGINT AS created_at, 9::BIGINT AS updated_at
FROM e JOIN ol USING (name) LEFT JOIN x USING (name) LEFT JOIN (SELECT name, list_concat(['g0'], list_filter(provenance, lambda p: p <> 'g0')) AS list_distinct_ordered FROM ol) d USING (name)""")
def graph_upsert(spark, sf_dir):
    """Nations below 10 are held already, from source g0."""
    held = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_name").alias("name"), F.lit("Held").alias("type"), F.lit("held").alias("description"), F.lit(0).alias("version"), F.array(F.lit("g0")).alias("provenance"), F.array(F.lit("old")).alias("aliases"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    return graph.merge_into_graph(held, graph_tables(spark, sf_dir)[0], F.lit(9).cast("long"))


@query("""WITH m AS (SELECT n_name AS name, list('f' || n_regionkey || '::c' || k ORDER BY k) AS provenance FROM nation, (SELECT unnest(range(3)) AS k) x WHERE k <= n_nationkey % 3 GROUP BY n_name)
SELECT name, list_filter(provenance, lambda p: NOT ends_with(p, '::c0')) AS provenance FROM m WHERE len(list_filter(provenance, lambda p: NOT ends_with(p, '::c0'))) > 0""")
def delete_by_chunks(spark, sf_dir):
    """Provenance of chunk c0 goes, and entities that have no other."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.transform(F.sequence(F.lit(0), F.col("n_nationkey").cast("int") % 3), lambda k: tx.provenance(F.concat(F.lit("f"), F.col("n_regionkey")), F.concat(F.lit("c"), k))).alias("provenance"))
    none = rows.select(F.col("name").alias("head"), F.lit("X").alias("rel_type"), F.col("name").alias("tail"), "provenance").where("false")
    return graph.without_provenance(rows, none, lambda p: (p == "c0") | p.endswith("::c0"))[0]


def replies(spark, sf_dir):
    """A reply for each supplier, some fenced, some broken, with repeated, nameless and half relations."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat_ws(" ", F.lit("N"), F.col("s_nationkey"))
    entity = lambda n, t: F.struct(n.alias("name"), t.alias("type"), F.lit("d").alias("description"))
    relation = lambda a, r, b, c: F.struct(a.alias("head"), r.alias("relation"), b.alias("tail"), c.alias("confidence"))
    entities = F.array(entity(F.col("s_name"), F.lit("Firm")), entity(F.col("s_name"), F.lit("Firm")), entity(F.lit(""), F.lit("X")), entity(name, F.lit("")))
    relations = F.array(relation(F.col("s_name"), F.lit("located in"), name, F.lit(0.9)), relation(F.col("s_name"), F.lit("located in"), name, F.lit(0.1)), relation(F.col("s_name"), F.lit(""), name, F.lit(None).cast("double")), relation(F.col("s_name"), F.lit("x"), F.lit(""), F.lit(1.0)))
    reply = F.to_json(F.struct(entities.alias("entities"), relations.alias("relations")))
    shown = F.when(F.col("s_suppkey") % 5 == 0, F.lit("not json")).when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).otherwise(reply)
    return s.select(F.concat(F.lit("k"), "s_suppkey").alias("chunk_id"), F.col("s_suppkey").cast("long").alias("pos"), shown.alias("reply"))


@query("""SELECT 'k' || s_suppkey AS chunk_id, s_suppkey::BIGINT AS pos, k::INT AS at, CASE k WHEN 0 THEN s_name ELSE 'N ' || s_nationkey END AS name, CASE k WHEN 0 THEN 'Firm' ELSE 'Concept' END AS type, 'd' AS description, 'src' || (s_suppkey % 4) AS source FROM supplier, (SELECT unnest([0, 3]) AS k) x WHERE s_suppkey % 5 <> 0""")
def extracted_entities(spark, sf_dir):
    chunks = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("chunk_id"), F.concat(F.lit("src"), F.col("s_suppkey") % 4).alias("source"))
    return extraction.with_sources(extraction.distinct_in(extraction.entity_rows(replies(spark, sf_dir)), ["name", "type"], ["pos", "at"]), chunks)


@query("""SELECT 'k' || s_suppkey AS chunk_id, s_suppkey::BIGINT AS pos, k::INT AS at, s_name AS head, CASE k WHEN 0 THEN 'located in' ELSE 'related_to' END AS relation, 'N ' || s_nationkey AS tail, CASE k WHEN 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM supplier, (SELECT unnest([0, 2]) AS k) x WHERE s_suppkey % 5 <> 0""")
def extracted_relations(spark, sf_dir):
    return extraction.distinct_in(extraction.relation_rows(replies(spark, sf_dir)), ["head", "relation", "tail"], ["pos", "at"])


@query("""SELECT 'N ' || s_nationkey AS name, 'Concept' AS type, min(s_suppkey)::BIGINT AS pos FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT s_name, 'Firm', min(s_suppkey)::BIGINT FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1""")
def distinct_entities(spark, sf_dir):
    """Distinct over all chunks, the prototypes' rule."""
    return extraction.distinct_in(extraction.entity_rows(replies(spark, sf_dir)), ["name", "type"], ["pos", "at"], by_chunk=False).select("name", "type", "pos")


@query("""WITH k AS (SELECT n_regionkey AS g, min(n_nationkey) AS since, arg_min(n_name, n_nationkey) AS canonical FROM nation GROUP BY 1), n AS (SELECT n_name, n_nationkey, canonical FROM nation JOIN k ON n_regionkey = g)
SELECT CASE WHEN h.n_nationkey <= x.pos THEN h.canonical ELSE h.n_name END AS head, 'near' AS relation, CASE WHEN t.n_nationkey <= x.pos THEN t.canonical ELSE t.n_name END AS tail, x.pos
FROM (SELECT a.n_name AS head, b.n_name AS tail, (a.n_nationkey * 7 % 25)::BIGINT AS pos FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 3) % 25) x JOIN n h ON h.n_name = x.head JOIN n t ON t.n_name = x.tail""")
def rewritten_relations(spark, sf_dir):
    """Nations of a region resolve to its first one, once they have been seen."""
    nation = table(spark, sf_dir, "nation").withColumn("pos", F.col("n_nationkey").cast("long"))
    resolved = graph.resolve_names(nation.select(F.col("n_name").alias("name"), "pos", "n_regionkey"), F.col("n_regionkey"))
    a, b = nation.alias("a"), nation.alias("b")
    pairs = a.join(b, F.col("b.pos") == (F.col("a.pos") + 3) % 25).select(F.col("a.n_name").alias("head"), F.lit("near").alias("relation"), F.col("b.n_name").alias("tail"), (F.col("a.pos") * 7 % 25).alias("pos"))
    return graph.rewritten_relations(pairs, resolved)


# ---- registry and change handlers ------------------------------------------------------------------------------------


@query("""SELECT doc_id AS file_id, sha256(text) AS sha, CASE WHEN s IS NULL THEN 'processing' WHEN s = 1 THEN 'retried' ELSE 'already_exists' END AS outcome FROM documents LEFT JOIN (SELECT sha256(text) AS sha, min(doc_id) % 3 AS s FROM documents WHERE doc_id % 4 = 0 GROUP BY 1) h ON h.sha = sha256(text)""")
def upload_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha"))
    held = rows.where("file_id % 4 = 0").groupBy("sha").agg(F.when(F.min("file_id") % 3 == 1, "failed").otherwise("success").alias("status"))
    return incremental.upload_outcomes(held, rows)


@query("SELECT doc_id AS file_id, source AS original_name, CASE WHEN doc_id % 3 = 0 THEN 'success' ELSE 'processing' END AS status, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 7 ELSE 0 END AS chunks_count, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS updated_at FROM documents")
def registry_update(spark, sf_dir):
    """Every third document succeeds, half of those with a count; a name can't be changed."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("original_name"), F.lit("processing").alias("status"), F.lit(0).alias("chunks_count"), F.lit(1).cast("long").alias("updated_at"))
    changes = held.where("file_id % 3 = 0").select("file_id", F.lit("other").alias("original_name"), F.lit("success").alias("status"), F.when(F.col("file_id") % 2 == 0, 7).alias("chunks_count"))
    return incremental.registry_update(held, changes, F.lit(2).cast("long"))


HANDLED = """d AS (SELECT source AS doc_id, ['created', 'modified', 'deleted'][(length(source) % 3) + 1] AS change_type FROM documents GROUP BY source),
o AS (SELECT source AS doc_id, doc_id AS chunk_id, text AS was FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT source AS doc_id, doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS now FROM documents WHERE doc_id % 11 <> 0)"""


@query(f"""WITH {HANDLED} SELECT * FROM (SELECT doc_id, chunk_id, CASE change_type WHEN 'deleted' THEN CASE WHEN was IS NOT NULL THEN 'remove' END WHEN 'created' THEN CASE WHEN now IS NOT NULL THEN 'store' END
ELSE CASE WHEN now IS NULL THEN 'remove' WHEN was IS NULL THEN 'store' WHEN was = now THEN 'keep' ELSE 'replace' END END AS action FROM (SELECT * FROM o FULL JOIN n USING (doc_id, chunk_id)) x JOIN d USING (doc_id)) WHERE action IS NOT NULL""")
def change_handlers(spark, sf_dir):
    """What each source's last change does to its chunks."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("created", "modified", "deleted"))), (F.char_length("source") % 3 + 1).cast("int"))
    states = docs.select(F.col("source").alias("doc_id"), kind.alias("change_type")).distinct()
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    new = rows.where("chunk_id % 11 <> 0").withColumn("content", F.when(F.col("chunk_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return incremental.document_handlers(states, rows.where("chunk_id % 7 <> 0"), new)


@query("SELECT s_name AS name, s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS version FROM supplier")
def version_counter(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("own"))
    return reports.versions(rows).select(F.col("own").alias("name"), F.col("name").alias("nation"), "version")


# ---- reports ---------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type AS variant, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1), b AS (SELECT p50 AS base FROM e WHERE variant = (SELECT min(event_type) FROM events))
SELECT variant, round(mean, 3) AS mean, round(p50, 3) AS p50, round(p95, 3) AS p95, round((1 - p50 / base) * 100, 2) AS p50_saved FROM e, b""")
def latency_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.col("value").alias("ms"))
    return reports.latency_summary(events, events.agg(F.min("variant")).first()[0])


@query("""WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 3 THEN NULL WHEN s_suppkey % 7 = 1 THEN 2000 WHEN s_suppkey % 7 = 2 THEN -400 WHEN s_suppkey % 7 < 5 THEN 400 ELSE s_suppkey % 7 - 5 END::DOUBLE AS base, s_nationkey + CASE WHEN s_suppkey % 7 = 1 THEN 2000 WHEN s_suppkey % 7 < 5 THEN 400 ELSE 0 END::DOUBLE AS now FROM supplier)
SELECT s_suppkey, CASE WHEN base = 0 THEN 'N/A' WHEN base IS NOT NULL THEN printf('%+.1f%%', (now - base) / base * 100) END AS change FROM x""")
def percent_change(spark, sf_dir):
    """Changes that lie on halves of a tenth too (0.25 % steps exactly, 0.05 % steps nearly), and nulls."""
    k = F.col("s_suppkey") % 7
    base = F.when(F.col("s_suppkey") % 11 == 3, F.lit(None)).when(k == 1, 2000).when(k == 2, -400).when(k < 5, 400).otherwise(k - 5).cast("double")
    now = (F.col("s_nationkey") + F.when(k == 1, 2000).when(k < 5, 400).otherwise(0)).cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", reports.percent_change(now, base).alias("change"))


@query("SELECT source AS variant, round(avg(n_chars % 3), 4) AS rounds FROM documents WHERE doc_id > 2 GROUP BY source")
def average_rounds(spark, sf_dir):
    return reports.average_rounds(table(spark, sf_dir, "documents").select(F.col("source").alias("variant"), F.col("doc_id").alias("pos"), (F.col("n_chars") % 3).alias("rounds")), 2)


@query("SELECT item_id % 4 AS part, sha256(string_agg(text || chr(0), '' ORDER BY item_id)) AS sha256 FROM benchmark GROUP BY 1")
def dataset_hash(spark, sf_dir):
    return reports.content_hash(table(spark, sf_dir, "benchmark").withColumn("part", F.col("item_id") % 4), "part", "item_id", "text")


@query("SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def store_stats(spark, sf_dir):
    return reports.store_stats(documents=table(spark, sf_dir, "documents"), embeddings=table(spark, sf_dir, "embeddings"))


@query("""WITH g AS (SELECT lang AS name, count(DISTINCT source) AS n FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY 1), q AS (SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL UNION SELECT 'none')
SELECT name, CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS state FROM q LEFT JOIN g USING (name) WHERE n IS NULL OR n > 1""")
def missing_sources(spark, sf_dir):
    """Languages stand for names, their sources for documents."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    required = rows.select(F.col("lang").alias("name")).unionByName(spark.range(1).select(F.lit("none").alias("name")))
    return reports.missing_sources(required, rows.where("doc_id % 2 = 0").select(F.col("lang").alias("name"), "source").distinct())


# ---- files -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'n' || n_regionkey AS name, 0 AS chunk_index, 'table' AS doc_type, true AS is_table, '| n_nationkey | n_name |' || chr(10) || '|--- |' || chr(10) || '|---' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey""")
def csv_ingest(spark, sf_dir):
    """A CSV file for each region, parsed and cut into chunks."""
    folder = shared_folder(spark, "csv")
    table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").write.partitionBy("n_regionkey").option("header", True).csv(folder)
    rows = office.block_chunks(office.parse_files(spark, folder, "*.csv"))
    return rows.select(F.concat(F.lit("n"), F.regexp_extract("source", r"n_regionkey=(\d+)", 1)).alias("name"), "chunk_index", "doc_type", "is_table", "content")


@query("""SELECT 'p' || n_regionkey AS name, 0 AS chunk_index, '' AS heading_path, 'text' AS doc_type, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS raw, rtrim(raw, chr(10)) AS content FROM nation GROUP BY n_regionkey""")
def text_ingest(spark, sf_dir):
    """A text file for each region, parsed and cut into chunks."""
    folder = shared_folder(spark, "text")
    table(spark, sf_dir, "nation").select("n_regionkey", "n_name").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(folder)
    parsed = office.parse_files(spark, folder, "*.txt")
    raw = parsed.select(F.col("path").alias("source"), F.element_at("blocks", 1)["content"].alias("raw"))
    rows = office.block_chunks(parsed).join(raw, "source")
    return rows.select(F.concat(F.lit("p"), F.regexp_extract("source", r"n_regionkey=(\d+)", 1)).alias("name"), "chunk_index", "heading_path", "doc_type", "raw", "content")
