"""Registered queries of the retrieval engine, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, evaluation, graph, incremental, retrieval
from ..sources import readers
from ..sources.folders import shared_folder  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "rrf_fusion"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- retrieval -------------------------------------------------------------------------------------------------------

#: Every vector whose id is divisible by STEP is a query.
STEP = 20
SEARCHED = QUERY_SET = f"vec_id % {STEP} = 0"
RANKED_SQL = f"""s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
FROM embeddings v, embeddings q WHERE q.{QUERY_SET}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def ranked(spark, sf_dir, k):
    """Every vector whose id is divisible by 20 is a query, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(vectors, vectors.where(SEARCHED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k)


@query(f"WITH {RANKED_SQL} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    return ranked(spark, sf_dir, 5)


FUSED_SQL = f"""WITH {RANKED_SQL},
l AS (SELECT query_id // 40 AS pair, query_id AS list_id, rank, vec_id AS item FROM r WHERE rank <= 20),
f AS (SELECT pair AS query_id, item, sum(1.0::DOUBLE / (60 + rank)) AS raw, min(list_id * 1000 + rank) AS first FROM l GROUP BY ALL),
x AS (SELECT *, round(least(1.0, raw / ((SELECT count(DISTINCT list_id) FROM l WHERE l.pair = f.query_id) / 61.0::DOUBLE)), 6) AS score FROM f),
t AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item) AS rank FROM x)
SELECT query_id, rank, item, score FROM t WHERE rank <= 8"""


@query(FUSED_SQL)
def rrf_fusion(spark, sf_dir):
    """Two rewritten queries a question (neighbours in the query set; the last can be alone), 20 results each, fused to 8."""
    lists = ranked(spark, sf_dir, 20).select(F.expr(f"query_id div {2 * STEP}").alias("query_id"), F.col("query_id").alias("list_id"), F.col("rank").alias("pos"), F.col("vec_id").alias("item"))
    return retrieval.fuse(lists, 8)


@query(f"WITH {RANKED_SQL} SELECT query_id, round(avg(greatest(0.0, least(score, 1.0))), 4) AS support FROM r WHERE rank <= 3 GROUP BY query_id")
def retrieval_support(spark, sf_dir):
    return retrieval.support(ranked(spark, sf_dir, 8))


@query(f"""WITH {RANKED_SQL}, w AS (SELECT query_id, vec_id, round(score * v.label_weight, 6) AS weighted FROM r JOIN (SELECT vec_id AS id, CASE label % 5 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 ELSE 1.0 END::DOUBLE AS label_weight FROM embeddings) v ON v.id = r.vec_id WHERE rank <= 8)
SELECT query_id, vec_id, weighted, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, vec_id) AS rank FROM w""")
def weighted_rerank(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("text", "pdf", "table", "image", "markdown"))), (F.col("label") % 5 + 1).cast("int"))
    rows = ranked(spark, sf_dir, 8).join(table(spark, sf_dir, "embeddings").select("vec_id", kinds.alias("doc_type")), "vec_id")
    return retrieval.weighted_rerank(rows).select("query_id", "vec_id", "weighted", "rank")


@query(f"""WITH {RANKED_SQL}, h AS (SELECT query_id, vec_id, rank, CASE WHEN rank <= 20 THEN round(1 / (1 + exp(-((vec_id % 7) - 3.0::DOUBLE))), 6) END AS reranked FROM r WHERE rank <= 30)
SELECT query_id, vec_id, reranked, row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, CASE WHEN rank <= 20 THEN -reranked ELSE rank END, rank) AS final_rank FROM h""")
def rerank_head_tail(spark, sf_dir):
    """A raw score by id stands for the model's."""
    return retrieval.rerank_head(ranked(spark, sf_dir, 30), F.col("vec_id") % 7 - F.lit(3.0)).select("query_id", "vec_id", "reranked", "final_rank")


@query(f"""WITH {RANKED_SQL}, u AS (SELECT query_id, round(avg(greatest(0.0, least(score, 1.0))), 4) AS support FROM r WHERE rank <= 3 GROUP BY query_id),
k AS (SELECT query_id FROM u WHERE support < 0.9), l AS (SELECT query_id, 1 AS list_id, rank, vec_id AS item FROM r WHERE rank <= 8 AND query_id IN (FROM k)
UNION ALL SELECT CASE query_id % 40 WHEN 0 THEN query_id + 20 ELSE query_id - 20 END AS q, 2, rank, vec_id FROM r WHERE rank <= 20 AND q IN (FROM k)),
f AS (SELECT query_id, item, sum(1.0::DOUBLE / (60 + rank)) AS raw, min(list_id * 1000 + rank) AS first FROM l GROUP BY ALL),
x AS (SELECT *, round(least(1.0, raw / ((SELECT count(DISTINCT list_id) FROM l WHERE l.query_id = f.query_id) / 61.0::DOUBLE)), 6) AS score FROM f),
t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item) AS rank, item FROM x)
SELECT query_id, rank, item, true AS retried, 2 AS rounds FROM t WHERE rank <= 8 UNION ALL SELECT query_id, rank, vec_id, false, 1 FROM r WHERE rank <= 8 AND query_id NOT IN (FROM k)""")
def self_rag_refine(spark, sf_dir):
    """Weak queries are asked again in their neighbour's words, 20 wide."""
    wide = ranked(spark, sf_dir, 20).select("query_id", "rank", F.col("vec_id").alias("item"), "score")
    neighbour = F.when(F.col("query_id") % (2 * STEP) == 0, F.col("query_id") + STEP).otherwise(F.col("query_id") - STEP)
    again = lambda weak: wide.withColumn("query_id", neighbour).join(weak, "query_id", "left_semi")
    return retrieval.refine(wide.select("query_id").distinct(), wide.where("rank <= 8"), again, threshold=0.9)


SPACE_SQL = "regexp_replace({}, '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '{}', 'g')"
KEY_SQL = f"lower(trim({SPACE_SQL.format('text', ' ')}))"


@query(f"""WITH x AS (SELECT doc_id % 3 AS query_id, CASE WHEN doc_id % 7 = 0 THEN 'chunk:k' || (doc_id % 5) ELSE 'content:' || sha256({KEY_SQL}) END AS key, text, source, n_chars, doc_id, CASE WHEN doc_id % 4 < 2 THEN 'graph' ELSE 'vector' END AS kind, CASE WHEN doc_id % 5 = 1 THEN '' ELSE source END AS s, CASE WHEN doc_id % 7 = 0 THEN 'k' || (doc_id % 5) ELSE '' END AS i, doc_id % 2 AS p FROM documents),
f AS (SELECT query_id, key, s || '|' || i || '|' || p AS c, min(doc_id) AS pos FROM x WHERE s <> '' OR i <> '' OR p <> 0 GROUP BY ALL), l AS (SELECT query_id, key, list(c ORDER BY pos) AS citations FROM f GROUP BY ALL)
SELECT query_id, key, sha256(arg_min(text, doc_id)) AS content, arg_min(source, doc_id) AS source, max(n_chars / 100000.0::DOUBLE) AS score, CASE WHEN count(DISTINCT kind) > 1 THEN 'hybrid' ELSE min(kind) END AS retrieval_type, min(doc_id) AS first_pos, count(*) AS merged, coalesce(any_value(citations), []) AS citations FROM x LEFT JOIN l USING (query_id, key) GROUP BY query_id, key""")
def context_dedup(spark, sf_dir):
    """Documents stand for the contexts of three queries: by chunk where they have one, else by content; some cite nothing."""
    key = F.col("doc_id")
    chunk = F.when(key % 7 == 0, F.concat(F.lit("k"), key % 5)).otherwise("")
    cite = F.struct(F.when(key % 5 == 1, "").otherwise(F.col("source")).alias("source"), chunk.alias("chunk_id"), (key % 2).cast("int").alias("page"), F.lit("").alias("heading_path"))
    rows = table(spark, sf_dir, "documents").select((key % 3).alias("query_id"), F.col("text").alias("content"), "source", chunk.alias("chunk_id"), (F.col("n_chars") / 100000.0).alias("score"), F.when(key % 4 < 2, "graph").otherwise("vector").alias("retrieval_type"), key.alias("pos"), F.array(cite).alias("citations"))
    return retrieval.merge_evidence(rows).withColumn("content", F.sha2("content", 256)).withColumn("citations", retrieval.citation_text(F.col("citations")))


@query("""WITH f AS (SELECT lang AS item, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 3)::VARCHAR END AS chunk_id, n_chars % 2 AS page, min(doc_id) AS pos FROM documents GROUP BY ALL)
SELECT item, list(concat_ws('|', source, chunk_id, page) ORDER BY pos) AS citations FROM f WHERE source <> '' OR chunk_id <> '' OR page <> 0 GROUP BY item""")
def citation_merge(spark, sf_dir):
    """Some cite nothing, on page 0."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("item"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 3 == 0, "").otherwise((F.col("doc_id") % 3).cast("string")).alias("chunk_id"), (F.col("n_chars") % 2).alias("page"), F.col("doc_id").alias("pos"))
    return retrieval.merge_citations(rows)


@query("SELECT doc_id, '[' || doc_id || '] 来源: ' || source || ' | 类型: ' || lang || ' | chunk: ' || source || '#chunk-' || (doc_id % 4) || chr(10) || text AS block FROM documents")
def evidence_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("doc_id").alias("rank"), "source", F.col("lang").alias("retrieval_type"), tx.chunk_id(F.col("source"), F.col("doc_id") % 4).alias("chunk_id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("heading_path"), F.col("text").alias("content"))
    return retrieval.evidence_blocks(rows).select("doc_id", "block")


# ---- chunking --------------------------------------------------------------------------------------------------------

CHUNK_SQL = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index, start, content FROM (SELECT doc_id, s::INT AS start,
regexp_replace(substr(text, s + 1, 512), '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g') AS content FROM (SELECT doc_id, text, unnest(range(0, {}, 448)) AS s FROM documents WHERE length(text) > 0)) WHERE content <> ''"""


@query(CHUNK_SQL.format("greatest(length(text) - 64, 1)"))
def fixed_chunks(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"))


@query(CHUNK_SQL.format("length(text)"))
def fixed_chunks_tail(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), tail=True)


@query("""SELECT doc_id, p::INT AS pos, sentence FROM (SELECT doc_id, unnest(range(len(s))) AS p, unnest(s) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([。！？!?；;])[ \\t\\n\\x0B\\f\\r]*', '\\1' || chr(30), 'g'), chr(30)) AS s FROM documents)) WHERE sentence <> ''""")
def sentence_split(spark, sf_dir):
    return chunking.sentence_rows(table(spark, sf_dir, "documents"))


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"


#: Folds over lists: sentences of long sections into pieces, then sections and pieces into chunks.
STRUCTURAL_SQL = f"""WITH s AS (SELECT doc_id, k, sec FROM (SELECT doc_id, unnest(range(len(ps))) AS k, unnest(ps) AS raw FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE length(text) > 512)), LATERAL (SELECT {strip_sql('raw')} AS sec) WHERE sec <> ''),
w AS (SELECT doc_id, k, list_filter(string_split(regexp_replace(sec, '([。！？!?；;])[ \\t\\n\\x0B\\f\\r]*', '\\1' || chr(30), 'g'), chr(30)), lambda x: {strip_sql('x')} <> '') AS ws FROM s WHERE length(sec) > 512),
f AS (SELECT doc_id, k, list_reduce(list_transform(ws, lambda x: {{'out': []::VARCHAR[], 'buf': x}}), lambda a, x: {{
  'out': CASE WHEN length(x.buf) > 512 THEN list_concat(CASE WHEN a.buf <> '' THEN list_append(a.out, a.buf) ELSE a.out END, list_transform(range(0, length(x.buf), 448), lambda i: substr(x.buf, (i + 1)::INT, 512)))
    WHEN length(a.buf) + length(x.buf) <= 512 OR a.buf = '' THEN a.out ELSE list_append(a.out, a.buf) END,
  'buf': CASE WHEN length(x.buf) > 512 THEN '' WHEN length(a.buf) + length(x.buf) <= 512 THEN a.buf || x.buf ELSE x.buf END}}, {{'out': []::VARCHAR[], 'buf': ''}}) AS r FROM w),
u AS (SELECT doc_id, k, 0 AS j, 1 AS gap, sec AS piece FROM s WHERE length(sec) <= 512
  UNION ALL SELECT doc_id, k, unnest(range(len(ps))) AS j, 0, unnest(ps) FROM (SELECT doc_id, k, CASE WHEN r.buf <> '' THEN list_append(r.out, r.buf) ELSE r.out END AS ps FROM f)),
g AS (SELECT doc_id, list({{'out': []::VARCHAR[], 'buf': piece, 'gap': gap}} ORDER BY k, j) AS us FROM u GROUP BY doc_id),
p AS (SELECT doc_id, list_reduce(us, lambda a, x: {{
  'out': CASE WHEN a.buf = '' OR length(a.buf) + length(x.buf) + x.gap <= 512 THEN a.out ELSE list_append(a.out, a.buf) END,
  'buf': CASE WHEN a.buf = '' OR length(a.buf) + length(x.buf) + x.gap > 512 THEN x.buf WHEN x.gap = 1 THEN {strip_sql("a.buf || chr(10) || x.buf")} ELSE a.buf || chr(10) || x.buf END,
  'gap': 0}}, {{'out': []::VARCHAR[], 'buf': '', 'gap': 0}}) AS r FROM g),
c AS (SELECT doc_id, CASE WHEN r.buf <> '' THEN list_append(r.out, r.buf) ELSE r.out END AS cs FROM p
  UNION ALL SELECT doc_id, [text] FROM documents WHERE length(text) <= 512
  UNION ALL SELECT doc_id, [substr(text, 1, 512)] FROM documents WHERE length(text) > 512 AND doc_id NOT IN (SELECT doc_id FROM s))
SELECT doc_id, chunk_index::INT AS chunk_index, content FROM (SELECT doc_id, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS content FROM c) WHERE {strip_sql('content')} <> ''"""


@query(STRUCTURAL_SQL)
def structural_chunks(spark, sf_dir):
    return chunking.structural_chunks(table(spark, sf_dir, "documents"))


CORE_SQL = """c AS (SELECT doc_id, p::INT AS pos, regexp_replace(raw, '^[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g') AS sentence FROM
(SELECT doc_id, unnest(range(len(s))) AS p, unnest(s) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?；;\\n]+[。！？!?；;]?') AS s FROM documents))),
k AS (SELECT *, (CASE WHEN regexp_matches(sentence, '[0-9０-９,，、《》%％]') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(sentence, '，') THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM c WHERE length(sentence) BETWEEN 12 AND 80)"""


@query(f"WITH {CORE_SQL} SELECT doc_id, pos, sentence, score FROM k")
def core_sentences(spark, sf_dir):
    return chunking.core_sentences(table(spark, sf_dir, "documents"))


@query(f"""WITH {CORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM k)
SELECT doc_id, rank, CASE WHEN length(sentence) <= 24 THEN sentence ELSE substr(sentence, length(sentence) // 3 + 1, 10) END AS topic, '文档中提到"' || topic || '……"，具体内容是什么？' AS question, sentence AS golden_fragment FROM r WHERE rank <= 2""")
def synth_questions(spark, sf_dir):
    return chunking.synthesized_questions(table(spark, sf_dir, "documents"))


@query("""WITH s AS (SELECT vec_id // 64 AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) AS nxt FROM embeddings),
d AS (SELECT doc_id, pos, round(1 - list_cosine_similarity(e, nxt), 6) AS distance FROM s WHERE nxt IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM d),
c AS (SELECT doc_id, distance AS threshold FROM t WHERE r = round_even(0.85::DOUBLE * (n - 1), 0)::INT + 1)
SELECT doc_id, pos, distance, distance >= threshold AS boundary FROM d JOIN c USING (doc_id)""")
def semantic_boundaries(spark, sf_dir):
    """Runs of 64 vectors stand for the sentences of a document."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("doc_id"), F.col("vec_id").alias("pos"), "embedding")
    return chunking.semantic_distances(rows)


# ---- graph -----------------------------------------------------------------------------------------------------------


def graph_tables(spark, sf_dir):
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    n = nation.select(F.col("n_name").alias("name"), F.lit("Nation").alias("type"), F.lit("").alias("description"), F.concat(F.lit("f"), F.col("n_regionkey")).alias("source"), F.lit(1).alias("version"), F.col("n_nationkey").cast("long").alias("pos"))
    r = region.select(F.col("r_name").alias("name"), F.lit("Region").alias("type"), F.lit("a region").alias("description"), F.lit("f0").alias("source"), F.lit(2).alias("version"), (F.col("r_regionkey") + 100).cast("long").alias("pos"))
    homes = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name"), "n_name", "s_suppkey", "s_nationkey")
    s = homes.select(F.col("n_name").alias("name"), F.lit("Place").alias("type"), F.concat(F.lit("home of "), "s_name").alias("description"), F.concat(F.lit("g"), F.col("s_suppkey") % 3).alias("source"), F.lit(3).alias("version"), (F.col("s_suppkey") + 1000).alias("pos"))
    entities = n.unionByName(r).unionByName(s)
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("head"), F.lit("part of").alias("relation"), F.col("r_name").alias("tail"), F.lit(0.9).alias("confidence"), F.concat(F.lit("f"), F.col("n_regionkey")).alias("source"), F.col("n_nationkey").cast("long").alias("pos"))
    b = homes.select(F.col("s_name").alias("head"), F.lit("located in").alias("relation"), F.col("n_name").alias("tail"), F.lit(0.8).alias("confidence"), F.concat(F.lit("g"), F.col("s_suppkey") % 3).alias("source"), (F.col("s_suppkey") + 1000).alias("pos"))
    return entities, a.unionByName(b)


MENTIONS_SQL = """h AS (SELECT s_name, n_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT n_name AS name, 'Nation' AS type, '' AS description, 'f' || n_regionkey AS source, 1 AS version, n_nationkey::BIGINT AS pos FROM nation
UNION ALL SELECT r_name, 'Region', 'a region', 'f0', 2, r_regionkey + 100 FROM region
UNION ALL SELECT n_name, 'Place', 'home of ' || s_name, 'g' || (s_suppkey % 3), 3, s_suppkey + 1000 FROM h),
o AS (SELECT name, source, min(pos) AS pos FROM m GROUP BY ALL), ol AS (SELECT name, list(source ORDER BY pos) AS provenance FROM o GROUP BY name),
e AS (SELECT m.name, arg_min(type, pos) AS type, coalesce(arg_max(description, pos) FILTER (description <> ''), '') AS description, arg_max(version, pos) AS version FROM m GROUP BY m.name)"""


@query(f"WITH {MENTIONS_SQL} SELECT e.*, ol.provenance FROM e JOIN ol USING (name)")
def entity_merge(spark, sf_dir):
    return graph.merge_entities(graph_tables(spark, sf_dir)[0])


@query("""SELECT n_name AS head, 'PART_OF' AS rel_type, r_name AS tail, 0.9::DOUBLE AS confidence, ['f' || n_regionkey] AS provenance FROM nation JOIN region ON n_regionkey = r_regionkey""")
def relation_merge(spark, sf_dir):
    """Suppliers aren't entities here, so their relations are dropped."""
    entities, relations = graph_tables(spark, sf_dir)
    return graph.merge_relations(relations, graph.merge_entities(entities))


@query(f"""WITH {MENTIONS_SQL} SELECT name, type, list_filter(ol.provenance, lambda p: p <> 'f0') AS provenance FROM e JOIN ol USING (name) WHERE len(list_filter(ol.provenance, lambda p: p <> 'f0')) > 0""")
def delete_by_source(spark, sf_dir):
    entities, relations = graph_tables(spark, sf_dir)
    merged = graph.merge_entities(entities)
    return graph.without_provenance(merged, graph.merge_relations(relations, merged), lambda p: p == "f0")[0].select("name", "type", "provenance")


EDGES_SQL = """d AS (SELECT row_number() OVER () AS id, * FROM (SELECT n_name AS a, 'PART_OF' AS rel, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT s_name, 'LOCATED_IN', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)), w AS (SELECT id, a, rel, b FROM d UNION ALL SELECT id, b, rel, a FROM d)"""


def all_edges(spark, sf_dir):
    return graph_tables(spark, sf_dir)[1].select("head", tx.relation_type(F.col("relation")).alias("rel_type"), "tail")


@query(f"""WITH {EDGES_SQL}, o AS (SELECT a AS start, 1 AS hops, rel AS rels, b AS target, id FROM w WHERE a IN (SELECT n_name FROM nation))
SELECT start, hops, rels, target FROM o UNION ALL SELECT o.start, 2, o.rels || ', ' || w.rel, w.b FROM o JOIN w ON o.target = w.a AND o.id <> w.id""")
def neighbors_2hop(spark, sf_dir):
    return graph.neighbours(all_edges(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), 2)


@query("SELECT a.n_regionkey AS list_id, a.n_name AS left, b.n_name AS right FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation) a JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation) b ON a.n_regionkey = b.n_regionkey AND b.p > a.p AND b.p <= a.p + 2".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def entity_pairs(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "nation").withColumn("pos", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    return graph.near_pairs(rows.select(F.col("n_regionkey").alias("list_id"), "pos", F.col("n_name").alias("name")))


@query(f"WITH {MENTIONS_SQL} SELECT name, type, description FROM e WHERE contains(name, '1') OR contains(description, '1') ORDER BY name LIMIT 20")
def search_entities(spark, sf_dir):
    """At most 20 entities whose name or description has the keyword, as the feature states."""
    return graph.search_entities(graph.merge_entities(graph_tables(spark, sf_dir)[0]), "1")


RESOLVE_KEY_SQL = "regexp_replace(lower(regexp_replace(name, '\\s', '', 'g')), '(?i)(股份有限公司|有限责任公司|有限公司|集团|公司|股份|Corporation|Corp\\.?|Incorporated|Inc\\.?|Ltd\\.?|LLC|Co\\.?|S\\.A\\.|GmbH|AG)\\s*$', '')"
ENDS = ("", " Corporation", " Corp.", " Corp", " Incorporated", " Inc.", " Ltd.", " LLC", " Co.", " S.A.", " GmbH", " AG", "股份有限公司", "有限责任公司", "有限公司", "集团", "公司", "股份", " Co., Ltd")


def nth(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


@query(f"""WITH m AS (SELECT s_name || {list(ENDS)}[s_suppkey % {len(ENDS)} + 1] AS name, s_suppkey * 2 AS pos FROM supplier UNION ALL SELECT upper(s_name), s_suppkey * 2 + 1 FROM supplier),
k AS (SELECT *, {RESOLVE_KEY_SQL} AS key FROM m), f AS (SELECT key, arg_min(name, pos) AS canonical FROM k GROUP BY key) SELECT name, pos, canonical, canonical <> name AS merged FROM k JOIN f USING (key)""")
def entity_resolution(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.concat("s_name", nth(ENDS, F.col("s_suppkey"))).alias("name"), (F.col("s_suppkey") * 2).alias("pos")).unionByName(s.select(F.upper("s_name").alias("name"), (F.col("s_suppkey") * 2 + 1).alias("pos")))
    return graph.resolve_names(rows, tx.entity_key(F.col("name")))


SAID = ("works at", "Belongs-To", "located_in", " developed by ", "part of", "USES", "depends  on", "related to", "owns", "works__at", "_uses_", "manages", "PRODUCES")


@query(f"""SELECT said, CASE WHEN n IN ('BELONGS_TO', 'WORKS_AT', 'LOCATED_IN', 'DEVELOPED_BY', 'RELATED_TO', 'PART_OF', 'USES', 'DEPENDS_ON') THEN n ELSE 'RELATED_TO' END AS rel_type, count(*) AS n
FROM (SELECT said, upper(regexp_replace(regexp_replace(trim(said), '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS n FROM (SELECT {list(SAID)}[p_partkey % {len(SAID)} + 1] AS said FROM part)) GROUP BY 1, 2""")
def relation_normalize(spark, sf_dir):
    said = table(spark, sf_dir, "part").select(nth(SAID, F.col("p_partkey")).alias("said"))
    return said.groupBy("said", tx.relation_type(F.col("said")).alias("rel_type")).agg(F.count("*").alias("n"))


# ---- change handling -------------------------------------------------------------------------------------------------

EDITED_SQL = "o AS (SELECT doc_id AS chunk_id, text AS content FROM documents), n AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END AS content FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT -doc_id - 1, text FROM documents WHERE doc_id % 23 = 0), x AS (SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN n.chunk_id IS NULL THEN 'stale' WHEN o.chunk_id IS NULL THEN 'added' WHEN o.content IS NOT DISTINCT FROM n.content THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n USING (chunk_id))"


def snapshots(spark, sf_dir):
    """All documents, and a copy with some edited, some removed and some new."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    new = old.where("chunk_id % 17 <> 0").withColumn("content", F.when(F.col("chunk_id") % 10 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    return old, new.unionByName(old.where("chunk_id % 23 = 0").withColumn("chunk_id", -F.col("chunk_id") - 1))


@query(f"WITH {EDITED_SQL} SELECT chunk_id, state FROM x")
def snapshot_diff(spark, sf_dir):
    return incremental.snapshot_diff(*snapshots(spark, sf_dir))


@query(f"WITH {EDITED_SQL} SELECT count(*) FILTER (state IN ('added', 'changed')) AS added, count(*) FILTER (state IN ('stale', 'changed')) AS deleted, count(*) FILTER (state IN ('added', 'changed')) AS reprocessed, count(*) FILTER (state = 'unchanged') AS unchanged FROM x")
def change_counts(spark, sf_dir):
    return incremental.change_counts(incremental.snapshot_diff(*snapshots(spark, sf_dir)))


@query(f"WITH {EDITED_SQL} SELECT chunk_id AS path, CASE state WHEN 'stale' THEN 'deleted' WHEN 'added' THEN 'created' ELSE 'modified' END AS change_type FROM x WHERE state <> 'unchanged'")
def detect_changes(spark, sf_dir):
    return incremental.detect_changes(*(d.select(F.col("chunk_id").alias("path"), F.sha2("content", 256).alias("hash")) for d in snapshots(spark, sf_dir)))


@query("""SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT -vec_id - 1, label FROM embeddings WHERE vec_id % 23 = 0""")
def vector_upsert(spark, sf_dir):
    """Some vectors come again, twice, the last with another label; some are new."""
    held = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    some, kind = held.where("vec_id % 10 = 0"), held.schema["label"].dataType
    new = some.withColumn("pos", F.lit(1)).unionByName(some.withColumn("label", (F.col("label") + 100).cast(kind)).withColumn("pos", F.lit(2)))
    new = new.unionByName(held.where("vec_id % 23 = 0").withColumn("vec_id", -F.col("vec_id") - 1).withColumn("pos", F.lit(3)))
    return incremental.upsert(held, new, "vec_id")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def vector_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return incremental.delete_documents(docs, docs.where("doc_id % 97 = 0"), "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def review_gate(spark, sf_dir):
    """A toxic label stands for a rejection."""
    reviews = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("approved"))
    return incremental.approved(table(spark, sf_dir, "documents").select("doc_id", "lang"), reviews, "doc_id")


@query()
def line_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", incremental.line_diff("text", F.regexp_replace("text", "the", "thE")).alias("d")).select("doc_id", "d.*")


@query("""WITH u AS (SELECT doc_id AS file_id, sha256(text) AS sha, text FROM documents), g AS (SELECT sha, min(file_id) FILTER (file_id < 100) AS held, min(file_id) FILTER (file_id >= 100) AS first FROM u GROUP BY sha)
SELECT u.file_id, u.sha, coalesce(held, first) AS owner, held IS NULL AND u.file_id = first AS created FROM u JOIN g USING (sha) WHERE u.file_id >= 100""")
def doc_registry(spark, sf_dir):
    """Documents up to 100 are held; the others are uploads."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("pos"))
    return incremental.register(rows.where("file_id < 100").groupBy("sha").agg(F.min("file_id").alias("file_id")), rows.where("file_id >= 100"))


# ---- evaluation ------------------------------------------------------------------------------------------------------


@query(f"""WITH {RANKED_SQL}, q AS (SELECT vec_id AS query_id, label AS own FROM embeddings WHERE {QUERY_SET}),
f AS (SELECT q.query_id, min(rank) AS fr FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.vec_id <> q.query_id AND r.label = q.own AND rank <= 20 GROUP BY q.query_id)
SELECT k, round(avg(CASE WHEN fr <= k THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall, round(avg(coalesce(1.0::DOUBLE / fr, 0)), 6) AS mrr, round(avg(CASE WHEN fr <= k THEN 1 / log2(fr + 1) ELSE 0 END), 6) AS ndcg FROM f, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k""")
def eval_metrics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    queries = v.where(SEARCHED).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    rows = ranked(spark, sf_dir, 20).join(v.select("vec_id", "label"), "vec_id").join(queries, "query_id")
    return evaluation.metrics(evaluation.first_ranks(queries, rows, (F.col("vec_id") != F.col("query_id")) & (F.col("label") == F.col("own"))))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return evaluation.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"""WITH g AS (SELECT item_id, lower({SPACE_SQL.format('text', '')}) AS f FROM benchmark), d AS (SELECT doc_id, lower({SPACE_SQL.format('text', '')}) AS c FROM documents)
SELECT item_id, doc_id FROM g JOIN d ON contains(c, f) WHERE f <> ''""")
def golden_hit(spark, sf_dir):
    return evaluation.golden_hits(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


# ---- scans, tables and text ------------------------------------------------------------------------------------------


@query("SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(*) FILTER (props->>'k' IS NULL) AS missing FROM events GROUP BY event_type")
def json_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("missing"))


@query("""SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey""")
def table_to_markdown(spark, sf_dir):
    return readers.table_block(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


FILES = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".png", ".jpg", ".jpeg", ".bmp", ".csv", ".xlsx", ".xls", ".txt", ".MD", ".markdown", ".bin")
KINDS = ("pdf", "word", "word", "ppt", "ppt", "image", "image", "image", "image", "table", "table", "table", "text", "markdown", "unknown", "unknown")


@query(f"""SELECT doc_id, substr(sha256(p), 1, 16) AS path_id, substr(sha256(p), 1, 16) || '#chunk-' || (doc_id % 5) AS chunk_id, {list(KINDS)}[doc_id % 16 + 1] AS doc_type, doc_id || {list(FILES)}[doc_id % 16 + 1] AS name
FROM (SELECT doc_id, '/data/' || source || '/' || doc_id || {list(FILES)}[doc_id % 16 + 1] AS p FROM documents)""")
def path_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), nth(FILES, F.col("doc_id"))).alias("p"))
    return rows.select("doc_id", tx.doc_id(F.col("p")).alias("path_id"), tx.chunk_id(tx.doc_id(F.col("p")), F.col("doc_id") % 5).alias("chunk_id"), tx.doc_type(F.col("p")).alias("doc_type"), tx.basename(F.col("p")).alias("name"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT lang) > 1 AS ambiguous FROM documents GROUP BY source")
def source_alias(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), (F.count_distinct("lang") > 1).alias("ambiguous"))


from . import changes, extended, graphs, serving, stores, streams  # noqa: E402, F401  more queries register themselves here
