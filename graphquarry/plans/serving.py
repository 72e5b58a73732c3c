"""Registered queries: chunks by meaning, comparison of variants, reviews, snapshots, evaluation sets and totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.embedding import embed, embed_rows
from ..operators import evaluation, extraction, incremental, retrieval, variants, vector_index
from ..sources import office, readers, snapshots
from ..sources.folders import shared_folder
from .graphs import links
from .registry import query, table


@query()
def semantic_documents(spark, sf_dir):
    """Every document cut where the default embedding of its sentences changes."""
    block = F.struct(F.lit("paragraph").alias("kind"), F.col("text").alias("content"), F.lit(0).alias("page"), F.lit("").alias("heading_path"), F.lit(False).alias("is_table"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("text").alias("doc_type"), F.col("source").alias("path"), F.array(block).alias("blocks"))
    return office.chunk_documents(docs, embed).select("doc_id", "chunk_index", "content")


@query("""WITH m(place, metric) AS (VALUES (1, 'MRR'), (2, 'Recall@1'), (3, 'NDCG@1'), (4, 'Recall@5'), (5, 'NDCG@5'), (1000, 'P50 延迟(ms)'), (1001, 'P95 延迟(ms)'))
SELECT place::INT AS place, metric, CASE WHEN place < 1000 THEN '1.0000' ELSE '7' END AS base, CASE WHEN place < 1000 THEN '1.0000' END AS modern, CASE WHEN place < 1000 THEN '+0.0%' END AS change FROM m""")
def variant_comparison(spark, sf_dir):
    """Suppliers asked for by what their chunk says: each way finds it first, and only the base knows its latency."""
    s, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    chunks = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("k"), "s_suppkey").alias("chunk_id"), F.concat(F.sha1(F.col("s_name")), F.lit(" of "), "n_name").alias("content"), F.concat(F.lit("/d/"), "s_suppkey").alias("source"), "s_suppkey", "n_name")
    index = vector_index.build(embed_rows(chunks, "chunk_id", "content"), key="chunk_id", vector="embedding")
    asked = chunks.select(F.col("s_suppkey").alias("query_id"), F.col("content").alias("question"), F.array("content").alias("queries"), F.array("n_name").alias("entities"))
    ways = variants.build_variants(index, chunks, asked, *links(spark, sf_dir), embed, lambda weak: asked.join(weak, "query_id", "left_semi"))
    samples = chunks.select(F.col("s_suppkey").alias("query_id"), F.col("content").alias("question"), F.col("content").alias("golden_fragment"), F.concat("s_suppkey", F.lit("")).alias("source_doc"))
    timed = {"vector_raw": lambda q, k: ways["vector_raw"](q, k).withColumn("ms", F.lit(7.0)), "hybrid_rrf_self_rag": ways["hybrid_rrf_self_rag"]}
    return evaluation.comparison(evaluation.evaluate_variants(timed, samples, (1, 5)), "vector_raw", "hybrid_rrf_self_rag")


@query("""WITH x AS (SELECT source AS thread_id, doc_id AS pos, 'E' || (doc_id % 9) AS name, 'T' AS type, ascii(right(source, 1)) % 4 AS k FROM documents)
SELECT thread_id, pos, name, type FROM x WHERE k NOT IN (1, 2) UNION ALL SELECT DISTINCT thread_id, 0, 'fixed', 'U' FROM x WHERE k = 2""")
def review_corrections(spark, sf_dir):
    """Sources stand for threads: some are rejected, some corrected, some approved, some unanswered."""
    docs, code = table(spark, sf_dir, "documents"), F.ascii(F.expr("right(source, 1)")) % 4
    rows = docs.select(F.col("source").alias("thread_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("E"), F.col("doc_id") % 9).alias("name"), F.lit("T").alias("type"))
    fixed = F.when(code == 2, F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("fixed").alias("name"), F.lit("U").alias("type"))))
    answers = docs.where(code > 0).select(F.col("source").alias("thread_id"), F.when(code == 2, F.lit(None)).otherwise(code == 3).alias("approved"), fixed.alias("extractions")).distinct()
    return extraction.corrected(rows, answers)


@query("SELECT doc_id AS pos, 0 AS at, lang AS name, source FROM documents ORDER BY doc_id LIMIT 100")
def review_summary(spark, sf_dir):
    """The first 100 rows, as the feature states."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.lit(0).alias("at"), F.col("lang").alias("name"), "source")
    return extraction.review_summary(rows, ["pos", "at", "name", "source"])


@query("""SELECT source, count(*) AS chunks, count(*) FILTER (doc_id % 3 = 0) AS entities, count(*) FILTER (doc_id % 300 = 0) AS relations FROM documents GROUP BY source""")
def ingest_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return extraction.ingest_totals(docs, docs.where("doc_id % 3 = 0"), docs.where("doc_id % 300 = 0"))


@query("SELECT doc_id AS chunk_id, lang FROM documents WHERE doc_id % 6 <> 1")
def delete_chunks(spark, sf_dir):
    """Chunks by their ids, of which some are named twice and some aren't held."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    ids = held.where("chunk_id % 6 = 1").select("chunk_id")
    return incremental.delete_chunks(held, ids.unionByName(ids).unionByName(ids.select((-F.col("chunk_id") - 5).alias("chunk_id"))))[0]


@query("SELECT doc_id, lang, sha256(text || '!') AS sha FROM documents WHERE doc_id % 2 = 0")
def snapshot_published(spark, sf_dir):
    """Two versions published; the last is read."""
    folder = shared_folder(spark, "snapshots")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    snapshots.publish(docs, folder)
    snapshots.publish(docs.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit("!"))), folder)
    return snapshots.load(spark, folder).select("doc_id", "lang", F.sha2("text", 256).alias("sha"))


@query("""WITH x AS (SELECT 'what says ' || (doc_id % 500) AS question, arg_min(doc_id, doc_id) AS first FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 GROUP BY 1)
SELECT question, lang || doc_id AS golden_fragment, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source_doc FROM x JOIN documents ON doc_id = first""")
def evaluation_lines(spark, sf_dir):
    """Samples written as JSON lines, some broken, some without a fragment, some by its older name, and read again."""
    folder, key = shared_folder(spark, "samples"), F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    said, old = F.concat("lang", "doc_id"), key % 2 == 0
    rows = docs.select("doc_id", F.concat(F.lit("what says "), key % 500).alias("question"), F.when(~old & (key % 11 != 0), said).alias("golden_fragment"), F.when(old & (key % 11 != 0), said).alias("golden_chunk_content"), F.when(key % 3 != 0, F.col("source")).alias("source_doc"))
    lines = rows.select("doc_id", F.when(key % 7 == 0, "{broken").otherwise(F.to_json(F.struct("question", "golden_fragment", "golden_chunk_content", "source_doc"))).alias("value"))
    lines.coalesce(1).sortWithinPartitions("doc_id").select("value").write.text(folder)  # a set of samples is one file, as its order counts
    return readers.evaluation_set(spark, folder)


@query("""WITH x AS (SELECT doc_id, ['  ' || lang || ' ', '', chr(9) || source, ' ', coalesce(lang, '') || '2', 'z', 'late'] AS terms FROM documents)
SELECT doc_id, list_filter(list_transform(terms, lambda t: trim(t, ' ' || chr(9))), lambda t: t <> '')[1:3] AS queries, list_filter(list_transform(terms, lambda t: trim(t, ' ' || chr(9))), lambda t: t <> '')[1:5] AS entities FROM x""")
def clean_terms(spark, sf_dir):
    """Rewritten queries and entities, of which three and five count, as the feature states."""
    terms = F.array(F.concat(F.lit("  "), "lang", F.lit(" ")), F.lit(""), F.concat(F.lit("\t"), "source"), F.lit(" "), F.concat(F.coalesce("lang", F.lit("")), F.lit("2")), F.lit("z"), F.lit("late"))
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.clean_terms(terms, 3).alias("queries"), retrieval.clean_terms(terms, 5).alias("entities"))


@query("""WITH x AS (SELECT n_regionkey AS r, '# ' || r_name || chr(10) || string_agg('## ' || n_name || chr(10) || chr(10) || 'about ' || n_name || chr(10) || '| a | b |' || chr(10) || '| ' || n_nationkey || ' | x |', chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, r_name),
n AS (SELECT n_regionkey AS r, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r::BIGINT AS doc_id, 0 AS pos, 'heading' AS kind, r_name AS content, r_name AS heading_path FROM n WHERE k = 1
UNION ALL SELECT r, (3 * k - 2)::INT, 'heading', n_name, r_name || ' / ' || n_name FROM n UNION ALL SELECT r, (3 * k - 1)::INT, 'paragraph', 'about ' || n_name, r_name || ' / ' || n_name FROM n
UNION ALL SELECT r, (3 * k)::INT, 'table', '| a | b |' || chr(10) || '| ' || n_nationkey || ' | x |', r_name || ' / ' || n_name FROM n""")
def markdown_ingest(spark, sf_dir):
    """A markdown text for each region, as blocks under their headings."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(F.lit("## "), "n_name", F.lit("\n\nabout "), "n_name", F.lit("\n| a | b |\n| "), "n_nationkey", F.lit(" | x |"))
    texts = rows.groupBy(F.col("n_regionkey").cast("long").alias("doc_id"), "r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("t")))), lambda x: x["t"]), "\n").alias("parts"))
    blocks = readers.markdown_blocks(F.concat(F.lit("# "), "r_name", F.lit("\n"), "parts"))
    return texts.select("doc_id", F.posexplode(blocks).alias("pos", "b")).select("doc_id", "pos", "b.kind", "b.content", "b.heading_path")


@query("""WITH n AS (SELECT n_regionkey AS region, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS text FROM nation GROUP BY 1)
SELECT region, 'text' AS doc_type, text, (row_number() OVER (ORDER BY region))::INT AS place FROM n""")
def directory_scan(spark, sf_dir):
    """A text file for each region, read whole in order of their paths; files of other kinds are passed over."""
    folder = shared_folder(spark, "scan")
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), "n_name")
    nation.repartition("region").sortWithinPartitions("region", "n_name").write.partitionBy("region").text(f"{folder}/docs")
    nation.write.csv(f"{folder}/docs/other")
    found = readers.directory(spark, folder).select("path", F.regexp_extract("path", r"region=(\d+)", 1).cast("int").alias("region"), "doc_type", "text")
    return found.withColumn("place", F.row_number().over(Window.orderBy("path"))).drop("path")  # a row a region
