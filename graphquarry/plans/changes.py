"""Registered queries over held tables that change: buckets, and documents carried through all stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental, updates
from ..sources.buckets import BucketTable
from ..sources.folders import shared_folder
from .registry import query, table


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 90 = 5 THEN 'new' ELSE lang END AS lang, n_chars FROM documents UNION ALL SELECT -doc_id - 1, 'added', n_chars FROM documents WHERE doc_id % 90 = 6) SELECT * FROM x WHERE doc_id % 7 <> 3 OR doc_id < 0""")
def bucket_changes(spark, sf_dir):
    """Documents in buckets; some come again (twice, the last stays), some are new, and some go."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    held = BucketTable.create(rows, shared_folder(spark, "buckets"), "doc_id", 16)
    some = rows.where("doc_id % 90 = 5")
    again = some.withColumn("lang", F.lit("old")).withColumn("pos", F.lit(1)).unionByName(some.withColumn("lang", F.lit("new")).withColumn("pos", F.lit(2)))
    held.upsert(again.unionByName(rows.where("doc_id % 90 = 6").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("added").alias("lang"), "n_chars", F.lit(1).alias("pos"))))
    held.delete(rows.where("doc_id % 7 = 3"))
    return held.read()


@query("""SELECT count(DISTINCT source) AS asked, count(*) FILTER (source IN (SELECT source FROM documents WHERE doc_id % 97 = 0)) AS deleted FROM documents""".replace("count(DISTINCT source) AS asked", "(SELECT count(DISTINCT source) FROM documents WHERE doc_id % 97 = 0) AS asked"))
def delete_counts(spark, sf_dir):
    """How many documents were named, and how many rows went with them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return incremental.delete_counts(docs, docs.where("doc_id % 97 = 0"), "source")


#: Sources stand for files, documents for their chunks. Every file is changed; those of sources of some lengths had no snapshot.
FILES_SQL = """d AS (SELECT 'p/' || source AS file_path, source AS doc_id, ['created', 'modified', 'deleted'][(ascii(right(source, 1)) % 3) + 1] AS change_type, ascii(right(source, 1)) % 2 = 0 AS snapped FROM documents GROUP BY source),
h AS (SELECT source AS doc_id, source || '#' || doc_id AS chunk_id, 'E' || (doc_id % 97) AS e, coalesce(text, '') AS content FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT source AS doc_id, source || '#' || doc_id AS chunk_id, 'E' || (doc_id % 97) AS e, doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS content FROM documents WHERE doc_id % 11 <> 0),
a AS (SELECT doc_id, chunk_id, d.file_path, change_type, change_type = 'deleted' OR (change_type = 'modified' AND NOT snapped) AS cleared, o.content IS NOT NULL AS held, n.content IS NOT NULL AS now, snapped AND o.content IS NOT DISTINCT FROM n.content AS same, coalesce(n.e, o.e) AS e, pos, snapped FROM (SELECT * FROM h) o FULL JOIN n USING (doc_id, chunk_id) JOIN d USING (doc_id)),
b AS (SELECT *, now AND change_type <> 'deleted' AND (change_type = 'created' OR cleared OR NOT held OR NOT same) AS stored, change_type = 'modified' AND NOT cleared AND held AND (NOT now OR NOT same) AS stale FROM a)"""


def changed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunk = F.concat("source", F.lit("#"), "doc_id")
    rows = docs.select(F.col("source").alias("doc_id"), chunk.alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("pos"), F.concat(F.lit("E"), F.col("doc_id") % 97).alias("e"))
    code = F.ascii(F.expr("right(doc_id, 1)"))
    files = rows.select("doc_id", F.concat(F.lit("p/"), "doc_id").alias("file_path"), F.element_at(F.array(*map(F.lit, ("created", "modified", "deleted"))), code % 3 + 1).alias("change_type")).distinct()
    old = rows.where("pos % 7 <> 0")
    entry = F.concat(F.lit("p/"), "doc_id", F.lit("::"), "chunk_id")
    entities = old.groupBy(F.col("e").alias("name")).agg(F.lit("T").alias("type"), F.lit("held").alias("description"), F.lit(1).alias("version"), F.array_sort(F.collect_list(entry)).alias("provenance"), F.array(F.lit("a")).alias("aliases"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    relations = old.groupBy(F.col("e").alias("head"), F.lit("USES").alias("rel_type"), F.lit("E1").alias("tail")).agg(F.lit(0.5).alias("confidence"), F.array_sort(F.collect_list(entry)).alias("provenance"))
    stores = updates.Stores(old.select("chunk_id", "doc_id", "content", F.lit("old").alias("model")), entities, relations, old.where(code % 2 == 0).select("doc_id", "chunk_id", "content"))
    new = rows.where("pos % 11 <> 0").withColumn("content", F.when(F.col("pos") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    embed = lambda chunks: chunks.select("chunk_id", "doc_id", "content", F.lit("new").alias("model"))
    extract = lambda chunks: (chunks.select("chunk_id", F.col("e").alias("name"), F.lit("T").alias("type"), F.lit("").alias("description"), "pos"), chunks.select("chunk_id", F.col("e").alias("head"), F.lit("uses").alias("relation"), F.lit("E1").alias("tail"), F.lit(0.75).alias("confidence"), "pos"))
    return updates.update_documents(stores, files, new, embed, extract, F.lit(9).cast("long"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, any_value(change_type) AS change_type, count(*) FILTER (stored) AS vectors_added, count(*) FILTER (stale OR (cleared AND held)) AS vectors_deleted, count(*) FILTER (stored) AS chunks_reprocessed,
count(*) FILTER (change_type = 'modified' AND NOT cleared AND held AND now AND same) AS chunks_unchanged, count(*) FILTER (stored AND (cleared OR change_type = 'created')) AS entities_added, count(*) FILTER (stored AND NOT cleared AND change_type = 'modified') AS entities_updated, count(*) FILTER (stored) AS relations_added FROM b GROUP BY doc_id""")
def document_updates(spark, sf_dir):
    """Counts of each file's change."""
    return changed(spark, sf_dir)[1]


@query(f"""WITH {FILES_SQL} SELECT chunk_id, doc_id, sha256(CASE WHEN stored THEN n.content ELSE h.content END) AS sha, CASE WHEN stored THEN 'new' ELSE 'old' END AS model FROM b LEFT JOIN n USING (doc_id, chunk_id) LEFT JOIN h USING (doc_id, chunk_id) WHERE stored OR (held AND NOT stale AND NOT cleared)""")
def updated_vectors(spark, sf_dir):
    """The vectors' rows after all changes."""
    return changed(spark, sf_dir)[0].vectors.select("chunk_id", "doc_id", F.sha2("content", 256).alias("sha"), "model")


@query(f"""WITH {FILES_SQL}, s AS (SELECT b.*, coalesce(b.e) AS name, file_path || '::' || chunk_id AS entry FROM b),
e AS (SELECT name, count(*) FILTER (held) AS was, count(*) FILTER (held AND NOT stale AND NOT cleared) AS kept, count(*) FILTER (stored) AS new, list_sort(list(entry) FILTER (stored OR (held AND NOT stale AND NOT cleared))) AS provenance FROM s GROUP BY name)
SELECT name, CASE WHEN kept > 0 THEN 1 ELSE 0 END + new AS version, coalesce(provenance, []) AS provenance FROM e WHERE kept > 0 OR new > 0""")
def updated_entities(spark, sf_dir):
    """The graph's entities after all changes: those without any provenance left are gone."""
    return changed(spark, sf_dir)[0].entities.select("name", F.col("version").cast("long").alias("version"), F.array_sort("provenance").alias("provenance"))


@query(f"""WITH {FILES_SQL}, s AS (SELECT b.*, file_path || '::' || chunk_id AS entry FROM b)
SELECT e AS head, 'USES' AS rel_type, 'E1' AS tail, CASE WHEN count(*) FILTER (stored) > 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence, list_sort(list(entry) FILTER (stored OR (held AND NOT stale AND NOT cleared))) AS provenance FROM s GROUP BY e HAVING count(*) FILTER (stored OR (held AND NOT stale AND NOT cleared)) > 0""")
def updated_relations(spark, sf_dir):
    """The graph's relations after all changes."""
    return changed(spark, sf_dir)[0].relations.withColumn("provenance", F.array_sort("provenance"))
