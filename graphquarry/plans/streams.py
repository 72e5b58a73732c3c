"""Registered queries over streams of changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.folders import removed, shared_folder
from ..streaming import cdc, watcher
from .registry import query, table

CHANGES_SQL = "c AS (SELECT source || '/' || (doc_id % 50) AS file_path, CASE WHEN doc_id % 9 = 0 THEN 'deleted' ELSE 'modified' END AS change_type, sha256(text) AS new_hash, doc_id AS seq FROM documents)"


def streamed(spark, sf_dir):
    """Documents written as changes in JSON, and run through the stream with a handler that can't read every third path."""
    base = shared_folder(spark, "cdc")
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id") % 50).alias("file_path"), F.when(F.col("doc_id") % 9 == 0, "deleted").otherwise("modified").alias("change_type"), F.lit("").alias("old_hash"), F.sha2("text", 256).alias("new_hash"), F.col("doc_id").alias("seq"))
    rows.write.json(f"{base}/in")
    handler = lambda df: df.select("file_path", (F.length("file_path") % 3 != 0).alias("success"), F.when(F.length("file_path") % 3 == 0, "unreadable").alias("error"))
    cdc.apply_changes(cdc.change_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/state", handler)
    return base


@query(f"WITH {CHANGES_SQL} SELECT file_path, arg_max(change_type, seq) AS change_type, arg_max(new_hash, seq) AS new_hash, max(seq) AS seq, count(*)::BIGINT AS events FROM c GROUP BY 1")
def cdc_stream(spark, sf_dir):
    """The state that the stream holds of each path."""
    return cdc.last_states(spark, f"{streamed(spark, sf_dir)}/state")


@query(f"""WITH {CHANGES_SQL}, n AS (SELECT *, lag(new_hash) OVER w AS old_hash, row_number() OVER w AS events, seq = max(seq) OVER (PARTITION BY file_path) AS last FROM c WINDOW w AS (PARTITION BY file_path ORDER BY seq))
SELECT file_path, seq, change_type, old_hash, new_hash, events, CASE WHEN NOT last THEN 'superseded' WHEN length(file_path) % 3 = 0 THEN 'failed' ELSE 'done' END AS outcome,
CASE WHEN NOT last THEN 0 WHEN length(file_path) % 3 = 0 THEN 2 ELSE 1 END::INT AS attempts, CASE WHEN last AND length(file_path) % 3 = 0 THEN 'unreadable' END AS error FROM n""")
def change_results(spark, sf_dir):
    """One result for each change; those whose handler fails are tried twice."""
    return cdc.change_results(spark, f"{streamed(spark, sf_dir)}/out").drop("batch")


@query("""WITH r AS (SELECT r_regionkey AS region FROM region), x AS (SELECT region, 1 AS poll, 'created' AS change_type FROM r UNION ALL SELECT region, 2, 'deleted' FROM r WHERE region = 1 UNION ALL SELECT region + 100, 2, 'created' FROM r)
SELECT region, poll::INT AS poll, change_type, 1::BIGINT AS files FROM x""")
def watched_folder(spark, sf_dir):
    """A file for each region is written and seen; then one is removed and as many more are written."""
    base = shared_folder(spark, "watched")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), "n_name")

    def poll():
        cdc.apply_changes(watcher.watched(spark, f"{base}/docs", f"{base}/listings"), f"{base}/out", f"{base}/state")

    put = lambda df, mode: df.repartition("region").write.mode(mode).partitionBy("region").text(f"{base}/docs")
    put(rows, "overwrite")
    poll()
    removed(spark, f"{base}/docs/region=1")
    put(rows.withColumn("region", F.col("region") + 100), "append")
    poll()
    seen = cdc.change_results(spark, f"{base}/out").withColumn("region", F.regexp_extract("file_path", r"region=(\d+)", 1).cast("int"))
    polls = seen.select("seq").distinct().withColumn("poll", F.row_number().over(Window.orderBy("seq")))  # two rows
    return seen.join(polls, "seq").groupBy("region", "poll", "change_type").agg(F.count("*").alias("files"))
