"""The document registry's scans and deletes, uploads that are taken in, and which snapshots are committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOC_TYPES, basename


def find(registry: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal ``keys`` (such as file_id, sha or thread_id); a null key finds nothing."""
    out = registry
    for name, value in keys.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def newest_first(registry: DataFrame) -> DataFrame:
    """All rows, newest first; equal times by file_id, without a time last."""
    return registry.orderBy(F.desc_nulls_last("created_at"), "file_id")


def remove(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """``registry`` without the rows whose file_id is in ``gone``; ids that it doesn't hold change nothing."""
    return registry.join(gone.select("file_id").distinct(), "file_id", "left_anti")


def take_uploads(files: DataFrame, most_bytes: int) -> DataFrame:
    """(path, original_name, stored_name, sha256, size, outcome) of uploads (path, content): ``unsupported`` by extension,
    ``too_large`` beyond ``most_bytes``, else ``accepted``. The stored name is random; rejected uploads have neither it nor
    a hash. Null content is of no bytes."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    named = files.withColumn("original_name", F.coalesce(F.nullif(basename(F.col("path")), F.lit("")), F.lit("unknown")))
    suffix = F.lower(F.regexp_extract("original_name", r"[^.](\.[^.]+)$", 1))
    size = F.octet_length(content).cast("long")
    outcome = F.when(~suffix.isin(*DOC_TYPES), "unsupported").when(size > most_bytes, "too_large").otherwise("accepted")
    taken = outcome == "accepted"
    return named.select("path", "original_name", F.when(taken, F.concat(F.translate(F.uuid(), "-", ""), suffix)).alias("stored_name"), F.when(taken, F.sha2(content, 256)).alias("sha256"), size.alias("size"), outcome.alias("outcome"))


def committed(chunks: DataFrame, ingests: DataFrame) -> DataFrame:
    """The chunks (source, ...) that become their file's snapshot: those of ``ingests`` (path, approved, vectors_stored,
    graph_stored) with both stores written and no rejection; an unreviewed ingest (null) passes."""
    done = ingests.where(F.col("vectors_stored") & F.col("graph_stored") & F.coalesce("approved", F.lit(True)))
    return chunks.join(done.select(F.col("path").alias("source")).distinct(), "source", "left_semi")
