"""Shared helpers: where intermediate tables go, and how Arrow batches are mapped."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch; documents can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1024, 4_000_000
#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 64_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "graphquarry-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries started within delete their shuffle files as they end, not when the driver next collects garbage."""
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, held)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with spent_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: whatever came of them has been written itself."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_scratch", None)
        if path:
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and by bytes, if they are larger."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def give_back() -> None:
    """A worker that ends a task gives memory back to the system; it is kept for later tasks, beside other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches):
        gc.disable()  # batches hold many small objects and no cycles
        try:
            yield from fn(batches)
        finally:
            gc.enable()
            give_back()

    return df.mapInArrow(run, schema)


def utf8(column: str):
    """The text's bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that executors can open, and the path in it; works for any scheme pyarrow knows."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def held_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a written table take in memory: all of its values, and 32 bytes a row."""

    def of(at: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(at)
        if isinstance(kind, T.StructType):
            return sum((of(at[f.name], f.dataType) for f in kind), F.lit(8))
        if isinstance(kind, T.ArrayType):
            return F.aggregate(at, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(of(x, kind.elementType), F.lit(0)) + 8)
        return F.lit(8)

    each = sum((F.coalesce(of(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema), F.lit(32))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def bounded_broadcast(df: DataFrame, share: float = 1.0) -> DataFrame:
    """A written table with a broadcast hint while its rows take at most ``share`` of BROADCAST_BYTES; beyond it Spark joins
    by shuffle, with equal results."""
    return F.broadcast(df) if held_bytes(df) <= share * BROADCAST_BYTES else df


def lowest_hashes(rows: DataFrame, group: str, sample: int) -> DataFrame:
    """Of each group's distinct ``rows`` the ``sample`` with the lowest hashes of ``k``.

    Only rows below a hash under which some four times as many keys should lie are sorted, so that the sorted rows don't
    grow with the table or its partitions.
    """
    shares = rows.groupBy(group).agg(F.approx_count_distinct("k").alias("#n")).select(F.col(group).alias("#group"), (F.lit(4.0 * sample) / F.greatest("#n", F.lit(1))).alias("#share"))
    shares = written(shares, "sample-shares")
    shares = bounded_broadcast(shares)
    near = rows.join(shares, F.col(group) == F.col("#group")).where(F.xxhash64("k") / F.lit(2.0**64) + 0.5 < F.col("#share"))
    order = Window.partitionBy(group).orderBy(F.xxhash64("k"), *rows.columns)
    return near.select(rows.columns).distinct().withColumn("#at", F.row_number().over(order)).where(F.col("#at") <= sample).drop("#at")
