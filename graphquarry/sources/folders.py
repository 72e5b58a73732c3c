"""Folders that all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """This application's folder for tables between steps: below ``spark.checkpoint.dir``, and on a local master without one
    below the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        base = f"file://{tempfile.gettempdir()}/graphquarry"
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: later plans start from the files, also after a lost executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more, as what came of them has been written itself."""
    for df in tables:
        if path := getattr(df, "_settled", None):
            removed(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has settled; results that weren't written elsewhere go with them."""
    removed(spark, scratch(spark))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark reads; a missing one is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
