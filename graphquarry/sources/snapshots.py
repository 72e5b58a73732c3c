"""Published snapshots: numbered folders of Parquet, of which the last whole one counts.

A snapshot is whole once its committer has left ``_SUCCESS``, so a lost driver or executor leaves the one before in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def versions(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """(number, whole) of each snapshot under ``folder``; the listing grows with versions, not with rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v-")]
    return sorted((int(p.getName()[2:]), fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))) for p in found)


def publish(df: DataFrame, folder: str) -> int:
    """Writes ``df`` as the next snapshot and gives its number; two writers of one number can't both succeed."""
    number = max((n for n, _ in versions(df.sparkSession, folder)), default=0) + 1
    df.write.mode("error").parquet(f"{folder}/v-{number:09d}")
    return number


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last whole snapshot, if there is one."""
    whole = [n for n, done in versions(spark, folder) if done]
    return spark.read.parquet(f"{folder}/v-{whole[-1]:09d}") if whole else None


def remove(spark: SparkSession, folder: str) -> bool:
    """Drops all snapshots under ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
