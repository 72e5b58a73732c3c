"""Held tables that change in place: Parquet in hash buckets of a key, of which a change rewrites only those it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.incremental import upsert
from .folders import removed, settled


@dataclass
class BucketTable:
    """A table below ``folder`` with distinct values of ``key``, in ``buckets`` parts by its hash.

    A change joins and rewrites the buckets of its keys, so what is read and written grows with the change (and the size of
    a bucket), not with the table. New contents are written apart before they take a bucket's place; a job that breaks off
    leaves buckets as they were or as they are to be, and can run again with the same change. One writer at a time. Rows
    of a null key aren't held."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    key: str
    buckets: int = 64

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: str, buckets: int = 64) -> BucketTable:
        """A new table of ``rows``; of rows of one key any stays."""
        out = cls(rows.sparkSession, folder, rows.schema, key, buckets)
        out._put(rows.where(F.col(key).isNotNull()).dropDuplicates([key]), "overwrite")
        return out

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self) -> DataFrame:
        return self._all().drop("bucket")

    def _all(self) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("bucket", T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.folder)

    def _put(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.select(*self.schema.names, self.bucket()).repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" else "static").partitionBy("bucket").parquet(self.folder)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys``: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect())

    def _replace(self, buckets: list[int], rows: DataFrame) -> None:
        """``rows`` in place of what ``buckets`` hold; buckets that are left empty go."""
        new = settled(rows.select(*self.schema.names), "buckets")
        left = {r[0] for r in new.select(self.bucket()).distinct().collect()}
        self._put(new, "overwrite")
        for b in sorted(set(buckets) - left):
            removed(self.spark, f"{self.folder}/bucket={b}")

    def upsert(self, new: DataFrame, order: str = "pos") -> int:
        """Rows of ``new`` take the place of those of equal keys, of several the last by ``order``; returns how many buckets
        were rewritten."""
        new = settled(new, "change")
        buckets = self.touched(new)
        if buckets:
            self._replace(buckets, upsert(self._all().where(F.col("bucket").isin(buckets)).drop("bucket"), new, self.key, order))
        return len(buckets)

    def delete(self, keys: DataFrame) -> int:
        """Rows with the keys of ``keys`` go; returns how many there were."""
        keys = settled(keys.select(self.key).distinct(), "change")
        buckets = self.touched(keys)
        held = self._all().where(F.col("bucket").isin(buckets)).drop("bucket")
        gone = held.join(keys, self.key, "left_semi").count() if buckets else 0
        if gone:
            self._replace(buckets, held.join(keys, self.key, "left_anti"))
        return gone

    def delete_where(self, condition: Column) -> int:
        """Rows for which ``condition`` holds go, such as a document's chunks; returns how many there were. All buckets are
        read, those without such rows aren't rewritten."""
        return self.delete(self.read().where(condition).select(self.key))
