"""A stream's changes carried into held stores: files parsed, and vectors, graph and snapshots published together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_id
from ..operators.updates import Stores, update_documents
from ..sources import snapshots

NAMES = ("vectors", "entities", "relations", "snapshot")


@dataclass
class HeldStores:
    """The four stores below ``folder``, each in numbered versions. A last table names the versions that belong together, so
    readers see all of a batch's changes or none, and a writer that breaks off leaves the ones before in force."""

    spark: SparkSession
    folder: str

    def publish(self, stores: Stores) -> None:
        numbers = {name: snapshots.publish(getattr(stores, name), f"{self.folder}/{name}") for name in NAMES}
        row = self.spark.range(1).select(*[F.lit(n).alias(name) for name, n in numbers.items()])
        snapshots.publish(row, f"{self.folder}/together")

    def load(self) -> Stores:
        together = snapshots.load(self.spark, f"{self.folder}/together")
        if together is None:
            raise ValueError(f"no stores were published below {self.folder}")
        numbers = together.first()
        return Stores(*[self.spark.read.parquet(f"{self.folder}/{name}/v-{numbers[name]:09d}") for name in NAMES])


def store_handler(held: HeldStores, parse: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: Column) -> Callable[[DataFrame], DataFrame]:
    """A handler for ``cdc.apply_changes``: (file_path, success, error) of changes (file_path, change_type, ...).

    ``parse`` gives (file_path, chunk_id, content, error, ...) for the files (file_path) of creates and modifies as they are
    now: a row for each chunk, or one with an error for a file that can't be read. Such files fail and change nothing; all
    others are carried through ``update_documents`` together and published once. A batch that runs again finds its
    chunks in the snapshot, and then changes nothing."""

    def run(changes: DataFrame) -> DataFrame:
        wanted = changes.select("file_path", "change_type").dropDuplicates(["file_path"])
        parsed = parse(wanted.where("change_type <> 'deleted'").select("file_path"))
        failed = parsed.where("error IS NOT NULL").groupBy("file_path").agg(F.max("error").alias("error"))
        fine = wanted.join(failed, "file_path", "left_anti").withColumn("doc_id", doc_id(F.col("file_path")))
        chunks = parsed.where("error IS NULL AND chunk_id IS NOT NULL").drop("error").withColumn("doc_id", doc_id(F.col("file_path"))).drop("file_path")
        stores, _ = update_documents(held.load(), fine.select("doc_id", "file_path", "change_type"), chunks, embed, extract, now)
        held.publish(stores)
        return wanted.join(failed, "file_path", "left").select("file_path", F.col("error").isNull().alias("success"), "error")

    return run
