"""Document changes as a stream: JSON files, Kafka or a watched folder in, one result a change out, one held state a path."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.folders import settled

CHANGE = "file_path string, change_type string, old_hash string, new_hash string, seq long"
KINDS = ("created", "modified", "deleted")
HELD = "change_type string, new_hash string, seq long, events long"
NUMBERED = "file_path string, seq long, change_type string, old_hash string, new_hash string, events long, late boolean"
#: Only this store keeps state on disk and can be read by variable.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_stream(spark: SparkSession, folder: str | None = None, kafka: dict | None = None, default_type: str | None = None) -> DataFrame:
    """Changes of a folder of JSON lines, or of a Kafka topic where its connector is installed. ``default_type`` stands for a
    missing change type (the prototypes' listener takes ``modified``)."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        rows = raw.select(F.from_json(F.col("value").cast("string"), CHANGE).alias("c"), F.col("offset")).select("c.file_path", "c.change_type", "c.old_hash", "c.new_hash", F.coalesce("c.seq", "offset").alias("seq"))
    else:
        rows = spark.readStream.schema(CHANGE).json(folder)
    return rows.withColumn("change_type", F.coalesce("change_type", F.lit(default_type))) if default_type else rows


def well_formed(changes: DataFrame) -> DataFrame:
    """With ``rejected``: changes without a path or of an unknown type are set apart instead of ending the stream."""
    ok = F.col("file_path").isNotNull() & F.coalesce(F.col("change_type").isin(*KINDS), F.lit(False))
    return changes.withColumn("rejected", ~ok)


class LastState(StatefulProcessor):
    """Holds of each path its last change and how many there were; numbers changes in order of ``seq``.

    The state of a path has one row of four values, whatever its history. A change whose ``seq`` isn't above the held one
    is late: it is counted, and changes nothing. A missing ``seq`` follows the held one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, digest, seq, events = self.held.get() if self.held.exists() else (None, None, None, 0)
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.sort_values("seq", kind="stable", na_position="last")
        out = []
        for change_type, new_hash, own in zip(frame["change_type"], frame["new_hash"], frame["seq"]):
            own = (seq or 0) + 1 if pd.isna(own) else int(own)
            events, late = events + 1, seq is not None and own <= seq
            out.append((key[0], own, change_type, digest, new_hash, events, late))
            if not late:
                kind, digest, seq = change_type, new_hash, own
        self.held.update((kind, digest, seq, events))
        yield pd.DataFrame(out, columns=["file_path", "seq", "change_type", "old_hash", "new_hash", "events", "late"])

    def close(self) -> None:
        pass


def numbered(changes: DataFrame) -> DataFrame:
    """A row for each well-formed change of a stream: (file_path, seq, change_type, old_hash, new_hash, events, late), where
    old_hash is the hash held before and events the path's changes so far. State is kept by path, in a store of the class
    STATE_STORE, which must be set when the query starts."""
    rows = well_formed(changes).where("NOT rejected").select("file_path", "change_type", "new_hash", "seq")
    return rows.groupBy("file_path").transformWithStateInPandas(LastState(), NUMBERED, "Append", "None")


def handled(changes: DataFrame, handler: Callable[[DataFrame], DataFrame], target: str) -> DataFrame:
    """One result a change (``changes``: file_path, seq, ..., late): outcome done, failed, superseded or late, attempts, error.

    Of several changes of a path only the last is handed to ``handler``, which reads the file as it is now; the earlier
    ones are superseded. ``handler`` gives (file_path, success, error) and runs once over all paths; what it gave is
    written before it is read, and those that failed or got no result run once more. A handler that isn't deterministic
    thus neither loses nor doubles a change."""
    order = Window.partitionBy("file_path").orderBy(F.desc("seq"), F.desc("events"))
    last = (F.row_number().over(order) == 1) & ~F.col("late")
    settled_changes = _written(changes.withColumn("last", F.when(F.col("late"), False).otherwise(last)), f"{target}/changes")
    live = settled_changes.where("last").drop("last", "late")
    results = retried(handler, live, target)
    outcome = F.when(F.col("late"), "late").when(~F.col("last"), "superseded").when(F.col("success"), "done").otherwise("failed")
    keyed = settled_changes.join(results.withColumn("last", F.lit(True)), ["file_path", "last"], "left")
    return keyed.select("file_path", "seq", "change_type", "old_hash", "new_hash", "events", outcome.alias("outcome"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "error")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def retried(run: Callable[[DataFrame], DataFrame], changes: DataFrame, target: str | None = None) -> DataFrame:
    """Results (file_path, success, error, attempts) of ``run``, a function from changes to (file_path, success[, error]); those
    that failed, or that it gave no result for, are run once more and their second results stand.

    Both results are written as soon as they are made (below ``target``, or a fresh shared folder) and only read from
    then on, since a plan of ``run`` that is evaluated again may give other results."""
    keep = (lambda df, name: _written(df, f"{target}/{name}")) if target else settled
    shape = lambda df: df.select("file_path", F.coalesce("success", F.lit(False)).alias("success"), (F.col("error") if "error" in df.columns else F.lit(None)).cast("string").alias("error"))
    once = shape(run(changes)).groupBy("file_path").agg(F.min("success").alias("success"), F.max("error").alias("error"))
    first = keep(once, "first")
    open_ = changes.join(first.where("success").select("file_path"), "file_path", "left_anti")
    again = shape(run(open_)).groupBy("file_path").agg(F.min("success").alias("success"), F.max("error").alias("error"))
    second = keep(open_.select("file_path").distinct().join(again, "file_path", "left").select("file_path", F.coalesce("success", F.lit(False)).alias("success"), F.when(F.col("success").isNull(), "no result").otherwise(F.col("error")).alias("error")), "second")
    return first.where("success").withColumn("attempts", F.lit(1)).unionByName(second.withColumn("attempts", F.lit(2)))


def apply_changes(changes: DataFrame, target: str, checkpoint: str, handler: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs what a stream of changes holds by now. Below ``target``: ``results/batch=N`` with one result a change, in order of
    batches, and ``rejected/batch=N``; a batch that runs again is written over. The states of paths stay in the
    checkpoint. Without a handler every change is done."""
    nothing = lambda df: df.select("file_path", F.lit(True).alias("success"))

    def batch(df: DataFrame, number: int) -> None:
        out = handled(df, handler or nothing, f"{target}/work/batch={number}")
        out.write.mode("overwrite").parquet(f"{target}/results/batch={number}")

    def apart(df: DataFrame, number: int) -> None:
        well_formed(df).where("rejected").drop("rejected").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    for rows, run, name in ((numbered(changes), batch, "states"), (changes, apart, "rejected")):
        with setting(changes.sparkSession, "spark.sql.streaming.stateStore.providerClass", STATE_STORE):
            query = rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what starts within; then it is as it was."""
    held = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def last_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(file_path, change_type, new_hash, seq, events) of every path, from the state store: as many rows as paths, however many
    batches there were."""
    held = spark.read.format("statestore").option("path", f"{checkpoint}/states").option("stateVarName", "held").load()
    return held.select("key.file_path", "value.change_type", "value.new_hash", "value.seq", "value.events")


def change_results(spark: SparkSession, target: str) -> DataFrame:
    """The results of all changes, with their batch."""
    return spark.read.parquet(f"{target}/results")


def rejected_changes(spark: SparkSession, target: str) -> DataFrame:
    """Changes that were set apart."""
    return spark.read.parquet(f"{target}/rejected")
