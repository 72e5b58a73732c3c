"""Comparison reports: latency summaries, percent changes, rounds, dataset hashes and store counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency_summary(runs: DataFrame, baseline: str) -> DataFrame:
    """(variant, mean, p50, p95, p50_saved): of runs (variant, ms), and by how many percent the median is below the baseline's."""
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95)))
    each = runs.groupBy("variant").agg(F.avg("ms").alias("mean"), p[0].alias("p50"), p[1].alias("p95"))
    base = each.where(F.col("variant") == baseline).select(F.col("p50").alias("base"))
    saved = F.when(F.col("base") != 0, F.round((1 - F.col("p50") / F.col("base")) * 100, 2))
    return each.join(F.broadcast(base), how="left").select("variant", F.round("mean", 3).alias("mean"), F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), saved.alias("p50_saved"))


def tenths(x: Column) -> Column:
    """A number that isn't negative, rounded to tenths, as a count of them: by its exact binary value, and true halves to even.

    Twenty times the number less an odd whole number is computed without rounding where it is near 0, as both of its
    steps are differences of near numbers."""
    n = F.floor(x * 10)
    past = (x * 16 - (2 * n + 1)) + x * 4
    return n + F.when((past > 0) | ((past == 0) & (n % 2 == 1)), 1).otherwise(0)


def percent_change(new: Column, base: Column) -> Column:
    """``+12.3%`` of a change; N/A from a base of 0; null if either number is null."""
    change = (new - base) / F.when(base != 0, base) * 100
    n = tenths(F.abs(change))
    sign = F.when(change < 0, "-").otherwise("+")
    return F.when(base == 0, "N/A").when(change.isNotNull(), F.concat(sign, F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("%")))


def average_rounds(results: DataFrame, warm_up: int) -> DataFrame:
    """(variant, rounds): the mean number of retrieval rounds of results (variant, pos, rounds) after the first ``warm_up``."""
    return results.where(F.col("pos") > warm_up).groupBy("variant").agg(F.round(F.avg("rounds"), 4).alias("rounds"))


def content_hash(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, sha256): of each group's texts in order, each ended by a NUL. A group's texts meet in one row, so groups are
    datasets of bounded size, such as an evaluation set."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("t")))), lambda x: F.concat(x["t"], F.lit("\0"))), "")
    return rows.groupBy(by).agg(F.sha2(joined, 256).alias("sha256"))


def store_stats(**tables: DataFrame) -> DataFrame:
    """(store, n): row counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def versions(mentions: DataFrame) -> DataFrame:
    """Mentions (name, pos) numbered within each name in order of arrival."""
    return mentions.withColumn("version", F.row_number().over(Window.partitionBy("name").orderBy("pos")))


def missing_sources(required: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, state): required names that no registered document has, or that several have."""
    n = registered.groupBy("name").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
    return required.select("name").distinct().join(n, "name", "left").select("name", state.alias("state")).where("state IS NOT NULL")


def dimension_faults(vectors: DataFrame, expected: int) -> DataFrame:
    """(dimension, n): vectors whose dimension isn't the stored one; empty if all fit."""
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n")).where(F.col("dimension") != expected)


def checked_dimension(vectors: DataFrame, expected: int | None = None) -> DataFrame:
    """``vectors``, if all of them have ``expected`` components (or as many as each other); else an error that tells how many have
    which."""
    sizes = {r[0]: r[1] for r in vectors.groupBy(F.size("embedding")).count().limit(100).collect()}
    if len(sizes.keys() - {expected}) > (expected is None):
        raise ValueError(f"dimension {expected or 'of the first'} expected, found {sizes}")
    return vectors
