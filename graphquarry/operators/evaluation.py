"""Retrieval quality: first hits, Recall@K, MRR, NDCG and latency percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, squeezed
from ..sources.folders import settled
from .reports import percent_change


def first_ranks(queries: DataFrame, ranked: DataFrame, hit: Column) -> DataFrame:
    """(query_id, first_rank): of the rows for which ``hit`` holds; null without any."""
    found = ranked.where(hit).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").join(found, "query_id", "left")


def metrics(first: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, recall, mrr, ndcg): one relevant row per query; the reciprocal rank counts all fetched rows."""
    each = first.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    within = F.col("first_rank") <= F.col("k")
    return each.groupBy("k").agg(F.round(F.avg(F.when(within, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(within, 1 / F.log2(F.col("first_rank") + 1)).otherwise(0.0)), 6).alias("ndcg"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(p[0], 6).alias("p50"), F.round(p[1], 6).alias("p95"))


#: Lengths of the pieces by which fragments are found: a fragment takes the longest of which it has at least twice less one.
PIECES = (16, 6, 2, 1)


def golden_hits(golden: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the texts that hold a golden fragment, white space and case aside.

    A text is cut into pieces of equal length, end to end. Wherever a fragment of twice that length (less one) stands, it
    covers one of them whole, at one of as many offsets as a piece is long; so texts and fragments meet by equal pieces,
    and what meets is compared once. Each length is only cut if a fragment needs it."""
    wanted = golden.select("item_id", squeezed(F.col("text")).alias("fragment")).where("fragment <> ''").distinct()
    length = F.lit(PIECES[-1])
    for q in reversed(PIECES[:-1]):
        length = F.when(F.char_length("fragment") >= 2 * q - 1, q).otherwise(length)
    wanted = settled(wanted.withColumn("length", length), "fragments")
    used = sorted(r[0] for r in wanted.select("length").distinct().collect())
    keys = wanted.select("item_id", "fragment", "length", F.explode(F.transform(F.sequence(F.lit(1), F.col("length")), lambda o: F.substring("fragment", o, F.col("length")))).alias("piece")).distinct()
    texts = docs.select("doc_id", squeezed(F.coalesce("text", F.lit(""))).alias("content"))
    cut = None
    for q in used:
        one = texts.select("doc_id", F.lit(q).alias("length"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(f"(?s).{{{q}}}"), 0))).alias("piece"))
        cut = one if cut is None else cut.unionByName(one)
    if cut is None:
        return texts.join(wanted, F.lit(False)).select("item_id", "doc_id")
    met = settled(cut.join(keys, ["length", "piece"]).select("item_id", "fragment", "doc_id").distinct(), "met")
    return met.join(texts, "doc_id").where(F.contains("content", F.col("fragment"))).select("item_id", "doc_id").distinct()


def shares_run(fragment: Column, content: Column, least: float = 0.6) -> Column:
    """Whether a run of at least ``least`` of the fragment's length stands in the content: some part of just that length does."""
    n = F.char_length(fragment)
    size = F.ceil(F.lit(least) * n - 1e-9).cast("int")
    return (n > 0) & F.exists(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.contains(content, F.substring(fragment, i, size)))


def golden_matches(samples: DataFrame, results: DataFrame, least: float = 0.6) -> DataFrame:
    """(query_id, rank, hit) of ``matched``."""
    return matched(samples, results, least).select("query_id", "rank", "hit")


def matched(samples: DataFrame, results: DataFrame, least: float = 0.6) -> DataFrame:
    """``results`` (query_id, rank, content, source, ...) against their query's sample (query_id, golden_fragment, source_doc),
    with ``hit``: the fragment is in the content, or shares a run of at least ``least`` of its length with it (white space
    and case aside), and the file is the sample's, if that names one."""
    golden = samples.select("query_id", squeezed(F.col("golden_fragment")).alias("#g"), F.coalesce("source_doc", F.lit("")).alias("#wanted"))
    rows = results.join(golden, "query_id").withColumn("#c", squeezed(F.coalesce("content", F.lit(""))))
    right = (F.col("#wanted") == "") | (basename(F.col("source")) == basename(F.col("#wanted")))
    found = F.coalesce(right & (F.col("#g") != "") & (F.contains("#c", F.col("#g")) | shares_run(F.col("#g"), F.col("#c"), least)), F.lit(False))
    return rows.withColumn("hit", found).drop("#g", "#c", "#wanted")


def evaluate_variants(variants: dict[str, Callable[[DataFrame, int], DataFrame]], samples: DataFrame, ks: tuple[int, ...] = (5, 10), warm_up: int = 2, aliases: DataFrame | None = None) -> DataFrame:
    """(variant, k, recall, ndcg, hits, mrr, n, p50, p95, rounds) of several search functions under one protocol, in one plan.

    ``samples`` has query_id, question, golden_fragment and source_doc. A search function takes queries (query_id, question)
    and a depth, and gives (query_id, rank, content, source) and, if it knows them, the query's ``ms`` and ``rounds``;
    ranks beyond max(ks) don't count, for the reciprocal rank either. All variants' results are told apart by a column,
    matched and aggregated together. Rounds leave out the first ``warm_up`` queries by query_id, and latencies are of all.
    ``aliases`` (file_id, original_name) renames sources before they are compared."""
    depth, every = max(ks), None
    for name, search in variants.items():
        rows = search(samples.select("query_id", "question"), depth).where(F.col("rank") <= depth)
        extra = [(F.col(c) if c in rows.columns else F.lit(None)).cast("double").alias(c) for c in ("ms", "rounds")]
        one = rows.select(F.lit(name).alias("variant"), "query_id", "rank", "content", "source", *extra)
        every = one if every is None else every.unionByName(one)
    if aliases is not None:
        named = aliases.select(F.col("file_id").alias("#file"), "original_name").dropDuplicates(["#file"])
        every = every.withColumn("#file", basename(F.col("source"))).join(named, "#file", "left").withColumn("source", F.coalesce("original_name", "source")).drop("#file", "original_name")
    order = Window.orderBy("query_id")
    numbered = samples.select("query_id").withColumn("place", F.row_number().over(order))  # an evaluation set's keys
    asked = numbered.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    each = matched(samples, every).groupBy("variant", "query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"), F.max("ms").alias("ms"), F.max("rounds").alias("rounds"))
    each = settled(asked.join(each, ["variant", "query_id"], "left"), "evaluated")
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95)))
    whole = each.groupBy("variant").agg(F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"), F.round(p[0], 6).alias("p50"), F.round(p[1], 6).alias("p95"), F.round(F.coalesce(F.avg(F.when(F.col("place") > warm_up, F.col("rounds"))), F.lit(0.0)), 3).alias("rounds"))
    within = F.col("first_rank") <= F.col("k")
    by_k = each.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("variant", "k").agg(F.round(F.avg(F.when(within, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.when(within, 1 / F.log2(F.col("first_rank") + 1)).otherwise(0.0)), 6).alias("ndcg"), F.count_if(within).alias("hits"))
    return by_k.join(whole, "variant")


def evaluate(search: Callable[[DataFrame, int], DataFrame], samples: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(k, recall, ndcg, hits, mrr, n, p50, p95, rounds) of a search function, as ``evaluate_variants`` has them."""
    return evaluate_variants({"": search}, samples, ks).drop("variant")


def comparison(evaluated: DataFrame, base: str, modern: str) -> DataFrame:
    """(place, metric, base, modern, change) of two variants of ``evaluate_variants``: MRR, Recall@k and NDCG@k to four places,
    P50 and P95 in whole milliseconds (null without latencies), and percent changes."""
    ks = F.dense_rank().over(Window.partitionBy("variant").orderBy("k"))
    placed = evaluated.where(F.col("variant").isin(base, modern)).withColumn("at", ks)
    row = lambda place, metric, value: F.struct(place.alias("place"), metric.alias("metric"), value.cast("double").alias("value"))
    per_k = placed.select("variant", F.inline(F.array(row(2 * F.col("at"), F.concat(F.lit("Recall@"), "k"), F.col("recall")), row(2 * F.col("at") + 1, F.concat(F.lit("NDCG@"), "k"), F.col("ndcg")))))
    once = placed.where("at = 1").select("variant", F.inline(F.array(row(F.lit(1), F.lit("MRR"), F.col("mrr")), row(F.lit(1000), F.lit("P50 延迟(ms)"), F.col("p50")), row(F.lit(1001), F.lit("P95 延迟(ms)"), F.col("p95")))))
    both = per_k.unionByName(once).groupBy("place", "metric").agg(F.max(F.when(F.col("variant") == base, F.col("value"))).alias("b"), F.max(F.when(F.col("variant") == modern, F.col("value"))).alias("m"))
    text = lambda c: F.when(F.col("place") >= 1000, F.format_string("%d", F.bround(c, 0).cast("long"))).when(c.isNotNull(), F.format_string("%.4f", c))
    shown = lambda c: F.when(c.isNotNull(), text(c))
    return both.select("place", "metric", shown(F.col("b")).alias("base"), shown(F.col("m")).alias("modern"), percent_change(F.col("m"), F.col("b")).alias("change"))
