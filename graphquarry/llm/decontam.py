"""Benchmark decontamination with DataFrame functions only.

Normalised word windows of the benchmark are a broadcast hash set (by shuffle beyond BROADCAST_BYTES); every window
of every document is looked up in it by hash, hits are verified word by word, and covered words are counted or cut.

Words are runs of characters other than ASCII marks, white space and controls, with A-Z in lower case. A window is
``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty texts have
no words and no hits. An item without an id goes by the id ``null``. Rows that repeat an id and text get equal results
each; rows that share an id but not the text are judged apart. Without items nothing is hit. Other columns are kept by
``decontaminate`` and left out by ``contamination``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, written

WIDTH = 10
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; ASCII texts take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), "")


def with_words(words: Column, then) -> Column:
    """``then`` of the words, which are made once: a lambda's variable isn't put back in by the optimizer."""
    return F.transform(F.array(words), then)[0]


def windows(words: Column, widths: list[int], shape) -> Column:
    """Structs of every window of each width, by ``shape(words, place, width)``."""

    def of(ws: Column, width: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: shape(ws, i, width))
        return F.when(F.size(ws) >= width, made).otherwise(F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), lambda i: shape(ws, i, width)), 1, 0))

    return with_words(words, lambda ws: F.concat(*[of(ws, w) for w in widths]) if len(widths) > 1 else of(ws, widths[0]))


def benchmark_windows(items: DataFrame, width: int, item: str, text: str) -> DataFrame:
    """(width, h, words, items): the distinct windows, with the ids of the items that have each."""
    own = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text)).alias("ws"))
    own = own.withColumn("width", F.least(F.size("ws"), F.lit(width))).where("width > 0")
    cut = own.select("item", "width", F.explode(F.expr("transform(sequence(0, size(ws) - width), i -> slice(ws, i + 1, width))")).alias("words"))
    return cut.groupBy("width", F.xxhash64("words").alias("h"), "words").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k, th, place, width, items) of every verified occurrence; th is the text's hash."""
    known = written(benchmark_windows(items, width, item, item_text), "benchmark-windows")
    widths = [r["width"] for r in known.select("width").distinct().orderBy("width").collect()]  # width of them at most
    own = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    if not widths:
        return own.where("false").select("k", "th", F.lit(0).alias("place"), F.lit(0).alias("width"), F.array(F.lit("")).alias("items"))
    found = own.select("k", "th", F.inline(windows(words_of(F.col("t")), widths, lambda ws, i, w: F.struct(i.alias("place"), F.lit(w).alias("width"), F.xxhash64(F.slice(ws, i + 1, F.lit(w))).alias("h")))))
    hashes = bounded_broadcast(written(known.select("width", "h").distinct(), "benchmark-hashes"))
    found = found.join(hashes, ["h", "width"], "left_semi").groupBy("k", "th").agg(F.collect_set(F.struct("place", "width", "h")).alias("at"))
    found = written(found, "benchmark-candidates")
    some = bounded_broadcast(found.withColumnsRenamed({"k": "k2", "th": "th2"}))
    again = own.join(some, F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")))
    slices = with_words(words_of(F.col("t")), lambda ws: F.transform("at", lambda x: F.struct(x["place"].alias("place"), x["width"].alias("width"), x["h"].alias("h"), F.slice(ws, x["place"] + 1, x["width"]).alias("own"))))
    checked = again.select("k", "th", F.inline(slices))
    return checked.join(bounded_broadcast(known), ["h", "width"]).where(F.col("own") == F.col("words")).select("k", "th", "place", "width", "items").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = written(hits(docs, items, width, key, text, item, item_text), "benchmark-hits")
    covered = found.select("k", "th", F.explode(F.expr("sequence(place, place + width - 1)")).alias("p")).distinct().groupBy("k", "th").agg(F.count("*").alias("n_hit"))
    named = found.select("k", "th", F.explode("items").alias("item")).distinct().groupBy("k", "th").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("ids"))
    of = written(covered.join(named, (covered["k"].eqNullSafe(named["k"])) & (covered["th"] == named["th"])).select(covered["k"].alias("k2"), covered["th"].alias("th2"), "n_hit", "n_items", F.sha2(F.array_join("ids", ","), 256).alias("sha")), "benchmark-documents")
    of = bounded_broadcast(of)
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN_ANY_CASE), ""))
    own = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), n_words.cast("long").alias("n_words"))
    every = own.join(of, F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")), "left")
    n_hit, n_items = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_hit", "n_items"))
    return every.select(F.col("k").alias(key), "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, spans: bool = False, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; with ``spans`` they stay, with their normalised words that weren't hit."""
    found = hits(docs, items, width, key, text, item, item_text)
    covered = found.groupBy("k", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(place, place + width - 1)")))).alias("#covered"))
    covered = written(covered, "benchmark-covered")
    covered = bounded_broadcast(covered.withColumnsRenamed({"k": "#k", "th": "#th"}))
    on = F.col(f"`{key}`").eqNullSafe(F.col("#k")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("#th"))
    if not spans:
        return docs.join(covered, on, "left_anti")
    kept = with_words(words_of(F.col(text)), lambda ws: F.array_join(F.filter(ws, lambda w, i: ~F.array_contains("#covered", i)), " "))
    return docs.join(covered, on, "left").withColumn(text, F.when(F.col("#covered").isNull(), F.col(text)).otherwise(kept)).drop("#k", "#th", "#covered")
