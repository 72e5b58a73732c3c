"""Filter interaction audit: what each filter removes alone, after others, and on average over all orders.

Five conditions give each document a mask of five bits. Of every part and label 32 signed sums of parities are aggregated
(a Walsh-Hadamard transform of the counts of masks); inverting them gives the count of each mask exactly, and from those 32
numbers every order of the filters is evaluated without a further pass over the documents. A document that fails k filters
is removed by each of them in 120 / k of the 120 orders, which gives the Shapley values in closed form.

Null texts are empty: such a document is short, and a copy of any empty one of smaller key. A null part is ''. Rows are
counted as they are, repeated ones too; copies are told by the SHA-256 of the text, and only a strictly smaller key makes a
row a copy, so rows of one key are no copies of one another, and rows without a key are neither copies nor make any. A key
is good (toxic) if any row of labels says so; null labels and null keys of labels say nothing. Without documents there are
no rows. Texts are handled whole, whatever their length. Other columns aren't looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 2 ** len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACES, SPECIAL = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
LABELS = ("all", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the conditions that a text alone fails: few words, repeated words, capitals, special characters."""
    words = F.array_remove(F.split(text, SPACES), "")
    counts = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"), F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).alias("upper"), F.char_length(text).alias("chars"))

    def bits(c: Column) -> Column:
        few = [c["n"] < LEAST_WORDS, 100 * c["distinct"].cast("long") < LEAST_DISTINCT * c["n"].cast("long"), 100 * c["upper"].cast("long") > MOST_UPPER * c["chars"].cast("long"), text.rlike(SPECIAL)]
        return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(few)), F.lit(0))

    return F.transform(F.array(counts), bits)[0]


def masked(docs: DataFrame, labels: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """(part, good, toxic, mask, n): how many documents of a part and its labels have a mask, copies told table-wide.

    Rows of one text, part and labels are counted before they are shuffled by text, so a text of a third of all rows is a
    few rows by then; they hold their smallest key and how many rows have it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(whole, 256).alias("digest"), text_mask(whole).alias("mask"))
    said = labels.select(F.col(key).alias("k"), "quality", "toxic").where(F.col("k").isNotNull()).groupBy("k").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    keyed = rows.groupBy("k", "part", "digest", "mask").agg(F.count("*").alias("n")).join(said, "k", "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    kinds = keyed.select("k", "part", "digest", "mask", "n", *flags).groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"), F.min("k").alias("first"), F.min_by("n", "k").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("digest"))
    originals = F.col("unkeyed") + F.when(F.col("first") == least, F.coalesce("n_first", F.lit(0))).otherwise(0)
    split = kinds.withColumn("originals", originals).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + MASKS // 2).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("cell"))
    return split.select("part", "good", "toxic", "cell.mask", "cell.n")


def parity_sums(cells: DataFrame) -> DataFrame:
    """(part, label, s0 to s31): the sum over masks of n, signed by the parity of the bits that mask and index share."""
    label = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))))
    sign = lambda w: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(w)) % 2)
    return cells.select("part", label.alias("label"), "mask", "n").groupBy("part", "label").agg(*(F.sum(F.col("n") * sign(w)).alias(f"s{w}") for w in range(MASKS)))


def inverted(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): the counts of the 32 masks, in order, from the parity sums; the division by 32 is exact."""
    parities = F.lit([[1 - 2 * ((m & w).bit_count() % 2) for w in range(MASKS)] for m in range(MASKS)])
    total = lambda signs: F.aggregate(F.zip_with("sums", signs, lambda a, b: a * b), F.lit(0).cast("long"), lambda x, y: x + y)
    counts = sums.select("part", "label", F.array(*(F.col(f"s{w}") for w in range(MASKS))).alias("sums"))
    counts = counts.select("part", "label", F.transform(parities, lambda signs: F.shiftright(total(signs), len(FILTERS))).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return counts.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in LABELS))


def steps() -> Column:
    """A row for each order and step: the filter's bit, and the bits of those before it."""
    bit = {x: 1 << k for k, x in enumerate(FILTERS)}
    every = [{"filter_order": o, "step": k + 1, "bit": bit[x], "earlier": sum(bit[y] for y in o[:k])} for o in ORDERS for k, x in enumerate(o)]
    return F.inline(F.from_json(F.lit(json.dumps(every)), "array<struct<filter_order:string,step:int,bit:int,earlier:int>>"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step, as the module says; long counts within the part.

    kept, removed and redundant (fails it, removed earlier) of the step; unique_fails (fails this filter only); good_lost and
    toxic_lost of what it removes; shapley, its removals summed over all orders.
    """
    rows = inverted(parity_sums(masked(docs, labels, part, key, text))).select("part", *LABELS, steps())

    def total(cells: str, holds: Callable[[Column], Column], times: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        weighted = F.transform(F.col(cells), lambda n, m: F.when(holds(m), n * times(m)).otherwise(0))
        return F.aggregate(weighted, F.lit(0).cast("long"), lambda x, y: x + y)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    clean = lambda m: m.bitwiseAND(F.col("earlier")) == 0
    removed = lambda m: fails(m) & clean(m)
    share = F.lit([0] + [len(ORDERS) // k for k in range(1, len(FILTERS) + 1)])  # by number of failed filters
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: clean(m) & ~fails(m)).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: fails(m) & ~clean(m)).alias("redundant"),
        total("all", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", fails, lambda m: share[F.bit_count(m)]).alias("shapley"),
    )
