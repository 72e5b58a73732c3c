"""The training-data pipeline: each stage takes what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import bpe, decontam, fmindex, jaccard, langid
from graphquarry.llm.common import table, written

#: Near-duplicate settings of the pipeline: five words, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too far from every language go; the others stay as they are."""
    model = langid.learn(docs, lambda k: F.lit(False))
    found = langid.identify(docs, model, extra=docs.columns)
    return found.where(~F.col("rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.one_of_each(docs, size=SHINGLE, percent=PERCENT)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages are cut; a document left without words goes."""
    return fmindex.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text that is left, and what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontaminated", decontaminated), ("encoded", encoded)]

#: SQL can't express the centroids, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
