"""The registered queries of this subpackage; each is thin and gets its rows from its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, dac, decontam, fim, fmindex, jaccard, langid, merkle, token_count, topk, toxicity, warc
from .common import table
from .sql import ORACLES

END_ID = 2


def fold(key: Column, folds: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(directory, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = dac.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return dac.read_ids(manifest, kind=docs.schema["doc_id"].dataType.simpleString(), with_ids=False)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda k: fold(k, 5) == 0)
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", (F.coalesce(fold(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, lambda k: fold(k, 4) == 2))
    return found.select("doc_id", (F.coalesce(fold(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.repeated_words(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc_index, op2_token_file, op3_byte_bpe, op4_token_counts, op5_decontamination, op6_toxicity, op7_merkle, op8_language, op9_substring_dedup, op10_ngram_jaccard, op11_filter_audit, op12_exact_topk, op13_fill_in_middle)}
ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
