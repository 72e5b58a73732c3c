"""Extracted entities and relations: replies into rows, distinct rows, sources and totals.

A structured model is a plug-in: a function of Arrow batches that gives replies (chunk_id, pos, reply as JSON). Everything
after it is set at a time and doesn't depend on the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_fence

REPLY = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<head:string,relation:string,tail:string,confidence:double>>"


def filled(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def parsed(replies: DataFrame) -> DataFrame:
    """(chunk_id, pos, r) of JSON replies, with or without a code fence; what isn't JSON gives nulls."""
    return replies.select("chunk_id", "pos", F.from_json(without_fence(F.col("reply")), REPLY).alias("r"))


def entity_rows(replies: DataFrame) -> DataFrame:
    """(chunk_id, pos, at, name, type, description) without nameless ones; the default type is Concept."""
    each = parsed(replies).select("chunk_id", "pos", F.posexplode("r.entities").alias("at", "e")).where(F.coalesce("e.name", F.lit("")) != "")
    return each.select("chunk_id", "pos", "at", "e.name", filled(F.col("e.type"), "Concept").alias("type"), F.coalesce("e.description", F.lit("")).alias("description"))


def relation_rows(replies: DataFrame) -> DataFrame:
    """(chunk_id, pos, at, head, relation, tail, confidence) with both ends; the defaults are related_to and 0.5."""
    each = parsed(replies).select("chunk_id", "pos", F.posexplode("r.relations").alias("at", "x")).where((F.coalesce("x.head", F.lit("")) != "") & (F.coalesce("x.tail", F.lit("")) != ""))
    return each.select("chunk_id", "pos", "at", "x.head", filled(F.col("x.relation"), "related_to").alias("relation"), "x.tail", F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"))


def distinct_in(rows: DataFrame, keys: list[str], order: list[str], by_chunk: bool = True) -> DataFrame:
    """The first row of each key, within each chunk or (prototype rule) over all chunks."""
    keys = ["chunk_id", *keys] if by_chunk else keys
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("#r")).select(*keys, "#r.*").select(rows.columns)


def with_sources(rows: DataFrame, chunks: DataFrame, default: str = "") -> DataFrame:
    """Extracted rows with the source of their chunk (chunk_id, source)."""
    named = chunks.select("chunk_id", "source").dropDuplicates(["chunk_id"])
    return rows.join(named, "chunk_id", "left").withColumn("source", F.coalesce("source", F.lit(default)))


def review_summary(rows: DataFrame, columns: list[str], most: int = 100) -> DataFrame:
    """The first ``most`` extracted rows by place: what a reviewer is shown."""
    return rows.orderBy("pos", "at").limit(most).select(columns)


def corrected(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Extracted rows after review (thread_id, approved, extractions as rows or null): rejected threads give none, threads
    with corrections give those, others stay."""
    same = [c for c in rows.columns if c != "thread_id"]
    kept = rows.join(answers.where(~F.coalesce("approved", F.lit(True)) | F.col("extractions").isNotNull()).select("thread_id"), "thread_id", "left_anti")
    fixed = answers.where(F.coalesce("approved", F.lit(True)) & F.col("extractions").isNotNull()).select("thread_id", F.explode("extractions").alias("x")).select("thread_id", *[F.col(f"x.{c}").alias(c) for c in same])
    return kept.select("thread_id", *same).unionByName(fixed)


def ingest_totals(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(source, chunks, entities, relations) of each source."""
    n = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    out = n(chunks, "chunks").join(n(entities, "entities"), "source", "left").join(n(relations, "relations"), "source", "left")
    return out.na.fill(0, ["entities", "relations"])
