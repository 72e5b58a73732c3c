"""Comparable ways of retrieval over the same stores, as functions for ``evaluation.evaluate_variants``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import settled
from . import paths, retrieval, vector_index

Search = Callable[[DataFrame, int], DataFrame]


def build_variants(index: vector_index.Index, chunks: DataFrame, rewritten: DataFrame, entities: DataFrame, relations: DataFrame, embed: Callable[[Column], Column], rewrite: Callable[[DataFrame], DataFrame], rerank: Callable[[DataFrame], DataFrame] | None = None, relevance: Callable[[DataFrame], DataFrame] = retrieval.support) -> dict[str, Search]:
    """vector_raw, vector_rewritten, hybrid_rrf, hybrid_rrf_self_rag and, with a reranker, hybrid_rrf_reranker.

    ``rewritten`` has query_id, question, queries and entities of all questions; without queries the question itself is
    asked. ``rewrite`` gives the same for the questions (query_id) that self-RAG asks again. What several variants need (the
    contexts of vectors and of the graph, and their fusion) is made once and written, when the first of them needs it."""
    own = rewritten.withColumn("queries", F.when(F.size(F.coalesce("queries", F.array().cast("array<string>"))) > 0, F.col("queries")).otherwise(F.array("question")))
    made: dict[str, DataFrame] = {}
    search = retrieval.by_embedding(index, embed)

    def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in made:
            made[name] = settled(make(), name)
        return made[name]

    def vectors() -> DataFrame:
        return once("vectors", lambda: retrieval.vector_contexts(index, chunks, own, embed, search))

    def linked(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        return paths.graph_lists(entities, relations, questions)

    def shown(rows: DataFrame, queries: DataFrame, rounds: Column) -> DataFrame:
        return rows.join(queries.select("query_id"), "query_id", "left_semi").select("query_id", "rank", "content", "source", rounds.alias("rounds"))

    def vector_raw(queries: DataFrame, k: int) -> DataFrame:
        near = search(queries.select(F.col("query_id").alias("key"), F.col("question").alias("text")), k).withColumnRenamed("key", "query_id")
        rows = near.join(chunks.select(F.col("chunk_id").alias("vec_id"), "content", "source"), "vec_id")
        return rows.select("query_id", "rank", "content", "source", F.lit(1).alias("rounds"))

    def vector_rewritten(queries: DataFrame, k: int) -> DataFrame:
        lists = vectors().withColumn("list_id", F.floor((F.col("pos") - 1) / retrieval.EACH).cast("int"))
        return shown(retrieval.hybrid_fuse(lists, k), queries, F.lit(1))

    def fused(most: int) -> DataFrame:
        """At least the first ``most`` of each question."""
        depth = max(most, 20 if rerank else 8)

        def make() -> DataFrame:
            lists, graph = linked(own)
            return retrieval.retrieve(own, vectors(), graph, top=depth, lists=lists)

        return once(f"fused-{depth}", make)

    def hybrid_rrf(queries: DataFrame, k: int) -> DataFrame:
        return shown(fused(k).where(F.col("rank") <= k), queries, F.lit(1))

    def hybrid_rrf_self_rag(queries: DataFrame, k: int) -> DataFrame:
        first = fused(max(k, 8)).where(F.col("rank") <= max(k, 8))
        texts = first.select("query_id", "key", "content", "source")
        again_texts: list[DataFrame] = []

        def again(weak: DataFrame) -> DataFrame:
            asked = rewrite(weak)
            lists, graph = linked(asked)
            found = settled(retrieval.retrieve(asked, retrieval.vector_contexts(index, chunks, asked, embed, search), graph, rerank, top=20, lists=lists), "again")
            again_texts.append(found.select("query_id", "key", "content", "source"))
            return found.select("query_id", "rank", F.col("key").alias("item"))

        out = retrieval.refine(queries, first.select("query_id", "rank", F.col("key").alias("item"), "score"), again, relevance=relevance)
        for more in again_texts:
            texts = texts.unionByName(more)
        named = texts.groupBy("query_id", F.col("key").alias("item")).agg(F.min("content").alias("content"), F.min("source").alias("source"))
        return shown(out.where(F.col("rank") <= k).join(named, ["query_id", "item"]), queries, F.col("rounds"))

    def hybrid_rrf_reranker(queries: DataFrame, k: int) -> DataFrame:
        return shown(retrieval.reranked(fused(max(k, 20)), own, rerank, k), queries, F.lit(1))

    every: dict[str, Search] = {"vector_raw": vector_raw, "vector_rewritten": vector_rewritten, "hybrid_rrf": hybrid_rrf, "hybrid_rrf_self_rag": hybrid_rrf_self_rag}
    return every | ({"hybrid_rrf_reranker": hybrid_rrf_reranker} if rerank else {})
