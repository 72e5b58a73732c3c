"""What users call: documents into chunks, questions into contexts and answers, statements over the graph, and counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embedding import embed
from .operators import paths, reports, retrieval, vector_index
from .sources import office


def read_only(spark: SparkSession, statement: str) -> str:
    """The statement, if it is one query that changes nothing; else an error. Spark's own parser decides."""
    text = statement.strip().rstrip(";").strip()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [spark._jvm.java.lang.Class.forName(logical + k) for k in ("Command", "ParsedStatement")]
    if any(k.isInstance(plan) for k in kinds):
        raise ValueError("only queries that read are allowed")
    return text


@dataclass
class Engine:
    """Stores behind one set of functions. ``chunks`` has chunk_id, content, source, page, heading_path and embedding;
    ``entities`` and ``relations`` are as ``operators.graph`` has them. ``embedding`` makes a vector of a text, ``rerank`` is as
    in ``retrieval.retrieve``, and ``answer`` a column of a question's contexts, such as a model's."""

    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    embedding: Callable[[Column], Column] = embed
    rerank: Callable[[DataFrame], DataFrame] | None = None
    answer: Column | None = None
    _index: list[vector_index.Index] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def index(self) -> vector_index.Index:
        if not self._index:
            self._index.append(vector_index.build(self.chunks, key="chunk_id", vector="embedding"))
        return self._index[0]

    def parse_documents(self, folder: str, glob: str | None = None, semantic: bool = True) -> DataFrame:
        """Chunks of all files below a folder."""
        return office.chunk_documents(office.parse_files(self.spark, folder, glob), self.embedding if semantic else None)

    def search_knowledge(self, questions: DataFrame, top_k: int = 5) -> DataFrame:
        """Contexts of questions (query_id, question, queries, entities; without queries the question is asked), from 1 to 20 each."""
        none = F.array().cast("array<string>")
        asked = questions.withColumn("queries", F.when(F.size(F.coalesce("queries", none)) > 0, F.col("queries")).otherwise(F.array("question")) if "queries" in questions.columns else F.array("question"))
        asked = asked if "entities" in asked.columns else asked.withColumn("entities", none)
        near = retrieval.vector_contexts(self.index(), self.chunks, asked, self.embedding)
        return retrieval.retrieve(asked, near, paths.graph_contexts(self.entities, self.relations, asked), self.rerank, max(1, min(top_k, 20)))

    def ask(self, questions: DataFrame, intent: Column | None = None) -> DataFrame:
        """Questions with answer, contexts, confidence (their support), intent and rounds."""
        found = self.search_knowledge(questions, 8)
        answer = self.answer if self.answer is not None else F.element_at(F.transform("contexts", lambda c: c["content"]), 1)
        kept = questions.select("query_id", "question", (retrieval.intent_of(intent) if intent is not None else F.lit(retrieval.INTENTS[0])).alias("intent"), F.lit(1).alias("rounds"))
        return retrieval.results(kept, found, F.when(F.size("contexts") > 0, answer))

    def query_graph(self, statement: str) -> DataFrame:
        """A read-only SQL statement over ``entities`` and ``relations``."""
        text = read_only(self.spark, statement)
        self.entities.createOrReplaceTempView("entities")
        self.relations.createOrReplaceTempView("relations")
        return self.spark.sql(text)

    def get_stats(self) -> DataFrame:
        return reports.store_stats(vectors=self.chunks, entities=self.entities, relations=self.relations)
