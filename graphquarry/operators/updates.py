"""Changed documents carried through all stores: vectors, entities, relations and snapshots, many documents at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import provenance, relation_type
from ..sources.folders import settled
from .graph import merge_into_graph
from .incremental import document_handlers, upsert


@dataclass
class Stores:
    """vectors (chunk_id, doc_id, content, embedding, ...), entities and relations as ``graph`` has them, and snapshot (doc_id,
    chunk_id, content)."""

    vectors: DataFrame
    entities: DataFrame
    relations: DataFrame
    snapshot: DataFrame


def tails(p: Column) -> Column:
    """An entry ``a::b::c`` and what follows each ``::``: the chunk ids that it can stand for."""
    parts = F.split(p, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))


def heads(p: Column) -> Column:
    """An entry and what precedes each ``::``: the sources that it can stand for."""
    parts = F.split(p, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))


def without_entries(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations without the provenance of ``gone`` (kind, value): of kind ``chunk`` entries that are the id or end
    in ``::id``, of kind ``source`` those that are the source or begin with ``source::``. Relations that are left
    without any go, then such entities with all their relations; those that none of ``gone`` meets stay as they are.

    Entries meet ``gone`` by an equi-join, so it can be of any size."""
    gone = gone.where("value IS NOT NULL").select("kind", "value").distinct()

    def left(df: DataFrame, key: list[str]) -> DataFrame:
        each = df.select(*key, F.explode("provenance").alias("entry"))
        forms = F.concat(F.transform(tails(F.col("entry")), lambda v: F.struct(F.lit("chunk").alias("kind"), v.alias("value"))), F.transform(heads(F.col("entry")), lambda v: F.struct(F.lit("source").alias("kind"), v.alias("value"))))
        met = each.select(*key, "entry", F.inline(forms)).join(gone, ["kind", "value"], "left_semi").select(*key, "entry").distinct()
        met = met.groupBy(*key).agg(F.collect_set("entry").alias("#gone"))
        out = df.join(met, key, "left").withColumn("provenance", F.when(F.col("#gone").isNull(), F.col("provenance")).otherwise(F.array_except("provenance", "#gone")))
        return out.where(F.col("#gone").isNull() | (F.size("provenance") > 0)).select(df.columns)

    kept = settled(left(entities, ["name"]), "entities")
    dead = settled(entities.select("name").join(kept.select("name"), "name", "left_anti"), "dead")
    edges = left(relations, ["head", "rel_type", "tail"])
    for end in ("head", "tail"):
        edges = edges.join(dead.withColumnRenamed("name", end), end, "left_anti")
    return kept, settled(edges.select(relations.columns), "relations")


def merge_into_relations(held: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (head, rel_type, tail, confidence, provenance) with mentions (head, relation, tail, confidence, entry, pos)
    between known entities merged in: the last confidence wins, provenance is added in order, empty entries add none."""
    names = entities.select("name")
    key = ["head", "rel_type", "tail"]
    rows = mentions.join(names.withColumnRenamed("name", "head"), "head", "left_semi").join(names.withColumnRenamed("name", "tail"), "tail", "left_semi").withColumn("rel_type", relation_type(F.col("relation")))
    first = rows.groupBy(*key, "entry").agg(F.min("pos").alias("pos"))
    said = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("entry") != "", F.struct("pos", "entry")))), lambda x: x["entry"]).alias("new_provenance"))
    new = rows.groupBy(*key).agg(F.max_by("confidence", "pos").alias("new_confidence")).join(said, key).withColumn("hit", F.lit(True))
    none = F.array().cast("array<string>")
    both = held.join(new, key, "full_outer")
    return both.select(*key, F.when(F.col("hit"), F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.array_union(F.coalesce("provenance", none), F.coalesce("new_provenance", none)).alias("provenance"))


def update_documents(stores: Stores, changes: DataFrame, current: DataFrame, embed: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: Column) -> tuple[Stores, DataFrame]:
    """The stores after ``changes`` (doc_id, file_path, change_type; one a document), and counts for each change.

    ``current`` (doc_id, chunk_id, content, ...) has the chunks of the files as they are now. A created document's chunks are
    stored beside whatever there is. Of a modified one only chunks whose content changed are removed and stored again;
    without a snapshot everything of the document goes first, and all chunks are stored. A deleted one's vectors, graph
    entries and snapshot go. ``embed`` gives the rows of vectors for chunks, ``extract`` entities (chunk_id, name, type,
    description, pos) and relations (chunk_id, head, relation, tail, confidence, pos) of chunks; both only get chunks that
    are stored. Entity versions go on from the held ones. Counts are vectors_added, vectors_deleted, chunks_reprocessed,
    chunks_unchanged, entities_added, entities_updated and relations_added.
    """
    known = stores.snapshot.select("doc_id").distinct().withColumn("snapped", F.lit(True))
    changes = settled(changes.join(known, "doc_id", "left").withColumn("cleared", (F.col("change_type") == "deleted") | ((F.col("change_type") == "modified") & F.col("snapped").isNull())), "changes")
    actions = settled(document_handlers(changes.select("doc_id", "change_type"), stores.snapshot, current), "actions").join(changes.select("doc_id", "file_path", "change_type", "cleared"), "doc_id")
    stale = actions.where("NOT cleared AND change_type = 'modified' AND action IN ('remove', 'replace')")
    cleared = changes.where("cleared").select("doc_id")
    chunks = settled(current.join(actions.where("action IN ('store', 'replace')").select("chunk_id", "file_path"), "chunk_id").withColumn("origin", F.coalesce("source", "file_path") if "source" in current.columns else F.col("file_path")), "stored")

    counted = stores.vectors.join(cleared, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("vectors_deleted"))
    counted = counted.unionByName(stale.groupBy("doc_id").agg(F.count("*").alias("vectors_deleted")))
    vectors = stores.vectors.join(cleared, "doc_id", "left_anti").join(stale.select("chunk_id"), "chunk_id", "left_anti").select(stores.vectors.columns)
    vectors = settled(upsert(vectors, embed(chunks).withColumn("#pos", F.lit(0)), "chunk_id", "#pos"), "vectors")

    gone = stale.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("value")).unionByName(changes.where("cleared").select(F.lit("source").alias("kind"), F.col("file_path").alias("value")))
    entities, relations = without_entries(stores.entities, stores.relations, gone)
    place = chunks.select("chunk_id", "doc_id", "origin")
    said, told = (settled(rows.join(place, "chunk_id").withColumn("entry", provenance(F.col("origin"), F.col("chunk_id"))), "extracted") for rows in extract(chunks))
    versions = said.join(entities.select("name", F.col("version").alias("held_version")), "name", "left").withColumn("version", (F.coalesce("held_version", F.lit(0)) + F.row_number().over(Window.partitionBy("name").orderBy("pos"))).cast("int"))
    entities = settled(merge_into_graph(entities, versions.select("name", "type", "description", F.col("entry").alias("source"), "version", "pos"), now), "entities")
    relations = settled(merge_into_relations(relations, told.select("head", "relation", "tail", "confidence", "entry", "pos"), entities), "relations")
    snapshot = stores.snapshot.join(changes.select("doc_id"), "doc_id", "left_anti").unionByName(current.join(changes.where("change_type <> 'deleted'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "chunk_id", "content"))

    n = lambda *kinds: F.count_if(F.col("action").isin(*kinds))
    done = actions.groupBy("doc_id").agg(n("store", "replace").alias("stored"), n("keep").alias("kept"))
    per = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    out = changes.join(done, "doc_id", "left").join(counted, "doc_id", "left").join(per(said, "said"), "doc_id", "left").join(per(told, "told"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    fresh = (F.col("change_type") == "created") | F.col("cleared")
    counts = out.select("doc_id", "change_type", zero(F.col("stored")).alias("vectors_added"), zero(F.col("vectors_deleted")).alias("vectors_deleted"), zero(F.col("stored")).alias("chunks_reprocessed"), zero(F.col("kept")).alias("chunks_unchanged"), zero(F.when(fresh, F.col("said"))).alias("entities_added"), zero(F.when(~fresh, F.col("said"))).alias("entities_updated"), zero(F.col("told")).alias("relations_added"))
    return Stores(vectors, entities, relations, settled(snapshot, "snapshot")), settled(counts, "counts")
