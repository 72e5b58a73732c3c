"""Knowledge-graph upserts, deletes, neighbourhoods and shortest paths as joins and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key, relation_type
from ..sources.folders import settled, spent
from . import vector_index


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Mentions (name, type, description, source, version, pos): first type, last non-empty description, last version,
    sources in order."""
    said = F.when(F.coalesce("description", F.lit("")) != "", F.col("pos"))
    rows = mentions.where(F.coalesce("name", F.lit("")) != "")
    folded = rows.groupBy("name").agg(F.min_by("type", "pos").alias("type"), F.coalesce(F.max_by("description", said), F.lit("")).alias("description"), F.max_by("version", "pos").alias("version"))
    return folded.join(_sources(rows, "name"), "name")


def _sources(rows: DataFrame, *key: str) -> DataFrame:
    """Each key's distinct sources in order of first sight; reduced to a row a source before any list is made."""
    first = rows.groupBy(*key, "source").agg(F.min("pos").alias("pos"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("provenance"))


def merge_relations(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions (head, relation, tail, confidence, source, pos) between known entities: last confidence, sources in order."""
    names = entities.select("name")
    rows = mentions.join(names.withColumnRenamed("name", "head"), "head", "left_semi").join(names.withColumnRenamed("name", "tail"), "tail", "left_semi")
    rows = rows.withColumn("rel_type", relation_type(F.col("relation")))
    key = ("head", "rel_type", "tail")
    return rows.groupBy(*key).agg(F.max_by("confidence", "pos").alias("confidence")).join(_sources(rows, *key), list(key))


def without_provenance(entities: DataFrame, relations: DataFrame, gone) -> tuple[DataFrame, DataFrame]:
    """``gone``: predicate of a provenance entry. Empty relations go, then empty entities with all of their relations."""
    left = lambda df: df.withColumn("provenance", F.filter("provenance", lambda p: ~gone(p))).where(F.size("provenance") > 0)
    kept = left(entities)
    dead = entities.select("name").join(kept.select("name"), "name", "left_anti")
    edges = left(relations).join(dead.withColumnRenamed("name", "head"), "head", "left_anti").join(dead.withColumnRenamed("name", "tail"), "tail", "left_anti")
    return kept, edges


def doubled(relations: DataFrame) -> DataFrame:
    """(rel_id, a, rel, b): every relation from both of its ends."""
    one = relations.select(F.xxhash64("head", "rel_type", "tail").alias("rel_id"), F.col("head").alias("a"), F.col("rel_type").alias("rel"), F.col("tail").alias("b"))
    return one.unionByName(one.select("rel_id", F.col("b").alias("a"), "rel", F.col("a").alias("b")))


def neighbours(relations: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(start, hops, rels, target): trails of up to ``hops`` (at most 5) relations, none taken twice."""
    edges = doubled(relations)
    at = starts.select(F.col("name").alias("start"), F.col("name").alias("b"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("rels"))
    out = None
    for hop in range(1, min(max(hops, 1), 5) + 1):
        step = at.withColumnRenamed("b", "a").join(edges, "a").where(~F.array_contains("ids", F.col("rel_id")))
        at = step.select("start", "b", F.array_append("ids", F.col("rel_id")).alias("ids"), F.array_append("rels", F.col("rel")).alias("rels"))
        found = at.select("start", F.lit(hop).alias("hops"), F.array_join("rels", ", ").alias("rels"), F.col("b").alias("target"))
        out = found if out is None else out.unionByName(found)
    return out


def near_pairs(entities: DataFrame, reach: int = 2) -> DataFrame:
    """Pairs of a list (list_id, pos, name) at most ``reach`` places apart."""
    a = entities.select("list_id", F.col("name").alias("left"), F.col("pos").alias("p"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + reach)).alias("q"))
    return a.join(entities.select("list_id", F.col("pos").alias("q"), F.col("name").alias("right")), ["list_id", "q"]).select("list_id", "left", "right")


def resolve_names(mentions: DataFrame, key: Column) -> DataFrame:
    """Mentions (name, pos) with the first-seen name of their key as canonical; names of an empty or null key stand alone."""
    keyed = mentions.withColumn("key", key)
    first = keyed.where(F.col("key").cast("string") != "").groupBy("key").agg(F.min_by("name", "pos").alias("canonical"))
    out = keyed.join(first, "key", "left").withColumn("canonical", F.coalesce("canonical", "name"))
    return out.select("name", "pos", "canonical", (F.col("canonical") != F.col("name")).alias("merged"))


def search_entities(entities: DataFrame, keyword: str, most: int = 20) -> DataFrame:
    """(name, type, description) of entities whose name or description holds ``keyword`` (case-sensitive); ``most`` rows by
    name, the feature's limit."""
    return entities.where(F.col("name").contains(keyword) | F.col("description").contains(keyword)).select("name", "type", "description").orderBy("name").limit(most)


def keyword_neighbours(entities: DataFrame, relations: DataFrame, question: str, most: int = 20) -> DataFrame:
    """(content, source, score, retrieval_type): entities whose name or description holds the first 20 characters of a question,
    with their neighbours, or ``<nil>``; ``most`` rows by names and relation, the feature's limit. Scores are 0.8."""
    keyword = question[:20]
    found = entities.where(F.col("name").contains(keyword) | F.col("description").contains(keyword)).select("name", "type")
    edges = doubled(relations).select(F.col("a").alias("name"), "rel", F.col("b").alias("neighbour"))
    rows = found.join(edges, "name", "left").orderBy("name", "rel", "neighbour").limit(most)
    content = F.concat(F.col("name"), F.lit(" --["), F.coalesce("rel", F.lit("<nil>")), F.lit("]--> "), F.coalesce("neighbour", F.lit("<nil>")))
    return rows.select(content.alias("content"), F.lit("knowledge_graph").alias("source"), F.lit(0.8).alias("score"), F.lit("graph").alias("retrieval_type"))


def merge_into_graph(held: DataFrame, mentions: DataFrame, now: Column) -> DataFrame:
    """Entities (name, type, description, version, provenance, aliases, created_at, updated_at) with new mentions merged in:
    the held type stays, a new description that isn't empty and the last version win, provenance and aliases are added in
    order, and only touched entities get ``now``."""
    new = merge_entities(mentions).withColumnsRenamed({c: f"new_{c}" for c in ("type", "description", "version", "provenance")}).withColumn("hit", F.lit(True))
    both = held.join(new, "name", "full_outer")
    union = lambda a, b: F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    said = F.when(F.coalesce("new_description", F.lit("")) != "", F.col("new_description")).otherwise(F.coalesce("description", F.lit("")))
    own = F.when(F.col("hit"), F.array("name")).otherwise(F.array().cast("array<string>"))
    return both.select("name", F.coalesce("type", "new_type").alias("type"), said.alias("description"), F.coalesce("new_version", "version").alias("version"), union(F.col("provenance"), F.col("new_provenance")).alias("provenance"), union(F.col("aliases"), own).alias("aliases"), F.coalesce("created_at", now).alias("created_at"), F.when(F.col("hit"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def rewritten_relations(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Relations (head, relation, tail, pos) whose ends have the canonical names (name, pos, canonical) known by then."""
    known = resolved.groupBy("name").agg(F.min("pos").alias("since"), F.min_by("canonical", "pos").alias("canonical"))
    out = relations
    for end in ("head", "tail"):
        side = known.withColumnsRenamed({"name": end, "since": f"{end}_since", "canonical": f"{end}_name"})
        out = out.join(side, end, "left").withColumn(end, F.when(F.col(f"{end}_since") <= F.col("pos"), F.col(f"{end}_name")).otherwise(F.col(end))).drop(f"{end}_since", f"{end}_name")
    return out.select(relations.columns)


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(x, y, score), x before y, of rows (pos, vector) whose cosine, rounded to six places, is ``least`` or more; exact, by
    cells. Null vectors and those of length 0 are like nothing."""
    index = vector_index.build(vectors, key="pos", vector="vector")
    return vector_index.similar(index, vectors.sparkSession, least)


#: Names of the first run of ``resolve_similar``; each later one is as long as all before it.
FIRST = 4096


def resolve_similar(names: DataFrame, least: float = 0.85) -> DataFrame:
    """Names (name, pos, vector), in order of ``pos`` (distinct), with the canonical name each resolves to.

    A name is canonical unless an earlier canonical one is like it (cosine of ``least`` or more); else it takes the likest
    of those, the earliest of equals. Names are taken in runs by ``pos``, each as long as all before it: those that an earlier
    run's canonical name is like are aliases, and only the others of a run are held against each other. So likenesses
    between aliases are never rows, and there are as many runs as doublings."""
    keyed = settled(names.select("pos", "name", "vector"), "names")
    n, at = keyed.count(), F.col("pos").cast("double")
    shares, size = [], FIRST
    while size < n:
        shares, size = [*shares, size / n], 2 * size
    cuts = sorted(set(keyed.approxQuantile("pos", shares, 0.1 * FIRST / n))) if shares else []
    heads = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        run = keyed.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)).select("pos", "vector")
        if heads is not None:
            run = settled(run.join(vector_index.likest_before(run, heads, least).select(F.col("y").alias("pos")), "pos", "left_anti"), "unled")
        new = settled(first_of_each(run, least), "heads")
        heads = new if heads is None else heads.unionByName(new)
    others = keyed.select("pos", "vector").join(heads.select("pos"), "pos", "left_anti")
    best = vector_index.likest_before(others, heads, least)
    led = best.join(keyed.select(F.col("pos").alias("x"), F.col("name").alias("canonical")), "x").select(F.col("y").alias("pos"), "canonical")
    return keyed.join(led, "pos", "left").select("name", "pos", F.coalesce("canonical", "name").alias("canonical"))


def first_of_each(rows: DataFrame, least: float) -> DataFrame:
    """``rows`` (pos, vector) that no earlier one that stays is like. All rows without an open earlier neighbour are settled at once,
    round by round, so rounds are as many as the longest chain of likenesses."""
    open_ = settled(similar_pairs(rows, least), "likenesses")
    taken = None
    while not open_.isEmpty():
        firsts = open_.select(F.col("x").alias("pos")).distinct().join(open_.select(F.col("y").alias("pos")).distinct(), "pos", "left_anti")
        now = settled(open_.join(firsts, F.col("x") == F.col("pos")).select(F.col("y").alias("pos")).distinct(), "aliases")
        taken = now if taken is None else taken.unionByName(now)
        # a settled alias leads nobody; whoever follows it stays open by its other neighbours
        before, open_ = open_, settled(open_.join(now.select(F.col("pos").alias("x")), "x", "left_anti").join(now.select(F.col("pos").alias("y")), "y", "left_anti"), "likenesses")
        spent(before)
    return rows if taken is None else rows.join(taken, "pos", "left_anti")


def resolve_entities(mentions: DataFrame, least: float = 0.85) -> DataFrame:
    """Mentions (name, pos, vector; ``pos`` distinct) in order of ``pos``, with their canonical name and whether it is another.

    A name takes the canonical name of its key (case, white space and organisation endings aside) if the key was met before;
    else that of the likest canonical name so far, if their vectors' cosine is ``least`` or more; else it is canonical
    itself. As both rules work on the first name of each key, keys are folded first and likeness is settled among their
    first names. Names of an empty key stand alone and lead nobody; null vectors are like nothing."""
    keyed = mentions.select("name", "pos", "vector", entity_key(F.col("name")).alias("key"))
    first = keyed.where("key <> ''").groupBy("key").agg(F.min("pos").alias("pos"), F.min_by(F.struct("name", "vector"), "pos").alias("f"))
    first = settled(first.select("key", "pos", "f.name", "f.vector"), "keys")
    led = resolve_similar(first.select("name", "pos", "vector"), least).select("pos", "canonical")
    known = first.select("key", "pos").join(led, "pos").select("key", "canonical")
    out = keyed.select("name", "pos", "key").join(known, "key", "left").withColumn("canonical", F.coalesce("canonical", "name"))
    return out.select("name", "pos", "canonical", (F.col("canonical") != F.col("name")).alias("merged"))


def merged_pairs(resolved: DataFrame) -> DataFrame:
    """(merged_pairs, names): how many mentions took another name, and how many canonical names there are."""
    return resolved.agg(F.count_if("merged").alias("merged_pairs"), F.count_distinct("canonical").alias("names"))


def aliases_of(resolved: DataFrame) -> DataFrame:
    """(canonical, aliases): the other names that resolve to each canonical one, sorted; a row a name before any list is made."""
    others = resolved.where("merged").select("canonical", "name").distinct()
    return others.groupBy("canonical").agg(F.array_sort(F.collect_list("name")).alias("aliases"))
