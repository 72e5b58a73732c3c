"""Search of a knowledge graph: trails around many starts, shortest paths between many pairs, and contexts made of both.

Relations are (head, rel_type, tail) and may have provenance; they are taken in both directions. Every hop is a join with the
edges, and only what the limits can still list is carried on: the first rows of each start by a total order, which ends
in the relation itself. Edges of nodes with more than ``HUB`` relations are dealt over parts, and frontiers copied to
them. Frontiers are written between hops, so that no plan holds more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rpartition
from ..sources.folders import settled, spent
from .retrieval import clean_terms

HUB = 100_000
#: Limits of the feature: hops of any search, relations around and trails listed, paths listed, entities of a question.
MOST_HOPS, AROUND, TRAILS, PATHS, ENTITIES = 5, 2, 50, 3, 5


def first(df: DataFrame, by: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


class Edges:
    """Relations from both of their ends, written once: (a, b, step, part), where step is (rel_type, b, head, tail)."""

    def __init__(self, relations: DataFrame, hub: int = HUB):
        one = relations.select("head", "rel_type", "tail").where("head IS NOT NULL AND tail IS NOT NULL").distinct()
        out = one.select(F.col("head").alias("a"), F.col("tail").alias("b"), "*").unionByName(one.where("head <> tail").select(F.col("tail").alias("a"), F.col("head").alias("b"), "*"))
        edges = settled(out.select("a", "b", F.struct("rel_type", "b", "head", "tail").alias("step")), "edges")
        self.degrees = edges.groupBy("a").agg(F.count("*").alias("degree"))
        self.hubs = settled(self.degrees.where(F.col("degree") > hub).select(F.col("a").alias("hub"), F.ceil(F.col("degree") / hub).cast("int").alias("parts")), "hubs")
        dealt = edges.join(self.hubs, F.col("a") == F.col("hub"), "left")
        self.all = dealt.select("a", "b", "step", F.pmod(F.xxhash64("b", "step"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))

    def after(self, front: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """``front`` (node, ...) joined with the edges of its nodes."""
        spread = front.join(self.hubs, F.col("node") == F.col("hub"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hub", "parts")
        return spread.join(edges or self.all, (F.col("node") == F.col("a")) & (spread["part"] == (edges or self.all)["part"])).drop("part", "a")


def trails(relations: DataFrame | Edges, starts: DataFrame, hops: int = AROUND, most: int = TRAILS, hub: int = HUB) -> DataFrame:
    """(start, rank, nodes, steps): the first ``most`` trails of up to ``hops`` (1 to 5) relations, none taken twice, from each
    distinct name of ``starts``. Shorter ones first, then step by step by type, node, head and tail.

    A trail is carried on only if it is among the first ``most`` that have a further relation; for the last hop a node's
    first ``most + hops`` edges are enough. So neither a hub nor the number of trails multiplies."""
    edges, hops = relations if isinstance(relations, Edges) else Edges(relations, hub), min(max(hops, 1), MOST_HOPS)
    few = first(edges.all, ["a"], ["step"], most + hops).drop("rank")
    front = starts.select(F.col("name").alias("start"), F.col("name").alias("node"), F.array().cast(f"array<{edges.all.schema['step'].dataType.simpleString()}>").alias("steps")).where("start IS NOT NULL").distinct()
    out = None
    for hop in range(1, hops + 1):
        met = edges.after(front, few if hop == hops else None).where(~F.array_contains("steps", F.col("step")) & ~F.exists("steps", lambda s: (s["head"] == F.col("step")["head"]) & (s["tail"] == F.col("step")["tail"]) & (s["rel_type"] == F.col("step")["rel_type"])))
        step = met.select("start", F.col("b").alias("node"), F.array_append("steps", F.col("step")).alias("steps"))
        if hop < hops:
            used = F.size(F.filter("steps", lambda s: (s["head"] == F.col("node")) | (s["tail"] == F.col("node"))))
            goes_on = F.coalesce(F.col("degree"), F.lit(0)) > used
            both = step.join(edges.degrees.withColumnRenamed("a", "node"), "node", "left").withColumn("goes_on", goes_on)
            kept = settled(first(both, ["start", "goes_on"], ["steps"], most).select("start", "node", "steps", "goes_on"), "trails")
            step, front = kept, kept.where("goes_on").drop("goes_on")
        now = step.select("start", "steps")
        out = now if out is None else out.unionByName(now)
    nodes = F.concat(F.array("start"), F.transform("steps", lambda s: s["b"]))
    return first(out, ["start"], [F.size("steps"), "steps"], most).select("start", "rank", nodes.alias("nodes"), "steps")


def shortest(relations: DataFrame | Edges, pairs: DataFrame, hops: int = MOST_HOPS, most: int = PATHS, hub: int = HUB) -> DataFrame:
    """(start, goal, rank, nodes, steps): the first ``most`` shortest paths of at most ``hops`` relations of each distinct pair
    (start, goal) of different names, by nodes and then by relations.

    A pair that isn't adjacent is opened at its end of fewer relations into the pairs that its path can go on with, and equal
    ones of all pairs are one: what many pairs pass is searched once, and their number grows with the nodes, not with the
    pairs times the relations of a hub. A pair leaves as soon as it has met, and takes along what no other open pair needs.
    Paths are then put together from the last pairs to the first; each pair keeps its first ``most``, which are all
    that the first paths around it can be made of."""
    edges, hops = relations if isinstance(relations, Edges) else Edges(relations, hub), min(max(hops, 1), MOST_HOPS)
    ends = ["x", "y"]
    first_pairs = settled(pairs.select(F.col("start").alias("x"), F.col("goal").alias("y")).where("x <> y").distinct(), "pairs")
    open_, levels, links, met, done, written = first_pairs, [first_pairs], [], [], [], [first_pairs]

    def kept(df: DataFrame, name: str) -> DataFrame:
        written.append(settled(df, name))
        return written[-1]

    for length in range(1, hops + 1):
        direct = open_.join(edges.all.select(F.col("a").alias("x"), F.col("b").alias("y"), "step"), ends)
        met.append(kept(first(direct, ends, ["step"], most).select(*ends, F.array(*ends).alias("nodes"), F.array("step").alias("steps")), "met"))
        done.append([met[-1].select(*ends).distinct()])
        if length == hops:
            break
        if not met[-1].isEmpty():
            for at in range(length - 2, -1, -1):
                led = links[at].join(done[at + 1][-1], ends, "left_semi").select(F.col("from_x").alias("x"), F.col("from_y").alias("y")).distinct()
                done[at].append(kept(led, "done"))
            open_ = first_pairs
            for at in range(length):
                for closed in done[at]:
                    open_ = open_.join(closed, ends, "left_anti")
                if at < length - 1:
                    open_ = links[at].join(open_.select(F.col("x").alias("from_x"), F.col("y").alias("from_y")), ["from_x", "from_y"], "left_semi").select(*ends).distinct()
            open_ = kept(open_, "open")
        of = lambda end: edges.degrees.select(F.col("a").alias(end), F.col("degree").alias(f"degree_{end}"))
        sides = open_.join(of("x"), "x").join(of("y"), "y").withColumn("left", F.col("degree_x") <= F.col("degree_y"))
        front = sides.select(F.col("x").alias("from_x"), F.col("y").alias("from_y"), "left", F.when(F.col("left"), F.col("x")).otherwise(F.col("y")).alias("node"))
        # a step is kept as it is taken from start to goal: its b is where it leads to
        back = F.struct(F.col("step")["rel_type"].alias("rel_type"), F.col("node").alias("b"), F.col("step")["head"].alias("head"), F.col("step")["tail"].alias("tail"))
        x, y = F.when(F.col("left"), F.col("b")).otherwise(F.col("from_x")), F.when(F.col("left"), F.col("from_y")).otherwise(F.col("b"))
        links.append(kept(edges.after(front).select("from_x", "from_y", "left", F.when(F.col("left"), F.col("step")).otherwise(back).alias("step"), x.alias("x"), y.alias("y")).where("x <> y"), "links"))
        open_ = kept(links[-1].select(*ends).distinct(), "open")
        if open_.isEmpty():
            break
    found = met[-1]
    for at in range(len(met) - 2, -1, -1):
        longer = links[at].join(found, ends)
        nodes = F.when(F.col("left"), F.array_prepend("nodes", F.col("from_x"))).otherwise(F.array_append("nodes", F.col("from_y")))
        steps = F.when(F.col("left"), F.array_prepend("steps", F.col("step"))).otherwise(F.array_append("steps", F.col("step")))
        longer = longer.select(F.col("from_x").alias("x"), F.col("from_y").alias("y"), nodes.alias("nodes"), steps.alias("steps"))
        every = met[at].unionByName(longer)
        least = F.min(F.size("steps")).over(Window.partitionBy(*ends))
        best = first(every, ends, [F.size("steps"), "nodes", "steps"], most).withColumn("least", least)
        found = kept(best.where(F.size("steps") == F.col("least")).select(*ends, "nodes", "steps"), "ways")
    out = settled(first(found, ends, ["nodes", "steps"], most).select(F.col("x").alias("start"), F.col("y").alias("goal"), "rank", "nodes", "steps"), "paths")
    spent(*written)
    return out


def with_provenance(found: DataFrame, entities: DataFrame, relations: DataFrame, key: list[str]) -> DataFrame:
    """``found`` (``key``, nodes, steps) with the provenance of its nodes in order, then that of its relations; an unknown or
    null one adds nothing. Lists are as long as trails are, so what is gathered is small."""
    nodes = found.select(*key, F.posexplode("nodes").alias("at", "name")).join(entities.select("name", "provenance"), "name").select(*key, F.struct(F.lit(0).alias("kind"), "at", "provenance").alias("said"))
    steps = found.select(*key, F.posexplode("steps").alias("at", "s")).select(*key, "at", *(F.col("s")[c].alias(c) for c in ("head", "rel_type", "tail")))
    held = relations.groupBy("head", "rel_type", "tail").agg(F.first("provenance", ignorenulls=True).alias("provenance"))
    steps = steps.join(held, ["head", "rel_type", "tail"]).select(*key, F.struct(F.lit(1).alias("kind"), "at", "provenance").alias("said"))
    every = nodes.unionByName(steps).where("said.provenance IS NOT NULL").groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("said")), lambda s: s["provenance"])).alias("provenance"))
    return found.join(every, key, "left").withColumn("provenance", F.coalesce("provenance", F.array().cast("array<string>")))


def cited(provenance: Column) -> Column:
    """Distinct citations (source, chunk_id, page, heading_path), in order, of provenance entries ``source::chunk``; empty ones go."""
    split = F.transform(F.filter(provenance, lambda p: p.isNotNull()), lambda p: rpartition(p, "::"))
    some = F.filter(split, lambda c: (c["head"] != "") | (c["tail"] != ""))
    return F.array_distinct(F.transform(some, lambda c: F.struct(c["head"].alias("source"), c["tail"].alias("chunk_id"), F.lit(0).alias("page"), F.lit("").alias("heading_path"))))


def trail_text(start: Column, steps: Column, target: Column, kind: Column, said: Column) -> Column:
    """``start --[r1, r2]--> target (type): description``."""
    return F.concat(start, F.lit(" --["), F.array_join(F.transform(steps, lambda s: s["rel_type"]), ", "), F.lit("]--> "), target, F.lit(" ("), kind, F.lit("): "), said)


def path_text(nodes: Column, rels: Column) -> Column:
    """``推理路径: a --[r]--> b …`` of a path's nodes and the relations between them."""
    steps = F.transform(nodes, lambda n, i: F.when(i < F.size(rels), F.concat(n, F.lit(" --["), F.element_at(rels, (i + 1).cast("int")), F.lit("]-->"))).otherwise(n))
    return F.concat(F.lit("推理路径: "), F.array_join(steps, " "))


def graph_contexts(entities: DataFrame, relations: DataFrame, questions: DataFrame, hub: int = HUB) -> DataFrame:
    """What a graph says to questions (query_id, entities): (query_id, pos, content, source, score, retrieval_type, strategy,
    citations), positions from 1.

    The first five entities that aren't blank count. Around each, in order, its first 50 trails of up to two relations;
    then up to three shortest paths of each entity to the next two. The source is that of the first citation. ``entities``
    has name, type, description and provenance, ``relations`` head, rel_type, tail and provenance. Unknown entities
    add nothing, and an entity that is named twice is searched once but listed twice."""
    asked, found = graph_lists(entities, relations, questions, hub)
    return asked.join(found, "list").drop("list")


def graph_lists(entities: DataFrame, relations: DataFrame, questions: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """``graph_contexts`` as (query_id, list) and the contexts of each list, as questions that name the same entities share them."""
    terms = clean_terms(F.col("entities"), ENTITIES)
    asked = settled(questions.select("query_id", F.to_json(terms).alias("list"), terms.alias("terms")).where(F.size("terms") > 0), "asked")
    questions = asked.select(F.col("list").alias("query_id"), F.col("terms").alias("entities")).distinct()
    named = settled(questions.select("query_id", F.posexplode("entities").alias("place", "name")), "named")
    edges = Edges(relations, hub)
    around = settled(trails(edges, named.select("name").distinct()), "around")
    around = with_provenance(around, entities, relations, ["start", "rank"])
    last = F.element_at("nodes", -1)
    kinds = entities.select(F.col("name").alias("target"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("said"))
    texts = around.withColumn("target", last).join(kinds, "target", "left").select("start", "rank", trail_text(F.col("start"), F.col("steps"), F.col("target"), F.coalesce("type", F.lit("")), F.coalesce("said", F.lit(""))).alias("content"), "provenance")
    order = F.struct(F.lit(0).alias("kind"), F.col("place").alias("i"), F.lit(0).alias("j"), "rank")
    near = named.join(texts, named["name"] == texts["start"]).select("query_id", order.alias("order"), "content", F.lit("neighbors").alias("strategy"), "provenance")
    a, b = named.select("query_id", F.col("place").alias("i"), F.col("name").alias("start")), named.select("query_id", F.col("place").alias("j"), F.col("name").alias("goal"))
    pairs = settled(a.join(b, "query_id").where("j > i AND j <= i + 2"), "pairs")  # five names a question at most
    linked = with_provenance(settled(shortest(edges, pairs), "linked"), entities, relations, ["start", "goal", "rank"])
    rels = F.transform("steps", lambda s: s["rel_type"])
    order = F.struct(F.lit(1).alias("kind"), "i", "j", "rank")
    ways = pairs.join(linked, ["start", "goal"]).select("query_id", order.alias("order"), path_text(F.col("nodes"), rels).alias("content"), F.lit("shortest_path").alias("strategy"), "provenance")
    rows = near.unionByName(ways).withColumn("citations", cited(F.col("provenance")))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("order"))
    source = F.coalesce(F.get("citations", F.lit(0))["source"], F.lit("knowledge_graph"))
    return asked.drop("terms"), rows.select(F.col("query_id").alias("list"), pos.alias("pos"), "content", source.alias("source"), F.lit(1.0).alias("score"), F.lit("graph").alias("retrieval_type"), "strategy", "citations")
