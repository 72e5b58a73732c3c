"""Registered queries over the knowledge graph: trails, shortest paths, and what a graph says to questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, paths
from .registry import MENTIONS_SQL, graph_tables, query, table

#: Nations in regions, suppliers in nations, and suppliers that use one another; each relation with its provenance.
LINKS_SQL = f"""{MENTIONS_SQL},
rel AS (SELECT n_name AS head, 'PART_OF' AS rel_type, r_name AS tail, ['f' || n_regionkey] AS said FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, 'LOCATED_IN', n_name, ['g' || (s_suppkey % 3) || '::c' || s_suppkey] FROM h
UNION ALL SELECT a.s_name, 'USES', b.s_name, ['g::' || a.s_suppkey, 'u'] FROM supplier a JOIN supplier b ON b.s_suppkey = 3 * a.s_suppkey + 1),
w AS (SELECT head AS a, tail AS b, {{'rel_type': rel_type, 'b': tail, 'head': head, 'tail': tail}} AS step, said FROM rel
UNION ALL SELECT tail, head, {{'rel_type': rel_type, 'b': head, 'head': head, 'tail': tail}}, said FROM rel WHERE head <> tail),
known AS (SELECT map(list(name), list(provenance)) AS m FROM ol)"""
#: Provenance of nodes and steps, and citations of it.
SAID_SQL = "list_concat(flatten(list_transform(nodes, lambda n: coalesce(m[n], []))), flatten(said))"


def links(spark, sf_dir):
    """(entities, relations) of LINKS_SQL."""
    mentions, _ = graph_tables(spark, sf_dir)
    nation, region, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("head"), F.lit("PART_OF").alias("rel_type"), F.col("r_name").alias("tail"), F.array(F.concat(F.lit("f"), "n_regionkey")).alias("provenance"))
    b = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("head"), F.lit("LOCATED_IN").alias("rel_type"), F.col("n_name").alias("tail"), F.array(F.concat(F.lit("g"), F.col("s_suppkey") % 3, F.lit("::c"), "s_suppkey")).alias("provenance"))
    other = s.select((F.col("s_suppkey") - 1).alias("threefold"), F.col("s_name").alias("tail"))
    c = s.join(other, F.col("threefold") == 3 * F.col("s_suppkey")).select(F.col("s_name").alias("head"), F.lit("USES").alias("rel_type"), "tail", F.array(F.concat(F.lit("g::"), "s_suppkey"), F.lit("u")).alias("provenance"))
    return graph.merge_entities(mentions), a.unionByName(b).unionByName(c)


def around_sql(starts: str) -> str:
    """The first 50 trails of up to two relations around ``starts``: (start, rank, nodes, steps, said)."""
    return f"""one AS (SELECT a AS start, [a, b] AS nodes, [step] AS steps, [said] AS said FROM w WHERE a IN ({starts})),
two AS (SELECT * FROM one UNION ALL SELECT start, list_append(nodes, b), list_append(steps, step), list_append(one.said, w.said) FROM one JOIN w ON w.a = nodes[2]
WHERE NOT (w.step.head = steps[1].head AND w.step.tail = steps[1].tail AND w.step.rel_type = steps[1].rel_type)),
around AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(steps), steps) AS rank FROM two QUALIFY rank <= 50)"""


RELS_SQL = "array_to_string(list_transform(steps, lambda s: s.rel_type), ', ')"
TEXT_SQL = f"start || ' --[' || {RELS_SQL} || ']--> ' || nodes[-1] || ' (' || coalesce(type, '') || '): ' || coalesce(description, '')"


@query(f"WITH {LINKS_SQL}, {around_sql('SELECT n_name FROM nation')} SELECT start, rank, {RELS_SQL} AS relations, nodes[-1] AS target, {TEXT_SQL} AS content, {SAID_SQL} AS provenance FROM around LEFT JOIN e ON e.name = nodes[-1], known")
def graph_retrieve(spark, sf_dir):
    """Trails of up to two relations around each nation: 50 a start at most, as the feature states."""
    entities, relations = links(spark, sf_dir)
    found = paths.trails(relations, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    found = paths.with_provenance(found, entities, relations, ["start", "rank"]).withColumn("target", F.element_at("nodes", -1))
    named = found.join(entities.select(F.col("name").alias("target"), "type", "description"), "target", "left")
    text = paths.trail_text(F.col("start"), F.col("steps"), F.col("target"), F.coalesce("type", F.lit("")), F.coalesce("description", F.lit("")))
    return named.select("start", "rank", F.array_join(F.transform("steps", lambda s: s["rel_type"]), ", ").alias("relations"), "target", text.alias("content"), "provenance")


def ways_sql(pairs: str) -> str:
    """The first three shortest paths of up to five relations of ``pairs``: (start, goal, rank, nodes, steps, said)."""
    return f"""g AS ({pairs}),
p AS (SELECT DISTINCT start, start AS node, [start] AS nodes, []::STRUCT(rel_type VARCHAR, b VARCHAR, head VARCHAR, tail VARCHAR)[] AS steps, []::VARCHAR[][] AS said FROM g
UNION ALL SELECT p.start, w.b, list_append(nodes, w.b), list_append(steps, w.step), list_append(p.said, w.said) FROM p JOIN w ON p.node = w.a WHERE len(nodes) <= 5 AND NOT list_contains(nodes, w.b)),
met AS (SELECT g.start, g.goal, nodes, steps, said, min(len(steps)) OVER (PARTITION BY g.start, g.goal) AS least FROM p JOIN g ON p.start = g.start AND p.node = g.goal WHERE g.start <> g.goal),
ways AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY nodes, steps) AS rank FROM met WHERE len(steps) = least QUALIFY rank <= 3)"""


WAY_SQL = "'推理路径: ' || array_to_string(list_transform(nodes, lambda n, i: CASE WHEN i <= len(steps) THEN n || ' --[' || steps[i].rel_type || ']-->' ELSE n END), ' ')"


@query(f"""WITH RECURSIVE {LINKS_SQL}, {ways_sql('SELECT a.s_name AS start, b.s_name AS goal FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 7')}
SELECT start, goal, rank, len(steps)::INT AS hops, {WAY_SQL} AS content, {SAID_SQL} AS provenance FROM ways, known""")
def shortest_path(spark, sf_dir):
    """Up to three shortest paths of up to five relations between suppliers seven places apart."""
    entities, relations = links(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    pairs = s.select(F.col("s_name").alias("start"), (F.col("s_suppkey") + 7).alias("to")).join(s.select(F.col("s_suppkey").alias("to"), F.col("s_name").alias("goal")), "to").select("start", "goal")
    found = paths.with_provenance(paths.shortest(relations, pairs), entities, relations, ["start", "goal", "rank"])
    return found.select("start", "goal", "rank", F.size("steps").alias("hops"), paths.path_text(F.col("nodes"), F.transform("steps", lambda s: s["rel_type"])).alias("content"), "provenance")


@query(f"""WITH RECURSIVE {LINKS_SQL}, n AS (SELECT n_nationkey::BIGINT AS query_id, [n_name, r_name, 'nowhere', arg_min(s_name, s_suppkey)] AS es FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = (n_nationkey + 5) % 25 GROUP BY n_nationkey, n_name, r_name),
q AS (SELECT query_id, unnest(range(len(f))) AS place, unnest(f) AS name FROM (SELECT query_id, list_filter(es, lambda x: x IS NOT NULL) AS f FROM n)),
{around_sql('SELECT name FROM q')}, {ways_sql('SELECT DISTINCT a.name AS start, b.name AS goal FROM q a JOIN q b ON a.query_id = b.query_id AND b.place > a.place AND b.place <= a.place + 2')},
x AS (SELECT query_id, [0, place, 0, rank] AS o, {TEXT_SQL} AS content, 'neighbors' AS strategy, {SAID_SQL} AS provenance FROM q JOIN around ON start = q.name LEFT JOIN e ON e.name = nodes[-1], known
UNION ALL SELECT a.query_id, [1, a.place, b.place, rank], {WAY_SQL}, 'shortest_path', {SAID_SQL} FROM q a JOIN q b ON a.query_id = b.query_id AND b.place > a.place AND b.place <= a.place + 2 JOIN ways ON start = a.name AND goal = b.name, known),
c AS (SELECT *, list_transform(provenance, lambda v: CASE WHEN contains(v, '::') THEN regexp_replace(v, '::([^:]*)$', '|\\1') ELSE v || '|' END) AS cs FROM x),
d AS (SELECT *, list_filter(cs, lambda v, i: list_position(cs, v) = i) AS citations FROM c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS pos, content, CASE WHEN len(citations) > 0 THEN split_part(citations[1], '|', 1) ELSE 'knowledge_graph' END AS source, strategy, citations FROM d""")
def graph_contexts(spark, sf_dir):
    """A question for each nation: its name, its region's, an unknown one and a supplier's of another nation."""
    entities, relations = links(spark, sf_dir)
    nation, region, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    first = s.groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("s_name"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("to", (F.col("n_nationkey") + 5) % 25).join(first, F.col("to") == F.col("s_nationkey"), "left")
    asked = rows.select(F.col("n_nationkey").cast("long").alias("query_id"), F.array("n_name", F.lit(" "), F.concat(F.lit(" "), "r_name"), F.lit("nowhere"), "s_name").alias("entities"))
    found = paths.graph_contexts(entities, relations, asked)
    return found.select("query_id", "pos", "content", "source", "strategy", F.transform("citations", lambda c: F.concat_ws("|", c["source"], c["chunk_id"])).alias("citations"))


@query("SELECT n_name AS name, '推理路径: ' || n_name || ' --[PART_OF]--> ' || r_name AS content FROM nation JOIN region ON n_regionkey = r_regionkey")
def path_rows(spark, sf_dir):
    edges = links(spark, sf_dir)[1].where("rel_type = 'PART_OF'")
    return edges.select(F.col("head").alias("name"), paths.path_text(F.array("head", "tail"), F.array("rel_type")).alias("content"))


@query(f"""WITH {LINKS_SQL}, f AS (SELECT e.name, step.rel_type AS rel, b FROM e LEFT JOIN w ON w.a = e.name WHERE contains(name, 'home of Supplier#0000') OR contains(description, 'home of Supplier#0000') ORDER BY name, rel, b LIMIT 20)
SELECT name || ' --[' || coalesce(rel, '<nil>') || ']--> ' || coalesce(b, '<nil>') AS content, 'knowledge_graph' AS source, 0.8::DOUBLE AS score, 'graph' AS retrieval_type FROM f""")
def keyword_search(spark, sf_dir):
    """At most 20 rows for the first 20 characters, as the feature states; descriptions are searched too."""
    return graph.keyword_neighbours(*links(spark, sf_dir), "home of Supplier#0000")
