"""Vector search by cells and graph search by levels, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.operators import paths, retrieval
from graphquarry.operators import vector_index as vi

rng = random.Random(21)


def clustered(n, dims=12, groups=8, spread=0.1):
    g = np.random.default_rng(n)
    centres = g.normal(size=(groups, dims))
    return [(i, [float(x) for x in centres[i % groups] + spread * g.normal(size=dims)]) for i in range(n)]


def cosines(items):
    x = np.array([v for _, v in items], np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.round(u @ u.T, 6) + 0.0


@pytest.mark.parametrize("cells", [1, 7, None])
def test_nearest_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(vi, "PART", 60)  # several parts a cell
    items = clustered(300) + [(300 + i, [1.0] * 12) for i in range(90)] + [(400, [0.0] * 12), (401, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in items] + [(999, None, "x")], "vec_id long, embedding array<double>, cell string").repartition(3)
    index = vi.build(df, cells=cells)
    queries = df.where("vec_id % 13 = 0 OR vec_id = 400").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = sorted(map(tuple, vi.nearest(index, queries, 4).select("query_id", "rank", "vec_id", "score").collect()))
    s, ids = cosines(items), np.array([i for i, _ in items])
    want = []
    for q in (k for k, i in enumerate(ids) if i % 13 == 0 or i == 400):
        want += [(int(ids[q]), r + 1, int(ids[j]), float(s[q, j])) for r, j in enumerate(np.lexsort((ids, -s[q]))[:4])]
    assert got == sorted(want)
    for least in (0.5, 0.999):
        pairs = sorted(map(tuple, vi.similar(index, spark, least).collect()))
        fine = [k for k, (_, v) in enumerate(items) if any(v)]
        assert pairs == sorted((int(ids[a]), int(ids[b]), float(s[a, b])) for a in fine for b in fine if ids[a] < ids[b] and s[a, b] >= least)


def test_index_of_nothing_and_of_other_lengths(spark):
    df = spark.createDataFrame(clustered(20), "vec_id long, embedding array<float>")
    queries = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert retrieval.vector_topk(df.limit(0), queries, 3).count() == 0
    assert retrieval.vector_topk(df, queries.limit(0), 3).count() == 0
    assert retrieval.vector_topk(df, queries, 50).count() == 400
    with pytest.raises(ValueError, match="components"):
        vi.build(df.withColumn("embedding", F.when(F.col("vec_id") == 3, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))))


def test_only_scores_of_their_floor_are_sorted(monkeypatch):
    """What lies below the floors is neither rounded nor sorted."""
    g, sizes = np.random.default_rng(3), []
    raw, ids = np.round(g.uniform(-1, 1, (30, 200)), 2), g.permutation(200)
    floor = np.sort(np.round(raw, 6) + 0.0, 1)[:, -4]
    sort = np.lexsort
    want = [(i, int(j), raw[i, j]) for i in range(30) for j in [j for j in sort((ids, -raw[i])) if raw[i, j] >= floor[i]][:3]]
    monkeypatch.setattr(vi.np, "lexsort", lambda keys: (sizes.append(len(keys[-1])), sort(keys))[1])
    a, b, s = vi.at_least(raw, floor, ids, 3)
    assert list(zip(a.tolist(), b.tolist(), s.tolist())) == want and sum(sizes) < 30 * 20


def test_names_as_ids(spark):
    items = clustered(60)
    df = spark.createDataFrame([(f"k{i:03d}", v) for i, v in items], "vec_id string, embedding array<double>")
    queries = df.where("vec_id < 'k005'").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    s = cosines(items)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.vector_topk(df, queries, 3).collect()}
    assert got == {(f"k{q:03d}", r + 1): f"k{j:03d}" for q in range(5) for r, j in enumerate(np.lexsort((np.arange(60), -s[q]))[:3])}


def test_cells_are_passed_over(spark):
    """Where vectors lie in groups, what is visited grows far slower than the square."""
    visited = {}
    for n in (400, 1600):
        df = spark.createDataFrame(clustered(n, groups=n // 20, spread=0.02), "vec_id long, embedding array<double>")
        index = vi.build(df, cells=n // 20)
        asked = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(0.98).alias("floor"))
        rows = asked.mapInArrow(vi.visiting(index, True, 1), "cell int, part int, angle double, id long, data binary, floor double").groupBy("cell").count()
        sizes = {c[0]: c[4] for c in index.cells}
        visited[n] = sum(r["count"] * sizes[r["cell"]] for r in rows.collect())
    assert visited[1600] < 8 * max(visited[400], 400) and visited[1600] < 0.05 * 1600**2


# ---- graphs ----------------------------------------------------------------------------------------------------------


def graph_of(n, m):
    names = [f"n{i}" for i in range(n)]
    rel = {(rng.choice(names[:3]) if rng.random() < 0.4 else rng.choice(names), rng.choice(["USES", "PART_OF"]), rng.choice(names)) for _ in range(m)}
    return names, sorted(rel)


def steps_from(rel, node):
    out = []
    for h, t, g in rel:
        if h == node:
            out.append((t, g, h, g))
        if g == node and h != g:
            out.append((t, h, h, g))
    return sorted(out)


def all_trails(rel, start, hops):
    front, out = [[]], []
    for _ in range(hops):
        front = [s + [x] for s in front for x in steps_from(rel, s[-1][1] if s else start) if (x[0], x[2], x[3]) not in {(y[0], y[2], y[3]) for y in s}]
        out += front
    return sorted(out, key=lambda s: (len(s), s))


@pytest.mark.parametrize("hops,most,hub", [(2, 50, 100_000), (2, 3, 2), (3, 4, 2), (1, 2, 3)])
def test_trails(spark, hops, most, hub):
    names, rel = graph_of(9, 26)
    relations = spark.createDataFrame([*rel, rel[0], (None, "USES", "n1")], "head string, rel_type string, tail string")
    starts = spark.createDataFrame([(n,) for n in [*names, "n0", "nowhere", None]], "name string")
    got = {}
    for r in paths.trails(relations, starts, hops, most, hub).orderBy("rank").collect():
        got.setdefault(r["start"], []).append([tuple(s) for s in r["steps"]])
        assert r["nodes"] == [r["start"], *(s["b"] for s in r["steps"])]
    want = {n: all_trails(rel, n, hops)[:most] for n in names}
    assert got == {n: t for n, t in want.items() if t}


@pytest.mark.parametrize("hub", [100_000, 2])
def test_shortest(spark, hub):
    chain = [(f"c{i}", "USES", f"c{i + 1}") for i in range(7)] + [("c1", "PART_OF", "c2"), ("c3", "USES", "c2"), ("c0", "USES", "x"), ("x", "USES", "c2")]
    names, rel = graph_of(14, 20)
    rel = sorted({*rel, *chain})
    every = [(a, b) for a in names[:8] for b in names[:8]] + [("c0", f"c{i}") for i in range(8)] + [("c5", "c0"), ("n0", "c0"), ("n0", "nowhere"), (None, "n1"), ("c0", "c3")]
    relations = spark.createDataFrame(rel, "head string, rel_type string, tail string")
    got = {}
    for r in paths.shortest(relations, spark.createDataFrame(every, "start string, goal string"), hub=hub).orderBy("rank").collect():
        got.setdefault((r["start"], r["goal"]), []).append((r["nodes"], [tuple(s) for s in r["steps"]]))
    want = {}
    for a, b in set(every):
        if a and b and a != b:
            front, seen = [([a], [])], {a}
            for _ in range(5):
                front = [(n + [x[1]], s + [x]) for n, s in front for x in steps_from(rel, n[-1]) if x[1] not in seen]
                hit = sorted(p for p in front if p[0][-1] == b)
                seen |= {n[-1] for n, _ in front}
                if hit:
                    want[a, b] = hit[:3]
                    break
    assert got == want
    assert {len(p[0][1]) for p in want.values()} >= {1, 2, 3, 4, 5} and max(map(len, want.values())) == 3


def test_paths_through_hubs_are_shared(spark, monkeypatch):
    """Pairs whose paths lead over the same two hubs aren't searched one by one: nothing that is written has a row a pair and leaf."""
    sizes, n = [], 120
    kept = paths.settled
    monkeypatch.setattr(paths, "settled", lambda df, name: (sizes.append((out := kept(df, name)).count()), out)[1])
    rel = [(f"s{i:03d}", "PART_OF", f"h{i % 2}") for i in range(n)] + [("s000", "USES", "s001")]
    pairs = [(f"s{i:03d}", f"s{(i + 3) % n:03d}") for i in range(n)]
    relations = spark.createDataFrame(rel, "head string, rel_type string, tail string")
    found = paths.shortest(relations, spark.createDataFrame(pairs, "start string, goal string")).collect()
    assert {(r["start"], r["goal"]) for r in found} == set(pairs)
    assert {tuple(r["nodes"]) for r in found if r["start"] == "s002"} == {("s002", "h0", "s000", "s001", "h1", "s005")}
    assert max(sizes) <= 5 * n


def test_contexts_of_a_graph(spark):
    entities = spark.createDataFrame([("a", "T", "first", ["s::1", "t"]), ("b", None, None, ["::x", ""]), ("c", "U", "", None)], "name string, type string, description string, provenance array<string>")
    relations = spark.createDataFrame([("a", "USES", "b", ["s::1", "d::e::2"]), ("b", "PART_OF", "c", None)], "head string, rel_type string, tail string, provenance array<string>")
    questions = spark.createDataFrame([(1, [" a ", "", "c"]), (2, ["nowhere"]), (3, None)], "query_id int, entities array<string>")
    got = paths.graph_contexts(entities, relations, questions).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["pos"], r["content"]) for r in got] == [
        (1, 1, "a --[USES]--> b (): "), (1, 2, "a --[USES, PART_OF]--> c (U): "), (1, 3, "c --[PART_OF]--> b (): "), (1, 4, "c --[PART_OF, USES]--> a (T): first"), (1, 5, "推理路径: a --[USES]--> b --[PART_OF]--> c"),
    ]
    assert [[(c["source"], c["chunk_id"]) for c in r["citations"]] for r in got][0] == [("s", "1"), ("t", ""), ("", "x"), ("d::e", "2")]
    assert [r["source"] for r in got] == ["s", "s", "", "", "s"]


def test_queries_are_sent_once_to_a_region(spark, monkeypatch):
    """Of vectors that point alike in all directions, every cell is open: a query is sent to each region, not to each cell."""
    g = np.random.default_rng(7)
    items = [(i, [float(x) for x in g.normal(size=24)]) for i in range(900)]
    monkeypatch.setattr(vi, "REGION", 200)
    df = spark.createDataFrame(items, "vec_id long, embedding array<double>")
    index = vi.build(df, cells=30)
    regions = vi.regions_of(index, 4)
    assert sorted({r for _, _, r in regions}) == [0, 1, 2, 3] and sorted((c, p) for c, p, _ in regions) == sorted((c[0], p) for c in index.cells for p in range(c[1]))
    asked = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(-2.0).alias("floor"))
    sent = asked.mapInArrow(vi.visiting(index, True, 3, regions), "cell int, part int, angle double, id long, data binary, floor double")
    assert sent.count() == 4 * 900 == sent.select("cell", "id").distinct().count()
    s = cosines(items)
    queries = df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vi.nearest(index, queries, 3).collect()}
    assert got == {(q, r + 1): (int(j), float(s[q, j])) for q in range(0, 900, 9) for r, j in enumerate(np.lexsort((np.arange(900), -s[q]))[:3])}
