"""Guards, registry, payloads, previews, prototype ranking and names resolved by vectors, on small frames."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphquarry.functions import guards
from graphquarry.functions import text as tx
from graphquarry.operators import graph, registry, retrieval


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_read_only_statements(spark):
    every = ["match (a) return a;", "MATCH (a) RETURN a; RETURN 1", " ", None, ";", "MATCH (a) Detach DELETE a", "UNWIND [1] AS offset RETURN offset", "SHOW x", "RETURNS 1", "LOAD\n CSV"]
    df = spark.createDataFrame(list(enumerate(every)), "i int, q string")
    got = rows(df.select("i", guards.read_only_state(F.col("q")), guards.read_only_text(F.col("q"))), "i")
    assert [r[1] for r in got] == ["accepted", "not_single", "not_single", "not_single", "not_a_query", "writes", "accepted", "not_a_query", "not_a_query", "writes"]
    assert [r[2] for r in got if r[2]] == ["match (a) return a", "UNWIND [1] AS offset RETURN offset"]
    words = [w.replace(r"\s+", " ") for w in guards.WRITING]
    df = spark.createDataFrame([(f"RETURN 'x {w.lower()} y'",) for w in words], "q string")
    assert {r[0] for r in df.select(guards.read_only_state(F.col("q"))).collect()} == {"writes"}


def test_read_only_sql(spark):
    assert guards.read_only_sql(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x WHERE a IN (SELECT 1)").collect()[0][0] == 1
    spark.range(1).createOrReplaceTempView("guarded")
    for bad in ("DROP VIEW guarded", "INSERT INTO guarded SELECT 2", "CREATE TABLE t AS SELECT 1", "SET a = 1"):
        with pytest.raises(ValueError):
            guards.read_only_sql(spark, bad)
    assert spark.table("guarded").count() == 1


def test_managed_path(tmp_path):
    root = tmp_path / "up"
    root.mkdir()
    (root / "out").symlink_to(tmp_path)
    assert guards.managed_path("a/../b.txt", str(root)) == str(root / "b.txt")
    for bad in ("../x", str(tmp_path / "up2" / "x"), "out/x"):
        with pytest.raises(ValueError):
            guards.managed_path(bad, str(root))


def test_registry(spark):
    held = spark.createDataFrame([("a", "h", 1), ("b", "h", 3), ("c", None, None), ("d", "g", 3)], "file_id string, sha string, created_at long")
    assert [r["file_id"] for r in registry.newest_first(held).collect()] == ["b", "d", "a", "c"]
    assert rows(registry.find(held, sha="h", created_at=3), "file_id") == [("b", "h", 3)]
    assert registry.find(held, sha=None).count() == 0
    gone = spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "file_id string")
    assert [r[0] for r in rows(registry.remove(held, gone), "file_id")] == ["a", "c", "d"]
    assert registry.remove(held.limit(0), gone).count() == 0


def test_uploads(spark):
    files = spark.createDataFrame([("x/a.TXT", b"abc"), ("b.txt", b"abcd"), ("c", b""), ("d.csv", None), (None, b"x"), ("dir/.txt", b"x")], "path string, content binary")
    got = {r["path"]: r for r in registry.take_uploads(files, 3).collect()}
    assert {p: r["outcome"] for p, r in got.items()} == {"x/a.TXT": "accepted", "b.txt": "too_large", "c": "unsupported", "d.csv": "accepted", None: "unsupported", "dir/.txt": "unsupported"}
    assert got["x/a.TXT"]["original_name"] == "a.TXT" and got["x/a.TXT"]["stored_name"].endswith(".txt") and len(got["x/a.TXT"]["stored_name"]) == 36
    assert got["b.txt"]["sha256"] is None and got["b.txt"]["stored_name"] is None and got["d.csv"]["size"] == 0


def test_committed(spark):
    ingests = spark.createDataFrame([("a", True, True, True), ("b", None, True, True), ("c", False, True, True), ("d", True, True, False), ("e", True, None, True)], "path string, approved boolean, vectors_stored boolean, graph_stored boolean")
    chunks = spark.createDataFrame([(s, s + "0") for s in "abcdef"], "source string, chunk_id string")
    assert [r[0] for r in rows(registry.committed(chunks, ingests), "source")] == ["a", "b"]


def test_contexts(spark):
    chunks = spark.createDataFrame([("c0", "d", None, None)], "chunk_id string, doc_id string, source string, page int").withColumns({"doc_type": F.lit("text"), "chunk_index": F.lit(0), "page2": F.lit(1)})
    assert tuple(retrieval.payloads(chunks).first()) == ("c0", "d", "text", 0, "", "", False, False, 0)
    contexts = spark.createDataFrame([(1, r, "x" * 300 if r == 2 else None if r == 3 else f"t{r}") for r in range(2, 9)], "query_id int, rank int, content string")
    assert retrieval.previews(contexts).first()["preview"] == "[1] " + "x" * 200 + "\n\n[2] \n\n[3] t4\n\n[4] t5\n\n[5] t6"
    assert retrieval.previews(contexts, 3, numbered=False).first()["preview"] == "xxx\n\nt4\nt5\nt6"
    lists = spark.createDataFrame([(1, "vector", 1, 0.6), (1, "vector", 2, 0.6), (1, "graph", 1, 0.5), (1, "graph", 2, 1.5)], "query_id int, kind string, pos int, score double")
    best = retrieval.weighted_lists(lists, 3)
    assert [(r[1], r[2]) for r in rows(best.select("rank", "kind", "pos"), "rank")] == [("graph", 2), ("vector", 1), ("vector", 2)]
    assert retrieval.mean_confidence(best).first()[1] == 1.0 and retrieval.mean_confidence(best.withColumn("score", F.lit(2.0)), clamped=False).first()[1] == 2.0
    found = retrieval.results(spark.createDataFrame([(1,), (2,)], "query_id int"), best, F.size("contexts").cast("string"))
    assert [(r["answer"], len(r["contexts"]), r["confidence"]) for r in found.orderBy("query_id").collect()] == [("3", 3, round((1.0 + 0.6 + 0.6) / 3, 4)), ("0", 0, 0.0)]


def greedy(items, least):
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1.0), 6)
    heads, out = [], {}
    for pos, v in items:
        like = [(cos(v, w), -p) for p, w in heads if v and any(v)]
        like = [x for x in like if x[0] >= least]
        out[pos] = -max(like)[1] if like else pos
        if not like and v and any(v):
            heads.append((pos, v))
    return out


def test_similar_names(spark):
    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    items = [(i, [x + rng.gauss(0, 0.45) for x in rng.choice(centers)]) for i in range(120)] + [(120, None), (121, [0.0] * 5), (122, [0.0] * 5)]
    items.append((123, items[7][1]))
    df = spark.createDataFrame([(f"n{p}", p, v) for p, v in items], "name string, pos long, vector array<double>")
    for least in (0.6, 0.85):
        want = greedy(items, least)
        got = {r["pos"]: int(r["canonical"][1:]) for r in graph.resolve_similar(df, least).collect()}
        assert got == want
        assert len(set(want.values())) < len(items)
    assert graph.resolve_similar(df.limit(0)).count() == 0


def test_likenesses_of_aliases_are_no_rows(spark, monkeypatch):
    """Names in several runs: as one by one, and far fewer likenesses are written than there are."""
    written, kept = [], graph.settled
    monkeypatch.setattr(graph, "FIRST", 40, raising=False)
    monkeypatch.setattr(graph, "settled", lambda df, name: (out := kept(df, name), written.append(out.count()) if name == "likenesses" else None)[0])
    rng = random.Random(9)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    items = [(3 * i - 200, [x + rng.gauss(0, 0.3) for x in rng.choice(centers)]) for i in range(400)] + [(2000, None), (2001, [0.0] * 6)]
    df = spark.createDataFrame([(f"n{p}", p, v) for p, v in items], "name string, pos long, vector array<double>").repartition(3)
    want = greedy(items, 0.8)
    assert {r["pos"]: int(r["canonical"][1:]) for r in graph.resolve_similar(df, 0.8).collect()} == want
    assert sum(written) < 2000  # of some 7,000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8_000_000  # whole blocks are rows


def one_by_one(items, least):
    """Keys and likeness in one order of arrival, a name at a time; names of an empty key stand alone."""
    ends = re.compile(r"(集团|公司|Inc\.?|Co\.?)\s*$", re.I)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1.0), 6)
    by_key, heads, out = {}, {}, []
    for pos, name, v in items:
        key = ends.sub("", re.sub(r"\s+", "", name).lower())
        if not key:
            out.append((pos, name))
            continue
        if key not in by_key:
            like = [(cos(v, w), -p, n) for n, (p, w) in heads.items() if v and w]
            like = [x for x in like if x[0] >= least]
            by_key[key] = max(like)[2] if like else name
            if not like:
                heads[name] = (pos, v)
        out.append((pos, by_key[key]))
    return out


def test_one_resolver(spark):
    rng = random.Random(8)
    centers = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    names = [f"N{rng.randrange(60)}{rng.choice(['', ' Inc.', '公司', ' CO', '集团'])}" for _ in range(150)] + ["集团", "Co.", " Inc", "集团", "  ", ""]
    items = [(i, n, [x + rng.gauss(0, 0.4) for x in rng.choice(centers)] if i % 11 else None) for i, n in enumerate(names)]
    df = spark.createDataFrame([(n, p, v) for p, n, v in items], "name string, pos long, vector array<double>")
    for least in (0.7, 0.95):
        want = one_by_one(items, least)
        got = graph.resolve_entities(df, least)
        assert sorted((r["pos"], r["canonical"]) for r in got.collect()) == want
        changed = [(p, c) for p, c in want if c != names[p]]
        assert tuple(graph.merged_pairs(got).first()) == (len(changed), len({c for _, c in want}))
        also = {r["canonical"]: r["aliases"] for r in graph.aliases_of(got).collect()}
        assert also == {c: sorted({names[p] for p, x in changed if x == c}) for _, c in changed}
    assert graph.resolve_entities(df.limit(0)).count() == 0
    alone = graph.resolve_names(spark.createDataFrame([("集团", 1), ("Co.", 2), ("公司", 3), (None, 4)], "name string, pos int"), tx.entity_key(F.col("name")))
    assert [r[2] for r in rows(alone, "pos")] == ["集团", "Co.", "公司", None]
