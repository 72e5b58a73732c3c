"""Providers, the default embedding, chunks by meaning, retrieval from questions to answers, and variants."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphquarry.api import Engine, read_only
from graphquarry.functions.embedding import DIMS, embed, embed_rows
from graphquarry.functions.vector import cosine
from graphquarry.operators import evaluation, providers, retrieval, variants
from graphquarry.sources import office


def test_default_embedding(spark):
    texts = [("a", "Tencent  Technology "), ("b", "tencent technology"), ("c", "Tencent Technologies"), ("d", "garden tools"), ("e", ""), ("f", None), ("g", "字"), ("h", "x y " * 3000)]
    df = spark.createDataFrame(texts, "k string, t string")
    one = {r["k"]: r["e"] for r in df.select("k", embed(F.col("t")).alias("e")).collect()}
    many = {r["k"]: r["embedding"] for r in embed_rows(df, "k", "t").collect()}
    assert one == many and all(len(v) == DIMS for v in one.values())
    cos = lambda a, b: sum(x * y for x, y in zip(one[a], one[b])) / math.sqrt(sum(x * x for x in one[a]) * sum(y * y for y in one[b]))
    assert cos("a", "b") == pytest.approx(1) and cos("a", "c") > 0.5 > cos("a", "d")
    assert set(one["e"]) == set(one["f"]) == {0.0} and any(one["g"])


def test_embedded_rows_are_compiled(spark):
    """Rows of several keys get what ``embed`` gives, by a plan without functions over arrays."""
    texts = [(i % 3, i, "".join(random.Random(i).choice("ab \u3000\n字é\U0001f600") for _ in range(i))) for i in range(60)]
    df = spark.createDataFrame(texts, "d int, k int, t string")
    many = embed_rows(df, ["d", "k"], "t")
    assert {(r[0], r[1]): r[2] for r in many.collect()} == {(r[0], r[1]): r[2] for r in df.select("d", "k", embed(F.col("t"))).collect()}
    assert "lambda" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_providers_in_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(20)], "i int, content string").coalesce(2)

    def factory():
        def provider(inputs):
            assert len(inputs) <= 4 and None not in inputs
            if "t7" in inputs:
                raise RuntimeError("bad input")
            return [[float(x[1:]), 1.0] for x in inputs]

        return provider

    got = {r["i"]: r for r in providers.embedded(df, factory, size=4).collect()}
    assert all(got[i]["embedding"] == [float(i), 1.0] and got[i]["embedding_error"] is None for i in range(20) if i not in (3, 7))
    assert got[7]["embedding"] is None and got[7]["embedding_error"] == "RuntimeError: bad input" and got[3]["embedding"] is None and got[3]["embedding_error"] is None
    short = providers.embedded(df, lambda: lambda inputs: [], size=4).collect()
    assert all(r["embedding_error"] for r in short if r["i"] != 3)
    replies = {"t0": '```json\n{"queries": ["x"], "n": 2}\n```', "t1": "none", "t2": '{"other": 1}', "t4": '{"queries": 5}'}
    told = {r["i"]: r for r in providers.structured(df, lambda: lambda p: [replies.get(x, "{}") for x in p], F.col("content"), "queries array<string>, n int").collect()}
    assert tuple(told[0]["reply"]) == (["x"], 2) and told[1]["reply"] is None and told[1]["reply_error"] == "not json" and tuple(told[2]["reply"]) == (None, None)
    assert told[3]["reply"] is None and told[3]["reply_error"] is None and providers.embedded(df.limit(0), factory).count() == 0


MARKS = "。！？!?；;"


def pieces_of(text, vectors, size, percentile=85):
    """A block cut one sentence after the other."""
    said = [s.strip() for s in re.split(rf"(?<=[{MARKS}])\s*|\n+", text) if s.strip()]
    if len(said) < 2:
        return None
    v = [vectors(s) for s in said]
    norm = lambda a: math.sqrt(sum(x * x for x in a))
    far = [round(1 - sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), 6) if norm(a) and norm(b) else 0.0 for a, b in zip(v, v[1:])]
    least = sorted(far)[min(round(percentile / 100 * (len(far) - 1)), len(far) - 1)]
    out, buf = [], said[0]
    for k, s in enumerate(said[1:]):
        if (far[k] >= least and len(buf) >= max(60, size // 4)) or len(buf) + len(s) > size:
            out.append(buf)
            buf = s
        else:
            buf += s
    return [*out, buf]


def test_chunks_by_meaning(spark):
    say = lambda n, c: (c * n + "!")
    long = " ".join(say(20 + 7 * (k % 5), "abc"[k % 3]) for k in range(30))
    texts = {"d1": [("heading", "Top", False), ("paragraph", long, False), ("table", "| a |", True), ("paragraph", "one only " * 9, False)], "d2": [("paragraph", "tiny. bit!", False)], "d3": [("paragraph", " ", False)], "d4": []}
    row = lambda b: (b[0], b[1], 0, "h", b[2])
    docs = spark.createDataFrame([(d, "text", f"/{d}.md", [row(b) for b in bs]) for d, bs in texts.items()], f"doc_id string, doc_type string, path string, blocks {office.BLOCKS}")
    meaning = lambda c: F.array((F.char_length(c) % 7).cast("double"), (F.ascii(c) % 3).cast("double"), F.lit(1.0))
    vectors = lambda s: [float(len(s) % 7), float(ord(s[0]) % 3), 1.0]
    got = office.chunk_documents(docs, meaning, size=200).orderBy("doc_id", "chunk_index").collect()
    want = ["Top", *pieces_of(long, vectors, 200), "| a |", ("one only " * 9).strip()]
    assert [(r["chunk_index"], r["content"]) for r in got if r["doc_id"] == "d1"] == list(enumerate(want)) and len(want) > 6
    assert [(r["chunk_id"], r["content"]) for r in got if r["doc_id"] != "d1"] == [("d2#chunk-0", "tiny. bit!")]  # by structure, as no piece is over 20
    plain = office.chunk_documents(docs, None, size=200)
    assert plain.exceptAll(office.block_chunks(docs, 200)).count() == 0 and office.chunk_documents(docs.limit(0), meaning).count() == 0


def stores(spark):
    words = ["river boats carry grain", "stars burn hydrogen slowly", "bakers knead sour dough", "foxes hunt at night", "glass bends light well"]
    chunks = spark.createDataFrame([(f"k{i}", w, f"/d/f{i}.md", 1, "") for i, w in enumerate(words)], "chunk_id string, content string, source string, page int, heading_path string").withColumn("embedding", embed(F.col("content")))
    entities = spark.createDataFrame([("river", "T", "water", ["/d/f0.md::k0"]), ("grain", "T", "", None)], "name string, type string, description string, provenance array<string>")
    relations = spark.createDataFrame([("river", "USES", "grain", ["/d/f0.md::k0"])], "head string, rel_type string, tail string, provenance array<string>")
    return chunks, entities, relations


def test_api(spark, tmp_path):
    engine = Engine(*stores(spark))
    questions = spark.createDataFrame([(1, "Stars burn hydrogen", None, None), (2, "who carries grain", ["river boats", " ", "grain"], ["river", "grain"]), (3, "", None, None)], "query_id int, question string, queries array<string>, entities array<string>")
    found = engine.search_knowledge(questions, 99)
    got = {(r["query_id"], r["rank"]): r for r in found.collect()}
    assert got[1, 1]["content"] == "stars burn hydrogen slowly" and got[1, 1]["citations"][0]["source"] == "/d/f1.md" and (1, 5) in got and (1, 6) not in got
    assert {r["retrieval_type"] for (q, _), r in got.items() if q == 2} == {"vector", "graph"} and not any(q == 3 for q, _ in got)
    asked = {r["query_id"]: r for r in engine.ask(questions).collect()}
    assert asked[1]["answer"] == "stars burn hydrogen slowly" and asked[1]["intent"] == "factoid" and asked[1]["rounds"] == 1 and asked[3]["answer"] is None and asked[3]["confidence"] == 0.0
    assert [tuple(r) for r in engine.query_graph("SELECT name FROM entities WHERE name = 'grain';").collect()] == [("grain",)]
    for bad in ("DROP TABLE entities", "INSERT INTO entities VALUES (1)", "CREATE TABLE x AS SELECT 1", "SET a=b"):
        with pytest.raises(ValueError, match="read"):
            read_only(spark, bad)
    assert {tuple(r) for r in engine.get_stats().collect()} == {("vectors", 5), ("entities", 2), ("relations", 1)}
    (tmp_path / "n.md").write_text("# T\n\nsome longer text that is over twenty characters")
    assert [r["content"] for r in engine.parse_documents(f"file://{tmp_path}").orderBy("chunk_index").collect()] == ["T", "some longer text that is over twenty characters"]


def test_rerank_and_its_failures(spark):
    fused = spark.createDataFrame([(q, r, f"{q}{r}", f"c{r}", "s", 1 / r, 0.5, "vector", []) for q in (1, 2) for r in range(1, 7)] + [(3, 1, "31", "c", "s", 0.9, 0.5, "graph", [])], f"query_id int, rank int, key string, content string, source string, score double, original_score double, retrieval_type string, citations array<{retrieval.CITATION}>")
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, question string")
    seen = []

    def rerank(rows):
        seen.extend(r["key"] for r in rows.collect())
        return rows.withColumn("raw", F.when(F.col("key") != "22", -F.length("content") + F.substring("key", 2, 1).cast("double")))

    got = {}
    for r in retrieval.reranked(fused, questions, rerank, 5, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["key"], round(r["score"], 4)))
    assert [k for k, _ in got[1]] == ["14", "13", "12", "11", "15"] and got[1][0][1] == round(1 / (1 + math.exp(-2)), 4) and got[1][4][1] == 0.2
    assert [k for k, _ in got[2]] == ["21", "22", "23", "24", "25"] and got[2][0][1] == 1.0 and got[3] == [("31", 0.9)]
    assert sorted(seen) == ["11", "12", "13", "14", "21", "22", "23", "24"]


def test_refinement_rounds(spark):
    first = spark.createDataFrame([(1, 1, "a", 0.9), (2, 1, "b", 0.1), (4, 1, "d", 0.1)], "query_id int, rank int, item string, score double")
    queries = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id int")
    calls = []

    def again(weak):
        calls.append(sorted(r[0] for r in weak.collect()))
        return weak.where("query_id IN (2, 3)").select("query_id", F.lit(1).alias("rank"), F.lit("new").alias("item"))

    judged = lambda rows: rows.where("query_id <> 4").groupBy("query_id").agg(F.max(F.when(F.col("item") == "new", 0.1).otherwise(F.col("score"))).alias("support"))
    got = sorted(map(tuple, retrieval.refine(queries, first, again, threshold=0.6, max_rounds=2, relevance=judged).collect()))
    assert calls == [[2, 3, 5]] and got == [(1, 1, "a", False, 1), (2, 1, "b", True, 2), (2, 2, "new", True, 2), (3, 1, "new", True, 2), (4, 1, "d", False, 1)]
    calls.clear()
    got = sorted(map(tuple, retrieval.refine(queries, first, again, threshold=0.6, max_rounds=3, relevance=judged).collect()))
    assert calls == [[2, 3, 5], [2, 3]] and (3, 1, "new", True, 3) in got  # 5 ended with nothing
    assert retrieval.refine(queries, first, again, max_rounds=1).count() == 3


def test_evidence_and_citations(spark):
    cite = lambda s, c, p, h="": (s, c, p, h)
    rows = [(1, 1, 1, "", "Same  text", "s1", 0.4, "vector", [cite("", "", 0), cite("s1", "", 0)]), (1, 2, 1, "", "same TEXT", "s2", 1.0, "graph", [cite("s1", "", 0), cite("", "", 3)]), (1, 1, 2, "k", "other", "s3", 0.2, "vector", None), (1, 1, 3, "k", "differs", "s4", 0.7, "vector", []), (2, 1, 1, "", "same text", "", 0.1, "vector", [cite("", "", 0)])]
    df = spark.createDataFrame(rows, f"query_id int, list_id int, pos int, chunk_id string, content string, source string, score double, retrieval_type string, citations array<{retrieval.CITATION}>")
    got = {(r["query_id"], r["content"]): r for r in retrieval.hybrid_fuse(df).collect()}
    assert got[1, "Same  text"]["original_score"] == 0.4 and got[1, "Same  text"]["retrieval_type"] == "hybrid" and [tuple(c) for c in got[1, "Same  text"]["citations"]] == [("s1", "", 0, ""), ("", "", 3, "")]
    assert got[1, "other"]["original_score"] == 0.7 and [tuple(c) for c in got[1, "other"]["citations"]] == [("s3", "k", 0, ""), ("s4", "k", 0, "")]
    assert got[2, "same text"]["citations"] == []
    merged = {(r["query_id"], r["content"]): (r["score"], r["merged"], r["retrieval_type"]) for r in retrieval.merge_evidence(df.withColumn("pos", F.col("list_id") * 10 + F.col("pos"))).collect()}
    assert merged == {(1, "Same  text"): (1.0, 2, "hybrid"), (1, "other"): (0.7, 2, "vector"), (2, "same text"): (0.1, 1, "vector")}
    assert retrieval.by_type_fused(df.withColumn("pos", F.col("list_id") * 10 + F.col("pos")), 1).count() == 2


def test_variants(spark):
    chunks, entities, relations = stores(spark)
    from graphquarry.operators import vector_index

    index = vector_index.build(chunks.select("chunk_id", "embedding"), key="chunk_id")
    asked = spark.createDataFrame([(1, "Stars burn hydrogen", None, ["river"]), (2, "nothing like it", ["foxes hunt at night"], None)], "query_id int, question string, queries array<string>, entities array<string>")
    samples = spark.createDataFrame([(1, "Stars burn hydrogen", "stars burn hydrogen slowly", "f1.md"), (2, "nothing like it", "foxes hunt at night", None)], "query_id int, question string, golden_fragment string, source_doc string")
    rerank = lambda rows: rows.withColumn("raw", cosine(embed(F.col("question")), embed(F.col("content"))))
    ways = variants.build_variants(index, chunks, asked, entities, relations, embed, lambda weak: asked.join(weak, "query_id", "left_semi"), rerank)
    got = {(r["variant"], r["k"]): (r["recall"], r["rounds"]) for r in evaluation.evaluate_variants(ways, samples, (1, 5), warm_up=0).collect()}
    assert set(v for v, _ in got) == {"vector_raw", "vector_rewritten", "hybrid_rrf", "hybrid_rrf_self_rag", "hybrid_rrf_reranker"}
    assert got["vector_rewritten", 1] == (1.0, 1.0) and got["hybrid_rrf", 1] == (1.0, 1.0) and got["vector_raw", 5] == (1.0, 1.0) and got["hybrid_rrf_self_rag", 5][0] == 1.0


ODD = ["", " ", "a", "x" * 31, "y" * 33, "z" * 70, "ab " * 200, "你好。世界！", "😀 a 😀😀b", "ünïcode wörds " * 40, "\t\n", "İstanbul ΣΑΣ", "1 22 333 4444 55555 666666 7777777 88888888"]


def test_numpy_embeds_as_columns_do(spark):
    import numpy as np
    import pyarrow as pa

    from graphquarry.functions.embedding import key_vectors
    from graphquarry.functions.text import content_key

    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *ODD])], "i int, t string")
    want = df.select("i", content_key(F.col("t")).alias("k"), embed(F.col("t")).alias("v")).orderBy("i").collect()
    assert np.array_equal(key_vectors(pa.array([r["k"] for r in want])), np.array([r["v"] for r in want]))


def test_default_chunks_by_meaning_take_no_shuffle(spark):
    """They are those of the same embedding given as a function, and each document is cut in its own row."""
    words = ["river bank water boat", "loan rate credit bank", "dog cat bird fish"]
    said = lambda k: "".join(f"{words[(i * i + k) % 3]} {i % 5}{'。!?;'[i % 4]}{' ' * (i % 3)}" for i in range(30))
    plain = lambda t, kind="paragraph": (kind, t, 3, "h", kind == "table")
    docs = [("a", [plain(said(0)), plain("| x | y |", "table"), plain(said(1) + "w" * 700 + "\n\n" + "v " * 400)]), ("b", [plain("t", "heading"), plain("short. one")]), ("c", [plain("a。b。")]), ("d", []), ("e", None), ("f", [(*plain(None)[:1], None, 0, "", False), plain(None, "table"), plain(said(2))]), ("g", [plain("u" * 900), plain("!!！\n \n" + said(1))])]
    docs += [(f"o{i}", [plain(t), plain(t * 9)]) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(d, "text", f"/x/{d}", b) for d, b in docs], f"doc_id string, doc_type string, path string, blocks {office.BLOCKS}")
    for size, share in ((512, 85), (64, 50), (20, 0)):
        got, want = (office.chunk_documents(df, e, size, size // 8, share) for e in (embed, lambda c: embed(c)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 40 and "Exchange" not in office.chunk_documents(df, embed)._jdf.queryExecution().executedPlan().toString()


def test_shared_lists_fuse_as_whole_ones(spark):
    """Lists of a graph that questions share are cut to what can be among the first, and give the first of the whole fusion."""
    r = random.Random(5)
    vector = [(q, p, "" if r.random() < 0.7 else f"c{p}", f"Text {r.randrange(40)}", f"v{p}", r.random(), "vector", 0, "") for q in range(12) for p in range(1, 8)]
    graph = [(f"l{k}", p, f"text  {r.randrange(45)}", f"g{p}", 1.0, "graph", "neighbors", [(f"g{p}", str(k), 0, "")]) for k in range(3) for p in range(1, 56)]
    vectors = spark.createDataFrame(vector, "query_id int, pos int, chunk_id string, content string, source string, score double, retrieval_type string, page int, heading_path string")
    lists = spark.createDataFrame([(q, f"l{q % 3}") for q in range(1, 14)], "query_id int, list string")
    held = spark.createDataFrame(graph, f"list string, pos int, content string, source string, score double, retrieval_type string, strategy string, citations array<{retrieval.CITATION}>")
    questions = lists.select("query_id", F.lit("q").alias("question"))
    for top in (1, 4, 8):
        want = retrieval.retrieve(questions, vectors, lists.join(held, "list").drop("list"), top=2**31 - 1).where(F.col("rank") <= top)
        got = retrieval.retrieve(questions, vectors, held, top=top, lists=lists)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        if top < 8:
            assert retrieval.of_lists(vectors, held, lists, top)[1].groupBy("query_id").count().agg(F.max("count")).first()[0] < 55


def test_equal_texts_are_searched_once(spark, monkeypatch):
    from graphquarry.operators import vector_index

    chunks = stores(spark)[0]
    index, asked, search = vector_index.build(chunks.select("chunk_id", "embedding"), key="chunk_id"), [], vector_index.nearest
    monkeypatch.setattr(retrieval.vector_index, "nearest", lambda i, q, k: (asked.append((q.count(), k)), search(i, q, k))[1])
    once = retrieval.by_embedding(index, embed)
    rows = spark.createDataFrame([(1, "river"), (2, "river"), (3, "fox"), (4, None)], "key int, text string")
    first = sorted(map(tuple, once(rows, 2).collect()))
    assert sorted(map(tuple, once(rows.where("key < 3"), 2).collect())) == [r for r in first if r[0] < 3] and asked == [(3, 5)]
    want = search(index, rows.select(F.col("key").alias("query_id"), embed(F.col("text")).alias("query")), 2)
    assert first == sorted(map(tuple, want.select("query_id", "rank", "vec_id", "score").collect()))
    once(rows.where("key = 1"), 7)
    assert asked[1:] == [(1, 7)] and sorted(map(tuple, once(rows, 2).collect())) == first
