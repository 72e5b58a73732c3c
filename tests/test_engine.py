"""Operators of the retrieval engine on small literal frames."""

import random
import uuid

from pyspark.sql import functions as F

from graphquarry.functions import text as tx
from graphquarry.operators import chunking, evaluation, graph, incremental, reports, retrieval
from graphquarry.sources import readers, snapshots


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_text(spark):
    df = spark.createDataFrame([("　a \n b\x1f ", "works at", "drop; all)", "/x/Y.MD", "d#chunk-0")], "s string, r string, q string, p string, u string")
    got = df.select(tx.strip(F.col("s")), tx.content_key(F.col("s")), tx.relation_type(F.col("r")), tx.relation_type(F.col("q")), tx.doc_type(F.col("p")), tx.basename(F.col("p")), tx.vector_id(F.col("u"))).first()
    assert tuple(got) == ("a \n b", "a b", "WORKS_AT", "RELATED_TO", "markdown", "Y.MD", str(uuid.uuid5(uuid.NAMESPACE_URL, "d#chunk-0")))


def test_org_suffix(spark):
    df = spark.createDataFrame([("海风航运", 1), ("海风航运有限公司", 2), ("Acme Inc.", 3)], "name string, pos int")
    assert rows(graph.resolve_names(df, tx.entity_key(F.col("name"))), "pos")[1][2:] == ("海风航运", True)
    ends = [*"股份有限公司 有限责任公司 有限公司 集团 公司 股份 Corporation Corp. Corp INCORPORATED Inc. inc Ltd. ltd LLC Co. co S.A. GmbH AG".split()]
    df = spark.createDataFrame([(f"Nord {e} ",) for e in ends] + [("Cisco",), ("Nord Verein",)], "name string")
    assert [r[0] for r in df.select(tx.entity_key(F.col("name"))).collect()] == ["nord"] * len(ends) + ["cis", "nordverein"]


def test_relation_types_and_extensions(spark):
    known = ["BELONGS_TO", "WORKS_AT", "LOCATED_IN", "DEVELOPED_BY", "RELATED_TO", "PART_OF", "USES", "DEPENDS_ON"]
    said = [k.lower().replace("_", " - ") for k in known] + ["owns", "works__at", "_uses_", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "r string").select(tx.relation_type(F.col("r"))).collect()]
    assert got == known + ["RELATED_TO", "RELATED_TO", "USES", "RELATED_TO"]
    files = {"a.bmp": "image", "b.markdown": "unknown", "c.MD": "markdown", "d": "unknown", "e.f/g": "unknown", "h.csv": "table"}
    assert [r[0] for r in spark.createDataFrame([(x,) for x in files], "p string").select(tx.doc_type(F.col("p"))).collect()] == list(files.values())


def test_more_text(spark):
    df = spark.createDataFrame([("a::b::c", "```json\n{1}\n```", b"ab"), ("abc", " {2} ", b"")], "p string, f string, b binary")
    got = df.select(tx.rpartition(F.col("p"), "::"), tx.without_fence(F.col("f")), tx.data_url(F.col("b"))).collect()
    assert [tuple(map(lambda x: tuple(x) if hasattr(x, "asDict") else x, r)) for r in got] == [(("a::b", "c"), "{1}", "data:image/png;base64,YWI="), (("abc", ""), "{2}", "data:image/png;base64,")]


def test_fusion_prefers_both_lists(spark):
    lists = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "b"), (1, 2, 2, "c"), (1, 2, 3, "b")], "query_id int, list_id int, pos int, item string")
    got = rows(retrieval.fuse(lists), "rank")
    assert [r[2] for r in got] == ["b", "a", "c"] and 0 < got[-1][3] <= got[0][3] <= 1
    assert rows(retrieval.fuse(lists.where("false")), "rank") == []


def test_line_diff(spark):
    many = "\n".join(map(str, range(20_001)))
    near = "\n".join(f"x{i}" if i < 6001 else str(i) for i in range(20_001))
    df = spark.createDataFrame([("one\ntwo\nfour", "one\n2\nfour"), (None, ""), ("a\nb\nc", "a\nc\nd\ne"), (many, near)], "a string, b string")
    got = [tuple(r) for r in df.select(incremental.line_diff("a", "b").alias("d")).select("d.*").collect()]
    assert got[:3] == [(1, 1, 1, 0.3333, True, ["+ 2", "- two"]), (0, 0, 0, 0.0, False, []), (2, 1, 2, 0.4286, True, ["+ d", "+ e", "- b"])]
    assert got[3][:5] == (6001, 6001, 1, 0.3, True) and got[3][5] == [f"+ x{i}" for i in range(5)] + [f"- {i}" for i in range(5)]


def test_snapshot_counts(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "chunk_id string, content string")
    new = spark.createDataFrame([("1", "a"), ("2", "B")], "chunk_id string, content string")
    assert tuple(incremental.change_counts(incremental.snapshot_diff(old, new)).first()) == (1, 2, 1, 1)


def test_registry(spark):
    held = spark.createDataFrame([("x", 1)], "sha string, file_id int")
    up = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (4, "y", 3)], "file_id int, sha string, pos int")
    assert rows(incremental.register(held, up), "file_id") == [(2, "x", 1, False), (3, "y", 3, True), (4, "y", 3, False)]


def test_markdown(spark):
    text = "# Harbour\nintro\n## Ships\n### Tugs\nfirst\n\nsecond\n| a | b |\n|---|---|\n| 1 | 2 |\n## Docks\nend"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(readers.markdown_blocks(F.col("t")).alias("b")).collect()
    blocks = [tuple(b) for b in got[0]["b"]]
    assert ("paragraph", "first\nsecond", "Harbour / Ships / Tugs") in blocks
    assert ("table", "| a | b |\n|---|---|\n| 1 | 2 |", "Harbour / Ships / Tugs") in blocks and blocks[-1] == ("paragraph", "end", "Harbour / Docks")
    assert got[1]["b"] == [] and got[2]["b"] == []


def test_structural_chunks(spark):
    """Sizes, order, nothing lost, and packing as full as it can be."""
    sentence = "这是一个用来测试的句子，没有别的意思。"
    texts = ["短。", "", None, sentence * 60, "x" * 1300, "   ", "one two\n\n" * 200, " " * 600, "a! " * 400, "p" * 300 + "\n\n" + "q" * 300, "b" * 511 + "\n\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = rows(chunking.structural_chunks(df), "doc_id", "chunk_index")
    pieces = {i: [r[2] for r in got if r[0] == i] for i in range(len(texts))}
    assert pieces[0] == ["短。"] and all(pieces[i] == [] for i in (1, 2, 5, 7))
    full = 512 // len(sentence)
    assert [len(p) // len(sentence) for p in pieces[3]] == [full] * (60 // full) + [60 % full] * (60 % full > 0)
    assert [len(p) for p in pieces[4]] == [512, 512, 404]
    assert [len(p) for p in pieces[6]] == [511, 511, 511, 63]
    assert pieces[9] == ["p" * 300, "q" * 300] and pieces[10] == ["b" * 511, "y"]
    squeezed = lambda x: "".join(x.split())
    assert all(squeezed("".join(pieces[i])) == squeezed(texts[i]) for i in (3, 6, 8, 9, 10)) and max(len(p) for x in pieces.values() for p in x) <= 513


def test_semantic_chunks(spark):
    said = ["a" * 70, "b" * 20, "c" * 20, "d" * 50]
    vectors = [[1.0, 0.0], [0.0, 1.0], [0.1, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([(1, i, s, v) for i, (s, v) in enumerate(zip(said, vectors))] + [(2, 0, "e" * 600, [1.0, 0.0])], "doc_id int, pos int, sentence string, embedding array<double>")
    assert [r[3] for r in rows(chunking.semantic_distances(df), "doc_id", "pos")] == [True, False, False]
    assert rows(chunking.semantic_chunks(df, size=128), "doc_id", "chunk_index")[:2] == [(1, 0, said[0]), (1, 1, said[1] + said[2] + said[3])]
    assert [len(r[2]) for r in rows(chunking.semantic_chunks(df.where("doc_id = 2")), "chunk_index")] == [512, 152]
    assert chunking.semantic_chunks(df.where("false")).count() == 0


def test_upsert_and_review(spark):
    held = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 3), (None, 8, 4)], "chunk_id string, v int, pos int")
    assert rows(incremental.upsert(held, new), "v") == [("a", 1), (None, 3), ("b", 6), ("c", 7)]
    reviews = spark.createDataFrame([("a", False), ("b", None), ("a", False)], "chunk_id string, approved boolean")
    assert rows(incremental.approved(held, reviews, "chunk_id"), "v") == [("b", 2), (None, 3)]
    assert rows(incremental.delete_documents(held, reviews, "chunk_id"), "v") == [(None, 3)]


def test_refine(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    first = spark.createDataFrame([(1, 1, "a", 0.9), (2, 1, "b", 0.1)], "query_id int, rank int, item string, score double")
    more = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (2, 2, "b"), (3, 1, "z")], "query_id int, rank int, item string")
    got = rows(retrieval.refine(queries, first, lambda weak: more.join(weak, "query_id", "left_semi")).drop("rounds"), "query_id", "rank")
    assert got == [(1, 1, "a", False), (2, 1, "b", True), (2, 2, "y", True), (3, 1, "z", True)]


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/snapshots"
    assert snapshots.load(spark, folder) is None
    assert [snapshots.publish(spark.range(n), folder) for n in (2, 5)] == [1, 2]
    (tmp_path / "snapshots/v-000000003").mkdir()
    assert snapshots.load(spark, folder).count() == 5 and snapshots.publish(spark.range(1), folder) == 4
    assert snapshots.remove(spark, folder) and snapshots.load(spark, folder) is None


def test_graph_deletes(spark):
    e = spark.createDataFrame([("a", ["s::1"]), ("b", ["s::1", "t::2"])], "name string, provenance array<string>")
    r = spark.createDataFrame([("a", "X", "b", ["s::1", "t::2"])], "head string, rel_type string, tail string, provenance array<string>")
    kept, edges = graph.without_provenance(e, r, lambda p: p.startswith("s::"))
    assert rows(kept, "name") == [("b", ["t::2"])] and edges.count() == 0


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "query_id int, rank int, ok boolean")
    got = {r["k"]: r for r in evaluation.metrics(evaluation.first_ranks(q, ranked, F.col("ok")), (1, 2)).collect()}
    assert got[1]["recall"] == 0 and got[2]["recall"] == 0.5 and got[1]["mrr"] == 0.25


def test_registered_queries_match_sql(spark):
    import duckdb

    from graphquarry.plans import registry

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name in ("vector_topk", "rrf_fusion", "retrieval_support", "weighted_rerank", "rerank_head_tail", "evidence_blocks", "fixed_chunks_tail", "core_sentences", "entity_resolution", "relation_normalize", "path_ids", "hybrid_retrieve", "graph_retrieve", "graph_upsert", "delete_by_chunks", "extracted_entities", "rewritten_relations", "upload_dedup", "registry_update", "change_handlers", "csv_ingest", "text_ingest", "context_dedup", "fixed_chunks", "entity_merge", "neighbors_2hop", "snapshot_diff", "eval_metrics", "golden_hit", "semantic_boundaries", "self_rag_refine", "vector_upsert", "vector_delete", "review_gate"):
        df = registry.QUERIES[name](spark, folder)
        names = sorted(df.columns)
        mine = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
        theirs = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({registry.ORACLES[name]})").fetchall()
        assert mine == sorted(map(repr, theirs)), name


def test_every_twentieth_vector_is_searched(spark):
    from graphquarry.plans import registry

    assert {r["query_id"] for r in registry.QUERIES["vector_topk"](spark, "/root/testdata/sf0.001").collect()} == set(range(0, 500, 20))


def test_core_sentences_are_cut_without_patterns(spark):
    """The same sentences as a pattern finds, at the same places, by a plan that has none to find them."""
    import re

    r = random.Random(6)
    texts = ["".join(r.choice("abc, 7，。！？!?；;\n\r\u3000\x85\x1c\U0001f600") for _ in range(r.randrange(160))) for _ in range(400)] + ["", None, "!!", "a\r\n", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = chunking.core_sentences(df, 3, 40)
    space = re.compile("^[\\s\x1c-\x1f\x85]+|[\\s\x1c-\x1f\x85]+$")
    want = [(i, k, space.sub("", x)) for i, t in enumerate(texts) for k, x in enumerate(re.findall("[^。！？!?；;\n]+[。！？!?；;]?", t or ""))]
    assert sorted(map(tuple, got.select("doc_id", "pos", "sentence").collect())) == [w for w in want if 3 <= len(w[2]) <= 40]
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    every = spark.range(0, 0x10FFFF).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    x = F.concat("c", F.lit("a"), "c", "c")
    assert every.where(tx.strip(x) != F.regexp_replace(x, f"^{tx.SPACE}+|{tx.SPACE}+$", "")).count() == 0


def test_hybrid_retrieval_answers_every_twentieth_vector(spark):
    from graphquarry.plans import registry

    found = registry.QUERIES["hybrid_retrieve"](spark, "/root/testdata/sf0.001").groupBy("query_id").count().collect()
    assert {r["query_id"] for r in found} == set(range(0, 500, 20)) and min(r["count"] for r in found) >= 5 and max(r["count"] for r in found) == 8


def test_metrics_count_twenty_ranks(spark, tmp_path):
    """The only other vector of the query's label is the 15th nearest."""
    from graphquarry.plans import registry

    rows = [(i, [1.0, 0.01 * i], 7 if i in (0, 14) else 1) for i in range(20)] + [(i, [-1.0, 0.0], 1) for i in range(21, 40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in registry.QUERIES["eval_metrics"](spark, f"file://{tmp_path}").select("k", "recall", "mrr").collect()} == {(k, 0.0, round(1 / 15, 6)) for k in (1, 5, 10)}


def test_evidence_blocks_hold_the_whole_text(spark):
    from graphquarry.plans import registry

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["block"] for r in registry.QUERIES["evidence_blocks"](spark, folder).collect()}
    assert max(map(len, texts.values())) > 200 and got.keys() == texts.keys()
    assert all(got[i].split("\n", 1)[1] == t for i, t in texts.items())


def test_fragments_by_pieces(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c中🙂\n") for _ in range(rng.randint(0, 120))) for _ in range(80)] + [None, "x" * 200]
    found = [t[k : k + n] for t in texts[:60] for n in (1, 2, 3, 5, 10, 11, 12, 30, 31, 40) if len(t) > n for k in [rng.randrange(len(t) - n)]]
    golden = [*found, *(f[::-1] + "q" for f in found[:40]), "", " ", None, "X" * 31, found[0]]
    same = lambda t: "".join((t or "").split()).lower()
    want = {(i, d) for i, f in enumerate(golden) for d, t in enumerate(texts) if same(f) and same(f) in same(t)}
    g, d = spark.createDataFrame(list(enumerate(golden)), "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in evaluation.golden_hits(g, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert evaluation.golden_hits(g.limit(0), d).count() == 0 and evaluation.golden_hits(g, d.limit(0)).count() == 0


def test_runs(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 15))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))) for _ in range(400)]
    longest = lambda a, b: max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[1] for r in rows(df.select("i", evaluation.shares_run(F.col("a"), F.col("b"))), "i")]
    assert got == [bool(a) and longest(a, b) / len(a) >= 0.6 for a, b in pairs]


def test_percent_changes(spark):
    rng = random.Random(6)
    values = [(1 + k / 400, 1.0) for k in range(-60, 60)] + [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(300)] + [(2000.0 + k, 2000.0) for k in range(40)] + [(1.0, 0.0), (0.0, 3.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)] + [(9999, None, 1.0)], "i int, a double, b double")
    got = [r[1] for r in rows(df.select("i", reports.percent_change(F.col("a"), F.col("b"))), "i")]
    assert got == [f"{(a - b) / b * 100:+.1f}%" if b else "N/A" for a, b in values] + [None]


def test_golden_matches(spark):
    samples = spark.createDataFrame([(1, "q", "abcdefghij", "x.md"), (2, "r", "Hello  World", None)], "query_id int, question string, golden_fragment string, source_doc string")
    found = [(1, 1, "zz ABCDEF zz", "/d/x.md"), (1, 2, "abc def ghij", "/d/y.md"), (1, 3, "abcde", "x.md"), (2, 1, None, None), (2, 2, "say hello world", None)]
    results = spark.createDataFrame(found, "query_id int, rank int, content string, source string")
    assert rows(evaluation.golden_matches(samples, results), "query_id", "rank") == [(1, 1, True), (1, 2, False), (1, 3, False), (2, 1, False), (2, 2, True)]
    timed = results.withColumn("ms", F.lit(7.0) * F.col("query_id")).withColumn("rounds", F.col("query_id"))
    every = evaluation.evaluate_variants({"all": lambda q, k: timed, "none": lambda q, k: results.where("rank > 2"), "deep": lambda q, k: results.withColumn("rank", F.col("rank") + 1)}, samples, (1, 2), warm_up=1)
    got = {(r["variant"], r["k"]): (r["recall"], r["hits"], r["mrr"], r["p50"], r["p95"], r["rounds"], r["n"]) for r in every.collect()}
    assert got == {("all", 1): (0.5, 1, 0.75, 10.5, 13.65, 2.0, 2), ("all", 2): (1.0, 2, 0.75, 10.5, 13.65, 2.0, 2), ("none", 1): (0.0, 0, 0.0, None, None, 0.0, 2), ("none", 2): (0.0, 0, 0.0, None, None, 0.0, 2), ("deep", 1): (0.0, 0, 0.25, None, None, 0.0, 2), ("deep", 2): (0.5, 1, 0.25, None, None, 0.0, 2)}
    table = [tuple(r) for r in evaluation.comparison(every, "deep", "all").orderBy("place").collect()]
    assert table[0] == (1, "MRR", "0.2500", "0.7500", "+200.0%") and table[3][1:] == ("Recall@2", "0.5000", "1.0000", "+100.0%") and table[1] == (2, "Recall@1", "0.0000", "0.5000", "N/A")
    assert table[-1] == (1001, "P95 延迟(ms)", None, "14", None)
