"""Vector search, rank fusion, evidence merging and reranking over many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions.text import content_key, strip
from ..functions.vector import sigmoid
from ..sources.folders import settled
from . import vector_index

RRF_K = 60
#: Weights of document types. Fixed values; others weigh 1.
MODALITY = {"pdf": 0.95, "table": 0.9, "image": 0.85}


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors by cosine of ``queries`` (query_id, query), exactly.

    The vectors are indexed for this call; with an index at hand, ``vector_index.nearest`` searches it."""
    return vector_index.nearest(vector_index.build(vectors), queries, k)


def fuse(lists: DataFrame, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_id, pos, item): score = sum of 1/(60+rank), over lists/61, at most 1. With a column
    ``place`` that is the rank among the list's items, of which some may be left out."""
    held = [F.min("place").alias("rank")] if "place" in lists.columns else []
    ranked = lists.groupBy("query_id", "list_id", "item").agg(F.min("pos").alias("pos"), *held)
    if not held:
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list_id").orderBy("pos")))
    held = ranked.groupBy("query_id").agg(F.count_distinct("list_id").alias("n_lists"))
    fused = ranked.groupBy("query_id", "item").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("raw"), F.min(F.struct("list_id", "pos")).alias("first"))
    fused = fused.join(held, "query_id").withColumn("score", F.round(F.least(F.lit(1.0), F.col("raw") / (F.col("n_lists") / (RRF_K + 1.0))), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "item")
    out = fused.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "item", "score")
    return out.where(F.col("rank") <= top) if top else out


#: A place that evidence names.
CITATION = "struct<source:string,chunk_id:string,page:int,heading_path:string>"


def own_citation(df: DataFrame) -> Column:
    """A context's citations: those it has, or the place that its own columns name. Missing columns and nulls are empty."""
    value = lambda c, empty: (F.coalesce(F.col(c).cast("int" if empty == 0 else "string"), F.lit(empty)) if c in df.columns else F.lit(empty)).alias(c)
    own = F.array(F.struct(value("source", ""), value("chunk_id", ""), value("page", 0), value("heading_path", "")).cast(CITATION))
    return F.when(F.size(F.coalesce("citations", F.array().cast(f"array<{CITATION}>"))) > 0, F.col("citations").cast(f"array<{CITATION}>")).otherwise(own) if "citations" in df.columns else own


def merged_citations(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """(by, citations): of ``rows`` with an array ``citations`` the distinct ones by source, chunk and page, in order of sight;
    those in which nothing is set are dropped. Reduced to a row a citation before any list is made."""
    each = rows.select(*by, order.alias("#at"), F.posexplode("citations").alias("#k", "c"))
    said = (F.coalesce("c.source", F.lit("")) != "") | (F.coalesce("c.chunk_id", F.lit("")) != "") | (F.coalesce("c.page", F.lit(0)) != 0) | (F.coalesce("c.heading_path", F.lit("")) != "")
    seen = F.struct("#at", "#k")
    first = each.where(said).groupBy(*by, F.col("c.source").alias("s"), F.col("c.chunk_id").alias("i"), F.col("c.page").alias("p")).agg(F.min(seen).alias("seen"), F.min_by("c", seen).alias("c"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "c"))), lambda x: x["c"]).alias("citations"))


def citation_text(citations: Column) -> Column:
    """``source|chunk|page`` of each citation."""
    return F.transform(citations, lambda c: F.concat_ws("|", c["source"], c["chunk_id"], c["page"].cast("string")))


def merge_evidence(contexts: DataFrame) -> DataFrame:
    """Contexts (query_id, pos, content, source, score, retrieval_type and, if at hand, chunk_id, page, heading_path, citations)
    with one row for each evidence of a query: (query_id, key, content, source, score, retrieval_type, first_pos, merged,
    citations). The first payload stays, the best score, hybrid if types are mixed, and all citations in order."""
    chunk = F.col("chunk_id") if "chunk_id" in contexts.columns else F.lit("")
    keyed = contexts.withColumn("key", context_key(chunk, F.coalesce("content", F.lit("")))).withColumn("citations", own_citation(contexts))
    cites = merged_citations(keyed, ["query_id", "key"], F.col("pos"))
    kind = F.when(F.count_distinct("retrieval_type") > 1, "hybrid").otherwise(F.min("retrieval_type"))
    folded = keyed.groupBy("query_id", "key").agg(F.min_by("content", "pos").alias("content"), F.min_by("source", "pos").alias("source"), F.max("score").alias("score"), kind.alias("retrieval_type"), F.min("pos").alias("first_pos"), F.count("*").alias("merged"))
    return folded.join(cites, ["query_id", "key"], "left").withColumn("citations", F.coalesce("citations", F.array().cast(f"array<{CITATION}>")))


def merge_citations(citations: DataFrame) -> DataFrame:
    """Ordered distinct (source, chunk_id, page) of each item, as text; those in which nothing is set, page 0 included, are
    dropped."""
    some = citations.where((F.coalesce("source", F.lit("")) != "") | (F.coalesce("chunk_id", F.lit("")) != "") | (F.coalesce("page", F.lit(0)) != 0))
    first = some.groupBy("item", "source", "chunk_id", "page").agg(F.min("pos").alias("pos"))
    return first.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source", "chunk_id", "page"))), lambda c: F.concat_ws("|", c["source"], c["chunk_id"], c["page"].cast("string"))).alias("citations"))


def support(ranked: DataFrame) -> DataFrame:
    """Mean of each query's three best scores, held to 0..1."""
    best = ranked.where(F.col("rank") <= 3)
    return best.groupBy("query_id").agg(F.round(F.avg(F.greatest(F.lit(0.0), F.least("score", F.lit(1.0)))), 4).alias("support"))


def refine(queries: DataFrame, first: DataFrame, again: Callable[[DataFrame], DataFrame], top: int = 8, threshold: float = 0.6, max_rounds: int = 2, relevance: Callable[[DataFrame], DataFrame] = support) -> DataFrame:
    """(query_id, rank, item, retried, rounds): further retrievals for the queries that have no contexts or whose relevance is
    below ``threshold``, up to ``max_rounds`` in all; old and new lists are fused and cut to ``top``. A query that isn't
    retried keeps its first ``top``.

    ``first`` is (query_id, rank, item, score). ``relevance`` judges such rows: (query_id, support); a query that has contexts
    and gets no judgement (its evaluator failed) is kept as it is. ``again`` gives (query_id, rank, item) for the queries
    that it gets, which are all searched at once. A query that still has nothing after a retrieval ends there."""
    current = settled(first.select("query_id", "rank", "item", "score", F.lit(1).alias("rounds")), "contexts")
    open_ = settled(queries.select("query_id").distinct(), "queries")
    for number in range(2, max_rounds + 1):
        own = current.join(open_, "query_id", "left_semi")
        some = own.select("query_id").distinct()
        low = relevance(own).where(F.col("support") < threshold).select("query_id")
        weak = settled(open_.join(some, "query_id", "left_anti").unionByName(low.join(some, "query_id", "left_semi")), "weak")
        if weak.isEmpty():
            break
        held = own.join(weak, "query_id", "left_semi").select("query_id", F.lit(1).alias("list_id"), F.col("rank").alias("pos"), "item")
        more = again(weak).select("query_id", F.lit(2).alias("list_id"), F.col("rank").alias("pos"), "item")
        fused = fuse(held.unionByName(more), top).select("query_id", "rank", "item", "score", F.lit(number).alias("rounds"))
        current = settled(current.join(weak, "query_id", "left_anti").unionByName(fused), "contexts")
        open_ = settled(fused.select("query_id").distinct(), "queries")
    return current.where((F.col("rank") <= top) | (F.col("rounds") > 1)).select("query_id", "rank", "item", (F.col("rounds") > 1).alias("retried"), "rounds")


def modality_weight(doc_type: Column) -> Column:
    out = F.lit(1.0)
    for kind, weight in MODALITY.items():
        out = F.when(doc_type == kind, weight).otherwise(out)
    return out


def weighted_rerank(ranked: DataFrame) -> DataFrame:
    weighted = ranked.withColumn("weighted", F.round(F.col("score") * modality_weight(F.col("doc_type")), 6))
    return weighted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weighted"), "vec_id")))


def rerank_head(ranked: DataFrame, raw_score: Column, head: int = 20) -> DataFrame:
    """The first ``head`` rows of each query by the sigmoid of a raw score, then the tail as it was."""
    front = F.col("rank") <= head
    scored = ranked.withColumn("reranked", F.when(front, F.round(sigmoid(raw_score), 6)))
    order = Window.partitionBy("query_id").orderBy(F.when(front, 0).otherwise(1), F.when(front, -F.col("reranked")).otherwise(F.col("rank")), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order))


def evidence_blocks(contexts: DataFrame) -> DataFrame:
    """``[i] 来源: … | 类型: … | chunk: … | page: … | heading: …`` and the whole content; empty places are left out."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    place = [part("chunk: ", F.col("chunk_id")), part("page: ", F.nullif(F.col("page").cast("string"), F.lit("0"))), part("heading: ", F.col("heading_path"))]
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 来源: "), F.coalesce("source", F.lit("")), F.lit(" | 类型: "), F.coalesce("retrieval_type", F.lit("")))
    return contexts.withColumn("block", F.concat(F.concat_ws(" | ", head, *place), F.lit("\n"), F.coalesce("content", F.lit(""))))


def context_key(chunk_id: Column, content: Column) -> Column:
    """Contexts of equal keys are one evidence: by chunk id, or without one by their content."""
    own = F.trim(F.coalesce(chunk_id, F.lit("")))
    return F.when(own != "", F.concat(F.lit("chunk:"), own)).otherwise(F.concat(F.lit("content:"), F.sha2(content_key(content), 256)))


def hybrid_fuse(contexts: DataFrame, top: int | None = None) -> DataFrame:
    """Contexts (query_id, list_id, pos, content, source, score, retrieval_type and, if at hand, chunk_id, page, heading_path,
    citations) of several lists fused: (query_id, rank, key, content, source, score, original_score, retrieval_type,
    citations). The payload is the first one seen and the original score the best of the list where it was seen first; the
    type is hybrid if types are mixed; citations are in order of sight. With ``top`` only what is among the first is put together.
    ``place`` is taken as in ``fuse``."""
    chunk = F.col("chunk_id") if "chunk_id" in contexts.columns else F.lit("")
    keyed = contexts.withColumn("item", context_key(chunk, F.coalesce("content", F.lit("")))).withColumn("citations", own_citation(contexts)).withColumn("at", F.struct("list_id", "pos"))
    fused = fuse(keyed.select("query_id", "list_id", "pos", "item", *(["place"] if "place" in contexts.columns else [])), top)
    if top:
        fused = settled(fused, "ranks")
        keyed = keyed.join(fused.select("query_id", "item"), ["query_id", "item"], "left_semi")
    cites = merged_citations(keyed, ["query_id", "item"], F.col("at"))
    kind = F.when(F.count_distinct("retrieval_type") > 1, "hybrid").otherwise(F.min("retrieval_type"))
    payload = keyed.groupBy("query_id", "item").agg(F.min_by("content", "at").alias("content"), F.min_by("source", "at").alias("source"), F.max_by("score", F.struct(-F.col("list_id"), F.col("score"))).alias("original_score"), kind.alias("retrieval_type"))
    out = fused.join(payload, ["query_id", "item"]).join(cites, ["query_id", "item"], "left")
    return out.select("query_id", "rank", F.col("item").alias("key"), "content", "source", "score", "original_score", "retrieval_type", F.coalesce("citations", F.array().cast(f"array<{CITATION}>")).alias("citations"))


#: Rewritten queries of a question, and results of each.
REWRITTEN, EACH = 3, 5


def by_embedding(index: vector_index.Index, embed: Callable[[Column], Column]) -> Callable[[DataFrame, int], DataFrame]:
    """A search of texts (key, text): (key, rank, vec_id, score), the k nearest of each. Equal texts are searched once, also those
    of several calls."""
    held: list[tuple[int, DataFrame, DataFrame]] = []
    name = F.coalesce(F.concat(F.lit("t"), "text"), F.lit(""))

    def search(asked: DataFrame, k: int) -> DataFrame:
        rows = asked.select("key", name.alias("named"), "text")
        new = rows.select("named", "text").distinct()
        for depth, known, _ in held:
            if depth >= k:
                new = new.join(known, "named", "left_anti")
        new = settled(new, "texts")
        if not new.isEmpty():
            if embed is embedding.embed:
                vectors = embedding.embed_rows(new, "named", "text", "query").withColumnRenamed("named", "query_id")
            else:
                vectors = new.select(F.col("named").alias("query_id"), embed(F.col("text")).alias("query"))
            depth = max(k, EACH)
            near = vector_index.nearest(index, vectors, depth)
            own = new.select("named")
            gone = own.withColumnRenamed("named", "query_id")  # a deeper search of a known text takes its place
            held[:] = [(d, known, found) if d >= k else (d, known.join(own, "named", "left_anti"), found.join(gone, "query_id", "left_anti")) for d, known, found in held]
            held.append((depth, own, near))
        found = None
        for _, _, near in held:
            found = near if found is None else found.unionByName(near)
        if found is None:
            found = vector_index.nearest(index, new.select(F.col("named").alias("query_id"), embed(F.col("text")).alias("query")), k)
        return rows.join(found.where(F.col("rank") <= k).withColumnRenamed("query_id", "named"), "named").select("key", "rank", "vec_id", "score")

    return search


def vector_contexts(index: vector_index.Index, chunks: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """What vectors say to questions (query_id, queries): (query_id, pos, chunk_id, content, source, score, retrieval_type, page,
    heading_path), the five nearest chunks of each of the first three queries that aren't blank, one query's after the
    other's. ``index`` is of the chunks' vectors by chunk_id; ``embed`` makes a vector of a query's text. ``search`` is a
    ``by_embedding`` of both that other searches share."""
    asked = questions.select("query_id", F.posexplode(clean_terms(F.col("queries"), REWRITTEN)).alias("place", "text"))
    asked = settled(asked.withColumn("key", F.concat_ws("\x1f", "query_id", "place")), "asked")
    near = (search or by_embedding(index, embed))(asked, EACH)
    value = lambda c, empty: (F.coalesce(c, F.lit(empty)) if c in chunks.columns else F.lit(empty)).alias(c)
    held = chunks.select("chunk_id", value("content", ""), value("source", "vector_store"), value("page", 0), value("heading_path", ""))
    rows = near.join(asked, "key").join(held, F.col("vec_id") == F.col("chunk_id"))
    return rows.select("query_id", (F.col("place") * EACH + F.col("rank")).alias("pos"), "chunk_id", "content", "source", "score", F.lit("vector").alias("retrieval_type"), "page", "heading_path")


def of_lists(vector: DataFrame, graph: DataFrame, lists: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``vector`` and ``graph`` with their places, ``graph`` by query: of each question's list (``lists``: query_id, list) the items at
    the first ``depth`` places, and those that the question's vectors found too.

    No other can be among the first ``depth`` of the fusion: an item of the graph alone has a smaller sum than each one before it
    there, or at equal rounded scores comes after it."""

    def placed(rows: DataFrame, by: str) -> DataFrame:
        first = rows.withColumn("#first", F.min("pos").over(Window.partitionBy(by, "item")))
        return first.withColumn("place", F.dense_rank().over(Window.partitionBy(by).orderBy("#first"))).drop("#first")

    content = F.coalesce("content", F.lit(""))
    held = settled(placed(graph.withColumn("item", context_key(F.lit(""), content)), "list"), "lists")
    own = settled(placed(vector.withColumn("item", context_key(F.col("chunk_id"), content)), "query_id"), "own")
    near = held.where(F.col("place") <= depth).join(lists, "list")
    met = held.where(F.col("place") > depth).join(own.select("query_id", "item").distinct().join(lists, "query_id"), ["list", "item"])
    return own.drop("item"), near.unionByName(met).drop("list", "item")


def retrieve(questions: DataFrame, vector: DataFrame, graph: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None, top: int = 8, head: int = 20, lists: DataFrame | None = None) -> DataFrame:
    """Hybrid retrieval of questions (query_id, question): contexts of vectors and of a graph (``paths.graph_contexts``), fused by
    ranks and reranked: (query_id, rank, key, content, source, score, original_score, retrieval_type, citations), ``top`` a
    query.

    ``rerank`` gives ``raw`` (query_id, key, raw) for rows (query_id, question, key, content), the first ``head`` of each
    query that has more than one; their scores become its sigmoids, and they are put in order by them before the others. A
    query for which any raw score is missing keeps its fused order, as if it had no reranker.

    With ``lists`` (query_id, list) the contexts of the graph are by list (``paths.graph_lists``), which many questions can share."""
    depth, place = top if rerank is None else max(top, head), []
    if lists is not None:
        (vector, graph), place = of_lists(vector, graph, lists, depth), ["place"]
    both = [df.select("query_id", F.lit(n).alias("list_id"), "pos", chunk.alias("chunk_id"), "content", "source", "score", "retrieval_type", own_citation(df).alias("citations"), *place) for n, df, chunk in ((1, vector, F.col("chunk_id")), (2, graph, F.lit("")))]
    fused = settled(hybrid_fuse(both[0].unionByName(both[1]), depth), "fused")
    return fused.where(F.col("rank") <= top) if rerank is None else reranked(fused, questions, rerank, top, head)


def reranked(fused: DataFrame, questions: DataFrame, rerank: Callable[[DataFrame], DataFrame], top: int = 8, head: int = 20) -> DataFrame:
    """The last step of ``retrieve``, on what ``hybrid_fuse`` gives."""
    front = fused.where(F.col("rank") <= head)
    several = front.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1")
    asked = front.join(several, "query_id").join(questions.select("query_id", "question"), "query_id")
    raw = settled(rerank(asked.select("query_id", "question", "key", "content")).select("query_id", "key", "raw"), "reranked")
    told = raw.where("raw IS NOT NULL").groupBy("query_id").agg(F.count_distinct("key").alias("told")).join(several, "query_id").where("told = n").select("query_id", F.lit(True).alias("whole"))
    scores = raw.groupBy("query_id", "key").agg(F.max("raw").alias("raw"))
    both = fused.join(scores, ["query_id", "key"], "left").join(told, "query_id", "left")
    judged = F.coalesce("whole", F.lit(False)) & (F.col("rank") <= head)
    scored = both.withColumn("score", F.when(judged, F.round(sigmoid(F.col("raw")), 6)).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.when(judged, 0).otherwise(1), F.when(judged, -F.col("score")), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(fused.columns)


def by_type_fused(contexts: DataFrame, top: int | None = None) -> DataFrame:
    """``hybrid_fuse`` of one list of contexts (query_id, pos, ...), taken apart by retrieval type: vector, graph, hybrid."""
    number = F.array_position(F.array(*map(F.lit, ("vector", "graph", "hybrid"))), F.col("retrieval_type"))
    return hybrid_fuse(contexts.withColumn("list_id", number.cast("int")).where("list_id > 0"), top)


def clean_terms(terms: Column, most: int) -> Column:
    """The first ``most`` terms that aren't blank, stripped."""
    return F.slice(F.filter(F.transform(terms, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != ""), 1, most)


#: Intents in the order in which a reply is searched for them. Fixed values.
INTENTS = ("factoid", "analytical", "comparative", "procedural", "exploratory")


def intent_of(reply: Column) -> Column:
    """The first intent that a reply names, else factoid."""
    out = F.lit(INTENTS[0])
    for name in reversed(INTENTS):
        out = F.when(F.lower(reply).contains(name), name).otherwise(out)
    return out


def source_payloads(contexts: DataFrame, registry: DataFrame) -> DataFrame:
    """What is shown of contexts (query_id if there are several queries, rank, content, source, score, retrieval_type and, if
    at hand, chunk_id, page, heading_path, citations): 500 characters, four places, the registered name of a source's file
    (of ``registry``: file_id, original_name, status) where it was taken in, and citations with names in the same way; a
    context without citations cites itself."""
    names = registry.where("status = 'success'").groupBy("file_id").agg(F.min("original_name").alias("original_name"))
    file = lambda c: F.regexp_extract(c, "([^/]*)/*$", 1)
    by = ["query_id", "rank"] if "query_id" in contexts.columns else ["rank"]
    rows = contexts.withColumn("citations", own_citation(contexts)).withColumn("file_id", file(F.col("source")))
    each = rows.select(*by, F.posexplode("citations").alias("k", "c")).withColumn("file_id", file(F.col("c.source"))).join(names, "file_id", "left")
    each = each.select(*by, "k", F.struct(F.coalesce("original_name", "c.source").alias("source"), F.col("c.chunk_id").alias("chunk_id"), F.col("c.page").alias("page"), F.col("c.heading_path").alias("heading_path")).cast(CITATION).alias("c"))
    cites = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("shown"))
    value = lambda c, empty: (F.coalesce(c, F.lit(empty)) if c in contexts.columns else F.lit(empty)).alias(c)
    named = rows.join(names, "file_id", "left").join(cites, by, "left")
    return named.select(*by[:-1], F.col("rank").alias("index"), F.substring(F.coalesce("content", F.lit("")), 1, 500).alias("content"), F.coalesce("original_name", "source").alias("source"), F.round("score", 4).alias("score"), F.col("retrieval_type").alias("type"), value("chunk_id", ""), value("page", 0), value("heading_path", ""), F.col("shown").alias("citations"))


def evidence_counts(contexts: DataFrame) -> DataFrame:
    """(query_id, vector, graph): evidence of each kind; hybrid counts for both."""
    n = lambda kind: F.count_if(F.col("retrieval_type").isin(kind, "hybrid"))
    return contexts.groupBy("query_id").agg(n("vector").alias("vector"), n("graph").alias("graph"))


#: What a chunk's payload holds, and what stands for nulls and absent columns.
PAYLOAD = {"chunk_id": None, "doc_id": None, "doc_type": None, "chunk_index": None, "source": "", "heading_path": "", "is_table": False, "is_image": False, "page": 0}


def payloads(chunks: DataFrame) -> DataFrame:
    """The payload columns of chunks, with defaults."""
    value = lambda c, d: F.col(c) if d is None else F.coalesce(c, F.lit(d)) if c in chunks.columns else F.lit(d)
    return chunks.select(*[value(c, d).alias(c) for c, d in PAYLOAD.items()])


def previews(contexts: DataFrame, chars: int = 200, numbered: bool = True, most: int = 5) -> DataFrame:
    """(query_id, preview): the first ``most`` contexts by rank, cut to ``chars``, as a prompt shows them (the feature's limits)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    shown = F.substring(F.coalesce("content", F.lit("")), 1, chars)
    shown = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), shown) if numbered else shown
    rows = contexts.withColumn("place", place).where(F.col("place") <= most).select("query_id", F.struct("place", shown.alias("shown")).alias("at"))
    return rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("at"))["shown"], "\n\n" if numbered else "\n").alias("preview"))


#: Weights of lists in the prototypes' order. Fixed values.
LISTS = {"vector": 1.0, "graph": 1.2}


def weighted_lists(contexts: DataFrame, top: int = 8) -> DataFrame:
    """Contexts (query_id, kind, pos, score, ...) by score times their list's weight, ``top`` a query; equal scores keep
    vectors first, then their order. Nothing is deduplicated."""
    weight = F.create_map(*[F.lit(v) for kv in LISTS.items() for v in kv])[F.col("kind")]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("kind"), "pos")
    return contexts.withColumn("score", F.col("score") * weight).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mean_confidence(ranked: DataFrame, clamped: bool = True) -> DataFrame:
    """(query_id, confidence): the mean of all scores, held to at most 1 if ``clamped``."""
    mean = F.avg("score")
    return ranked.groupBy("query_id").agg(F.round(F.least(mean, F.lit(1.0)) if clamped else mean, 6).alias("confidence"))


def results(questions: DataFrame, ranked: DataFrame, answer: Column, top: int = 8) -> DataFrame:
    """``questions`` (query_id, ...) with answer, contexts (structs by rank, ``top`` at most) and confidence; a question
    without contexts has an empty list and confidence 0. ``answer`` is a column of questions and contexts, such as a
    function of a model."""
    item = F.struct("rank", *[c for c in ranked.columns if c not in ("query_id", "rank")])
    found = ranked.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("contexts"))
    joined = questions.join(found, "query_id", "left").join(support(ranked), "query_id", "left")
    kind = found.schema["contexts"].dataType
    return joined.withColumn("contexts", F.coalesce("contexts", F.array().cast(kind))).withColumn("answer", answer).withColumn("confidence", F.coalesce("support", F.lit(0.0))).drop("support")
