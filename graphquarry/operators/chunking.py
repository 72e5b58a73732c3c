"""Fixed windows, sentence packing and question synthesis; folds stay in the JVM."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import key_vectors
from ..functions.text import SENTENCE_END, sentences, strip
from ..functions.vector import dot

SIZE, OVERLAP, PERCENTILE = 512, 64, 85
#: What stands around the topic of a question, and marks of a sentence that states something. Fixed values.
QUESTION = ('文档中提到"', '……"，具体内容是什么？')
DENSE = "0-9０-９,，、《》%％"


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, tail: bool = False) -> DataFrame:
    """Windows of ``size`` at a stride of size - overlap, stripped, without blank ones, which aren't numbered either; the
    window that reaches the end is the last, unless ``tail``. ``start`` is the window's place before it is stripped."""
    stride = size - overlap
    n = F.char_length("text")
    last = n - 1 if tail else F.greatest(n - 1 - overlap, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.struct(i.alias("start"), strip(F.substring("text", i + 1, F.lit(size))).alias("content")))
    cut = docs.where(n > 0).select("doc_id", F.posexplode(F.filter(pieces, lambda p: p["content"] != "")).alias("chunk_index", "p"))
    return cut.select("doc_id", "chunk_index", "p.start", "p.content")


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).where("sentence <> ''")


def hard_cut(x: Column, size: int, overlap: int) -> Column:
    stride = size - overlap
    return F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(x) - 1, F.lit(0)), F.lit(stride)), lambda i: F.substring(x, i + 1, F.lit(size)))


def pack_sentences(x: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences packed greedily up to ``size``; a longer sentence is cut at a stride."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        flushed = F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
        long, fits = F.char_length(s) > size, F.char_length(acc["buf"]) + F.char_length(s) <= size
        out = F.when(long, F.concat(flushed, hard_cut(s, size, overlap))).when(fits, acc["out"]).otherwise(flushed)
        buf = F.when(long, F.lit("")).when(fits, F.concat(acc["buf"], s)).otherwise(s)
        return F.struct(out.alias("out"), buf.alias("buf"))

    return F.aggregate(F.filter(sentences(x), lambda s: strip(s) != ""), start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))


def pack_sections(x: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Pieces of a text: sections between blank lines, long ones by sentences, packed with line breaks up to ``size`` (a
    sentence piece may exceed it by the break). A text of white space alone gives its first ``size`` characters."""
    sections = F.filter(F.transform(F.split(x, "\n\n"), strip), lambda s: s != "")
    whole = lambda s: F.array(F.struct(s.alias("piece"), F.lit(1).alias("gap")))
    cut = lambda s: F.transform(pack_sentences(s, size, overlap), lambda t: F.struct(t.alias("piece"), F.lit(0).alias("gap")))
    units = F.flatten(F.transform(sections, lambda s: F.when(F.char_length(s) > size, cut(s)).otherwise(whole(s))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, unit: Column) -> Column:
        buf, piece = acc["buf"], unit["piece"]
        joined = F.concat(buf, F.lit("\n"), piece)
        fits = F.char_length(buf) + F.char_length(piece) + unit["gap"] <= size
        out = F.when((buf == "") | fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(buf)))
        held = F.when((buf == "") | ~fits, piece).when(unit["gap"] == 1, strip(joined)).otherwise(joined)
        return F.struct(out.alias("out"), held.alias("buf"))

    pieces = F.aggregate(units, start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))
    return F.when(F.size(units) == 0, F.array(F.substring(x, 1, size))).otherwise(pieces)


def structural_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Short texts whole, long ones by sections and sentences; blank chunks are dropped after numbering, so indexes may skip."""
    text = F.col("text")
    pieces = F.when(F.char_length(text) <= size, F.array(text)).otherwise(pack_sections(text, size, overlap))
    cut = docs.where(text.isNotNull()).select("doc_id", F.posexplode(pieces).alias("chunk_index", "content"))
    return cut.where(strip(F.col("content")) != "")


def semantic_distances(rows: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """(doc_id, pos, distance, boundary) between each sentence and the next of its document, by rows (doc_id, pos,
    embedding). A boundary is at or above the document's nearest-rank percentile (halves to even). Zero vectors are at
    distance 0. A document of one sentence has no rows."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    sized = rows.select("doc_id", "pos", F.col("embedding").alias("here")).withColumn("size", dot(F.col("here"), F.col("here")))
    pairs = sized.withColumn("next", F.lead(F.struct("here", "size")).over(order)).where(F.col("next.here").isNotNull())
    zero, both = (F.col("size") == 0) | (F.col("next.size") == 0), F.sqrt("size") * F.sqrt("next.size")
    distances = pairs.select("doc_id", "pos", F.when(zero | (both == 0), F.when(zero, 0.0).otherwise(1.0)).otherwise(F.round(1 - dot(F.col("here"), F.col("next.here")) / both, 6)).alias("distance"))
    share = max(0.0, min(float(percentile), 100.0)) / 100.0
    own = Window.partitionBy("doc_id")
    placed = distances.withColumn("r", F.row_number().over(own.orderBy("distance", "pos"))).withColumn("n", F.count("*").over(own))
    at = F.bround(F.lit(share) * (F.col("n") - 1), 0).cast("int") + 1
    least = F.max(F.when(F.col("r") == at, F.col("distance"))).over(own)
    return placed.withColumn("boundary", F.col("distance") >= least).select("doc_id", "pos", "distance", "boundary")


def semantic_chunks(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP, percentile: float = PERCENTILE, embedded: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_index, content): sentences (doc_id, pos, sentence, embedding) joined without a separator, cut after
    boundaries once a piece has max(60, size/4) characters, and before it would exceed ``size``. ``embedded`` (doc_id, pos,
    embedding) can hold the vectors instead."""
    least = max(60, size // 4)
    marks = semantic_distances(rows if embedded is None else embedded, percentile).select("doc_id", F.col("pos").alias("p"), "boundary")
    cut_before = F.lag("boundary").over(Window.partitionBy("doc_id").orderBy("pos"))
    marked = rows.select("doc_id", "pos", "sentence").join(marks.withColumnsRenamed({"doc_id": "d"}), (F.col("doc_id") == F.col("d")) & (F.col("pos") == F.col("p")), "left")
    marked = marked.select("doc_id", "pos", "sentence", F.coalesce(cut_before, F.lit(False)).alias("cut"))
    lists = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "cut"))).alias("sentences"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        n = F.char_length(acc["buf"])
        new = (n > 0) & ((s["cut"] & (n >= least)) | (n + F.char_length(s["sentence"]) > size))
        out = F.when(new, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(new, s["sentence"]).otherwise(F.concat(acc["buf"], s["sentence"])).alias("buf"))

    packed = F.aggregate("sentences", start, step, lambda a: F.concat(a["out"], F.array(a["buf"])))
    pieces = F.flatten(F.transform(packed, lambda x: F.when(F.char_length(x) > size, pack_sections(x, size, overlap)).otherwise(F.array(x))))
    return lists.select("doc_id", F.posexplode(pieces).alias("chunk_index", "content")).where(strip(F.col("content")) != "")


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, ties away from zero by a number's shortest text, as Spark rounds."""
    out = np.round(x, 6) + 0.0
    near = np.abs(np.abs(x * 1e6 - np.floor(x * 1e6)) - 0.5) < 1e-4
    out[near] = [float(Decimal(repr(float(v))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0 for v in x[near]]
    return out


#: Texts whose vectors are held at once.
HELD = 16_384


def key_distances(keys: pa.Array) -> np.ndarray:
    """The distances of ``semantic_distances`` between each text and the next, by their keys and the default embedding."""
    out = np.zeros(max(0, len(keys) - 1))
    for at in range(0, len(out), HELD):
        x = key_vectors(keys.slice(at, HELD + 1))
        size, dots = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", x[:-1], x[1:])
        both = np.sqrt(size[:-1]) * np.sqrt(size[1:])
        out[at : at + len(dots)] = np.where(both == 0, 0.0, rounded(1 - np.divide(dots, both, out=np.zeros_like(dots), where=both > 0)))
    return out


def meaning_pieces(said: list[str], distances: np.ndarray, size: int = SIZE, percentile: float = PERCENTILE) -> list[str]:
    """The pieces that ``semantic_chunks`` makes of one document before long ones are cut, by its sentences and the distance of
    each to the next."""
    share = max(0.0, min(float(percentile), 100.0)) / 100.0
    cut = distances >= np.sort(distances)[round(share * (len(distances) - 1))]
    least, out, buf, n = max(60, size // 4), [], [said[0]], len(said[0])
    for s, ends in zip(said[1:], cut.tolist()):
        if ends and n >= least or n + len(s) > size:
            out.append("".join(buf))
            buf, n = [], 0
        buf.append(s)
        n += len(s)
    return [*out, "".join(buf)]


def core_sentences(docs: DataFrame, least: int = 12, most: int = 80) -> DataFrame:
    """(doc_id, pos, sentence, score): sentences of a fitting length; 1 for digits or marks of a statement, 0.5 for a full-width comma.

    A line break is put after each mark and the text is cut there, which takes a twentieth of the time of a pattern for sentences."""
    marked = F.col("text")
    for mark in SENTENCE_END:
        marked = F.replace(marked, F.lit(mark), F.lit(f"{mark}\n"))
    pieces = F.filter(F.split(marked, "\n"), lambda p: ~p.isin("", *SENTENCE_END))
    found = docs.select("doc_id", F.posexplode(pieces).alias("pos", "raw"))
    found = found.withColumn("sentence", strip(F.col("raw"))).where(F.char_length("sentence").between(least, most))
    score = F.when(F.col("sentence").rlike(f"[{DENSE}]"), 1.0).otherwise(0.0) + F.when(F.col("sentence").contains("，"), 0.5).otherwise(0.0)
    return found.select("doc_id", "pos", "sentence", score.alias("score"))


def synthesized_questions(docs: DataFrame, top: int = 2) -> DataFrame:
    """(doc_id, rank, topic, question, golden_fragment): a question for each best sentence, about the whole of a short one, else
    about ten characters from a third on."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    best = core_sentences(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = F.char_length("sentence")
    topic = F.when(n <= 24, F.col("sentence")).otherwise(F.substring("sentence", F.floor(n / 3).cast("int") + 1, F.lit(10)))
    question = F.concat(F.lit(QUESTION[0]), topic, F.lit(QUESTION[1]))
    return best.select("doc_id", "rank", topic.alias("topic"), question.alias("question"), F.col("sentence").alias("golden_fragment"))
