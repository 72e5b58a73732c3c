"""Files of several kinds into blocks: a router over whole files, on executors, by the standard library's zip and XML.

Each file gives an array of blocks (kind, content, page, heading_path, is_table). A table file that can't be read gives
one text block that says so, as do a broken DOCX and PPTX, and ``parse_error`` is set, so that a change which failed to
parse can be told from an emptied file. PDF and image files need a plug-in: a function from bytes and path to blocks.
"""

from __future__ import annotations

import csv
import io
import os
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions.text import SENTENCE_END, content_key, doc_id, doc_type, strip
from ..operators.chunking import OVERLAP, PERCENTILE, SIZE, key_distances, meaning_pieces, pack_sections, semantic_chunks
from ..operators.vector_index import bounded_batches
from .folders import settled
from .readers import markdown_blocks

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: What a failed or an empty file says. Fixed values.
FAILED = {"table": "[表格解析失败] ", "word": "[DOCX 解析失败] ", "ppt": "[PPTX 解析失败] ", "pdf": "[PDF 解析失败] "}
EMPTY_CSV, EMPTY_BOOK, SHEET, SLIDE = "[空 CSV]", "[空 Excel]", "[工作表: {}]", "[Slide {}]"


def block(kind: str, content: str, page: int = 0, path: list[str] | None = None) -> dict:
    return {"kind": kind, "content": content, "page": page, "heading_path": " / ".join(path or []), "is_table": kind == "table"}


def line(cells) -> str:
    return "| " + " | ".join(cells) + " |"


def pushed_heading(path: list[str], title: str, size: float) -> list[str]:
    """The headings after one of a font size: 18 and more is the first level, 14.5 the second, 12 the third; a smaller one
    is no heading. For plug-ins that know sizes."""
    level = next((k for k, least in enumerate((18, 14.5, 12), 1) if size >= least), 0)
    return [*path[: level - 1], title] if level else list(path)


def csv_blocks(raw: bytes) -> list[dict]:
    """One table; a missing cell says None, and a separator line follows for every column."""
    rows = [r for r in csv.reader(io.StringIO(raw.decode("utf-8"), newline="")) if r]
    if len(rows) < 2:
        return [block("text", EMPTY_CSV)]
    head = rows[0]
    ruled = "| " + " | ".join(head) + " |\n|---" * len(head)
    place = {name: k for k, name in enumerate(head)}
    body = [line(r[place[name]] if place[name] < len(r) else "None" for name in head) for r in rows[1:]]
    return [block("table", "\n".join([ruled, *body]))]


def rows_of_sheet(tree, shared: list[str]) -> list[list[str]]:
    out = []
    for row in tree.iter(f"{S}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{S}c"):
            letters = re.match("[A-Z]+", c.get("r") or "")
            at = len(cells) if not letters else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1
            value = c.findtext(f"{S}v")
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{S}t"))
            elif c.get("t") == "b" and value is not None:
                value = str(value == "1")
            cells[at] = value if value is not None else ""
        out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


def xlsx_blocks(raw: bytes) -> list[dict]:
    """A table for each sheet that has rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = targets[sheet.get(f"{R}id")]
            rows = rows_of_sheet(ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target))), shared)
            if rows:
                ruled = "|---" * len(rows[0])
                out.append(block("table", "\n".join([SHEET.format(sheet.get("name")), line(rows[0]), ruled, *map(line, rows[1:])])))
    return out or [block("text", EMPTY_BOOK)]


def docx_blocks(raw: bytes) -> list[dict]:
    """Paragraphs and headings in order, then all tables. A heading's level is the number in its style's name, 2 without one
    or beyond 3."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId")] = (name.get(f"{W}val") if name is not None else "").lower()
    said = lambda x: "".join((t.text or "") if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in x.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))
    out, path = [], []
    for p in body.findall(f"{W}p"):
        text = said(p).strip()
        style = p.find(f"{W}pPr/{W}pStyle")
        style = styles.get(style.get(f"{W}val"), style.get(f"{W}val").lower()) if style is not None else ""
        if text and ("heading" in style or "标题" in style):
            found = re.search(r"\d+", style)
            level = int(found[0]) if found and int(found[0]) in (1, 2, 3) else 2
            path = [*path[: level - 1], text]
            out.append(block("heading", text, path=path))
        elif text:
            out.append(block("paragraph", text, path=path))
    for table in body.findall(f"{W}tbl"):
        rows = [line("\n".join(said(p) for p in c.findall(f"{W}p")).strip() for c in r.findall(f"{W}tc")) for r in table.findall(f"{W}tr")]
        if rows:
            out.append(block("table", "\n".join(rows)))
    return out


def pptx_blocks(raw: bytes) -> list[dict]:
    """A paragraph for each slide with text, in the order of the slides' numbers."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for page, (_, name) in enumerate(slides, 1):
            texts = []
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if shape.tag == f"{P}sp":
                    texts += [t for p in shape.iter(f"{A}p") if (t := "".join(x.text or "" for x in p.iter(f"{A}t")).strip())]
                elif shape.tag == f"{A}tbl":
                    texts += [" | ".join("".join(x.text or "" for x in c.iter(f"{A}t")).strip() for c in r.findall(f"{A}tc")) for r in shape.findall(f"{A}tr")]
            if texts:
                out.append(block("paragraph", "\n".join([SLIDE.format(page), *texts]), page))
    return out


READERS = {"word": docx_blocks, "ppt": pptx_blocks}
FIELDS = [pa.field("kind", pa.string()), pa.field("content", pa.string()), pa.field("page", pa.int32()), pa.field("heading_path", pa.string()), pa.field("is_table", pa.bool_())]
BLOCKS = "array<struct<kind:string,content:string,page:int,heading_path:string,is_table:boolean>>"


def file_blocks(path: str, kind: str, raw: bytes, plug_ins: dict[str, Callable[[bytes, str], list[dict]]]) -> tuple[list[dict], str | None]:
    """(blocks, error) of one file that isn't markdown."""
    try:
        if kind in plug_ins:
            return plug_ins[kind](raw, path), None
        if kind == "table":
            return (csv_blocks if os.path.splitext(path)[1].lower() == ".csv" else xlsx_blocks)(raw), None
        if kind in READERS:
            found = READERS[kind](raw)
            return (found, None) if found else ([block("text", FAILED[kind] + path)], "empty")
        if kind in ("pdf", "image"):
            raise ValueError(f"no plug-in reads {kind} files")
        return [block("text", raw.decode("utf-8"))], None
    except Exception as x:  # a file's fault stays its own: it is told in parse_error
        return ([block("text", FAILED[kind] + path)] if kind in FAILED else []), f"{type(x).__name__}: {x}"[:300]


def parse_files(spark: SparkSession, folder: str, glob: str | None = None, plug_ins: dict | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, doc_id, doc_type, sha, blocks, parse_error) of each file below a folder; larger files than ``most_bytes``, if
    given, are left out, and files of no bytes have no row, as the reader skips them. Files are dealt over tasks by the reader; a batch holds few of them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    files = files.where(F.col("length") <= most_bytes) if most_bytes else files
    rows = files.select("path", doc_type(F.col("path")).alias("kind"), F.sha2("content", 256).alias("sha"), "content")
    plugs = dict(plug_ins or {})

    def run(batches):
        for batch in batches:
            for one in (batch.slice(k, 1) for k in range(batch.num_rows)):
                path, kind, sha, raw = (c[0].as_py() for c in one.columns)
                if kind == "markdown":
                    try:
                        blocks, error, text = None, None, raw.decode("utf-8")
                    except UnicodeDecodeError as x:
                        blocks, error, text = [], f"{type(x).__name__}: {x}"[:300], None
                else:
                    (blocks, error), text = file_blocks(path, kind, raw, plugs), None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), pa.array([sha]), pa.array([text], pa.string()), pa.array([blocks], pa.list_(pa.struct(FIELDS))), pa.array([error], pa.string())], ["path", "kind", "sha", "text", "found", "parse_error"])

    out = rows.mapInArrow(run, f"path string, kind string, sha string, text string, found {BLOCKS}, parse_error string")
    own = F.transform(markdown_blocks(F.col("text")), lambda b: F.struct(b["kind"].alias("kind"), b["content"].alias("content"), F.lit(0).alias("page"), b["heading_path"].alias("heading_path"), (b["kind"] == "table").alias("is_table")))
    return out.select("path", doc_id(F.col("path")).alias("doc_id"), F.col("kind").alias("doc_type"), "sha", F.coalesce("found", own).alias("blocks"), "parse_error")


def merged_blocks(blocks: Column, least: int = 60) -> Column:
    """Blocks that aren't headings or tables join the paragraph before while that is shorter than ``least``."""
    fields = ("kind", "content", "page", "heading_path", "is_table")

    def step(out, b):
        last = F.try_element_at(out, F.lit(-1))
        short = F.coalesce((last["kind"] == "paragraph") & (F.char_length(last["content"]) < least), F.lit(False))
        joins = (b["kind"] != "heading") & ~b["is_table"] & short
        longer = F.struct(*[(F.concat(last["content"], F.lit("\n"), b["content"]) if f == "content" else last[f]).alias(f) for f in fields])
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.array_append(out, F.struct(*[b[f].alias(f) for f in fields])))

    return F.aggregate(blocks, F.array().cast(BLOCKS), step)


def block_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, doc_type, chunk_id, chunk_index, content, source, page, heading_path, is_table): parsed files into chunks.
    Small blocks are merged, tables and short blocks stay whole, long ones are cut by sections and sentences; blank
    chunks are dropped after numbering."""
    pieces = F.flatten(F.transform(merged_blocks(F.col("blocks")), lambda b: by_structure(b, size, overlap)))
    return numbered(docs.select("doc_id", "doc_type", F.col("path").alias("source"), pieces.alias("pieces")))


def placed(contents: Column, b: Column) -> Column:
    """Pieces (content, page, heading_path, is_table) of a block."""
    return F.transform(contents, lambda c: F.struct(c.alias("content"), b["page"].alias("page"), b["heading_path"].alias("heading_path"), b["is_table"].alias("is_table")))


def by_structure(b: Column, size: int, overlap: int) -> Column:
    return placed(F.when(b["is_table"] | (F.char_length(b["content"]) <= size), F.array(b["content"])).otherwise(pack_sections(b["content"], size, overlap)), b)


def numbered(docs: DataFrame) -> DataFrame:
    """A row for each of ``pieces`` that isn't blank."""
    rows = docs.select("doc_id", "doc_type", "source", F.posexplode("pieces").alias("chunk_index", "p")).withColumn("content", strip(F.col("p.content"))).where("content <> ''")
    return rows.select("doc_id", "doc_type", F.concat_ws("#chunk-", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", "content", "source", "p.page", "p.heading_path", "p.is_table")


def chunk_documents(docs: DataFrame, embed: Callable[[Column], Column] | None = None, size: int = SIZE, overlap: int = OVERLAP, percentile: float = PERCENTILE) -> DataFrame:
    """``block_chunks`` with cuts where meaning changes, for documents of which some piece then has over 20 characters; the others,
    and all without ``embed``, are cut by their structure.

    Small blocks are merged and tables stay whole. Another block is cut into sentences (by their marks and line ends); with
    one or none it stays, or is cut by ``pack_sections`` if it is long; else its sentences are packed up to boundaries of
    their vectors, which ``embed`` makes of a sentence's text. Pieces are numbered in order, then blank ones are dropped. With the
    default embedding each document is cut where it stands, without a shuffle."""
    if embed is None:
        return block_chunks(docs, size, overlap)
    if embed is embedding.embed:
        return meaning_chunks(docs, size, overlap, percentile)
    blocks = docs.select("doc_id", F.posexplode(merged_blocks(F.col("blocks"))).alias("block", "b"))
    blocks = settled(blocks.withColumn("key", F.concat_ws("\x1f", "doc_id", "block")), "blocks")
    text = F.col("b.content")
    said = said_in(text)
    plain = blocks.where("NOT b.is_table").select("key", text.alias("text"), said.alias("said"))
    few = plain.where(F.size("said") < 2).select("key", F.posexplode(F.when(F.char_length("text") > size, pack_sections(F.col("text"), size, overlap)).otherwise(F.array("text"))).alias("piece", "content"))
    sentences = plain.where(F.size("said") > 1).select(F.col("key").alias("doc_id"), F.posexplode("said").alias("pos", "sentence"))
    many = semantic_chunks(sentences.withColumn("embedding", embed(F.col("sentence"))), size, overlap, percentile)
    many = many.select(F.col("doc_id").alias("key"), F.col("chunk_index").alias("piece"), "content")
    tables = blocks.where("b.is_table").select("key", F.lit(0).alias("piece"), text.alias("content"))
    pieces = settled(tables.unionByName(few).unionByName(many).join(blocks.select("key", "doc_id", "block", "b.page", "b.heading_path", "b.is_table"), "key"), "pieces")
    told = settled(pieces.where(F.char_length("content") > 20).select("doc_id").distinct(), "told")
    order = Window.partitionBy("doc_id").orderBy("block", "piece")
    named = docs.select("doc_id", "doc_type", F.col("path").alias("source"))
    rows = pieces.join(told, "doc_id", "left_semi").withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("content", strip(F.col("content"))).where("content <> ''").join(named, "doc_id")
    out = rows.select("doc_id", "doc_type", F.concat_ws("#chunk-", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", "content", "source", "page", "heading_path", "is_table")
    return out.unionByName(block_chunks(docs.join(told, "doc_id", "left_anti"), size, overlap))


def said_in(text: Column) -> Column:
    """A text's sentences by their marks and line ends, stripped, without blank ones. Line ends are put after marks and the text
    is cut there, which takes a twentieth of the time of a pattern."""
    for mark in SENTENCE_END:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark}\n"))
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def meaning_chunks(docs: DataFrame, size: int, overlap: int, percentile: float) -> DataFrame:
    """``chunk_documents`` with the default embedding, each document in its own row: the JVM makes its sentences' keys, numpy
    hashes and compares them, and the JVM cuts long pieces."""
    bounded_batches(docs.sparkSession)
    names = ("content", "page", "heading_path", "is_table")
    own = lambda b: [b[f].alias(f) for f in names]
    rows = docs.select("doc_id", "doc_type", F.col("path").alias("source"), merged_blocks(F.col("blocks")).alias("blocks")).where("blocks IS NOT NULL")
    rows = rows.withColumn("blocks", F.transform("blocks", lambda b: F.struct(*own(b), F.when(~b["is_table"], said_in(b["content"])).alias("said"))))
    rows = rows.withColumn("blocks", F.transform("blocks", lambda b: F.struct(*own(b), b["said"].alias("said"), F.when(F.size(b["said"]) > 1, F.transform(b["said"], content_key)).alias("keys"))))

    def run(batches):
        for batch in batches:
            blocks = batch.column(3)
            each = blocks.flatten()
            said, keys = each.field("said"), each.field("keys")
            between, at, cut = key_distances(keys.flatten()), 0, [None] * len(each)
            for i, n in enumerate(keys.value_lengths().to_pylist()):
                if n:
                    cut[i] = meaning_pieces(said[i].as_py(), between[at : at + n - 1], size, percentile)
                    at += n
            held = pa.StructArray.from_arrays([*(each.field(f) for f in names), pa.array(cut, pa.list_(pa.string()))], [*names, "cut"])
            starts = pa.array([0, *blocks.value_lengths().to_numpy().cumsum().tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(starts, held)], ["doc_id", "doc_type", "source", "blocks"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "doc_type", "source"))
    cut = rows.mapInArrow(run, f"{kinds}, blocks array<struct<content:string,page:int,heading_path:string,is_table:boolean,cut:array<string>>>")

    def by_meaning(b: Column) -> Column:
        short = lambda c: F.when(F.char_length(c) > size, pack_sections(c, size, overlap)).otherwise(F.array(c))
        many = F.filter(F.flatten(F.transform(b["cut"], short)), lambda c: strip(c) != "")
        none = F.array().cast("array<string>")
        return placed(F.when(b["is_table"], F.array(b["content"])).when(b["cut"].isNotNull(), many).when(~b["is_table"] & b["content"].isNotNull(), short(b["content"])).otherwise(none), b)

    cut = cut.withColumn("pieces", F.flatten(F.transform("blocks", by_meaning)))
    told = F.exists("pieces", lambda p: F.coalesce(F.char_length(p["content"]) > 20, F.lit(False)))
    whole = F.flatten(F.transform("blocks", lambda b: by_structure(b, size, overlap)))
    return numbered(cut.select("doc_id", "doc_type", "source", F.when(told, F.col("pieces")).otherwise(whole).alias("pieces")))
