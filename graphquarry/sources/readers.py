"""Files into rows: text, markdown blocks, tables of a DataFrame and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import doc_id, doc_type, lines, strip


def directory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """``text_files`` of a folder's files of some suffixes, all levels deep, in order of their paths."""
    return text_files(spark, folder, "*.{" + ",".join(suffixes) + "}").orderBy("path")


def write_lines(rows: DataFrame, folder: str) -> None:
    """``rows`` as JSON lines, nulls included, in as many files as there are partitions."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, doc_id, doc_type, text): whole files below a folder."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumns({"doc_id": doc_id(F.col("path")), "doc_type": doc_type(F.col("path"))})


def markdown_blocks(text: Column) -> Column:
    """Array of (kind, content, heading_path) of a markdown text: headings keep a stack, runs of ``|`` lines are tables,
    and blank lines are passed over without ending a paragraph."""
    empty = "array<struct<kind:string,content:string,heading_path:string>>"
    start = F.struct(F.array().cast(empty).alias("out"), F.lit("").alias("kind"), F.array().cast("array<string>").alias("buf"), F.array().cast("array<string>").alias("path"))

    def closed(a: Column) -> Column:
        block = F.struct(a["kind"].alias("kind"), F.array_join(a["buf"], "\n").alias("content"), F.array_join(a["path"], " / ").alias("heading_path"))
        return F.when(F.size(a["buf"]) > 0, F.array_append(a["out"], block)).otherwise(a["out"])

    def step(a: Column, raw: Column) -> Column:
        line = strip(raw)
        blank, heading, row = line == "", line.startswith("#"), line.startswith("|")
        level = F.char_length(F.regexp_extract(line, "^(#+)", 1))
        title = strip(F.regexp_replace(line, "^#+", ""))
        path = F.when(heading, F.concat(F.slice(a["path"], F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(title))).otherwise(a["path"])
        kind = F.when(heading, "heading").when(row, "table").otherwise("paragraph")
        same = ~heading & (kind == a["kind"]) & (F.size(a["buf"]) > 0)
        head = F.struct(F.lit("heading").alias("kind"), title.alias("content"), F.array_join(path, " / ").alias("heading_path"))
        out = F.when(same | blank, a["out"]).when(heading, F.array_append(closed(a), head)).otherwise(closed(a))
        buf = F.when(blank, a["buf"]).when(heading, F.array().cast("array<string>")).when(same, F.array_append(a["buf"], line)).otherwise(F.array(line))
        return F.struct(out.alias("out"), F.when(blank, a["kind"]).otherwise(kind).alias("kind"), buf.alias("buf"), F.when(blank, a["path"]).otherwise(path).alias("path"))

    return F.aggregate(lines(F.coalesce(text, F.lit(""))), start, step, closed)


def table_block(rows: DataFrame, by: str, order: str, columns: list[str], csv_compat: bool = False) -> DataFrame:
    """A markdown table per group. ``csv_compat`` writes a separator line after each header, as CSV scans do."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |"
    ruled = "| " + " | ".join(columns) + " |\n|---" * len(columns) if csv_compat else head + "\n|" + "---|" * len(columns)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(by).agg(F.concat_ws("\n", F.lit(ruled), F.array_join(ordered, "\n")).alias("content"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, golden_fragment, source_doc) of JSON lines; malformed and incomplete ones and repeated questions go."""
    schema = "question string, golden_fragment string, golden_chunk_content string, source_doc string"
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).select("at", F.from_json("value", schema).alias("j")).select("at", "j.*")
    rows = rows.withColumn("golden_fragment", F.coalesce(F.nullif("golden_fragment", F.lit("")), "golden_chunk_content"))
    rows = rows.where((F.coalesce("question", F.lit("")) != "") & (F.coalesce("golden_fragment", F.lit("")) != ""))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("at"))).where("n = 1")
    return first.select("question", "golden_fragment", F.coalesce("source_doc", F.lit("")).alias("source_doc"))
