"""Text primitives as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing sees it, and the line ends among it. Fixed values.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Its characters one by one.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Marks after which a sentence ends. Fixed values; the full stop isn't one.
SENTENCE_END = "。！？!?；;"
#: Relation types that a graph may hold; others are RELATED_TO. Fixed values.
RELATION_TYPES = ("BELONGS_TO", "WORKS_AT", "LOCATED_IN", "DEVELOPED_BY", "RELATED_TO", "PART_OF", "USES", "DEPENDS_ON")
#: Ends of organisation names that don't tell names apart, as patterns in any case. Fixed values.
ORG_ENDS = ("股份有限公司", "有限责任公司", "有限公司", "集团", "公司", "股份", "Corporation", r"Corp\.?", "Incorporated", r"Inc\.?", r"Ltd\.?", "LLC", r"Co\.?", r"S\.A\.", "GmbH", "AG")
ORG_SUFFIX = rf"(?i)({'|'.join(ORG_ENDS)})\s*$"
#: Extensions and the document types they stand for. Fixed values.
DOC_TYPES = {".pdf": "pdf", ".docx": "word", ".doc": "word", ".pptx": "ppt", ".ppt": "ppt", ".png": "image", ".jpg": "image", ".jpeg": "image", ".bmp": "image", ".csv": "table", ".xlsx": "table", ".xls": "table", ".txt": "text", ".md": "markdown"}


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(SPACES))


def lines(x: Column) -> Column:
    """Lines without their ends; a last empty line doesn't count."""
    parts = F.split(x, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def content_key(x: Column) -> Column:
    """White space collapsed and lower case: equal keys are the same evidence."""
    return F.lower(strip(F.regexp_replace(x, f"{SPACE}+", " ")))


def squeezed(x: Column) -> Column:
    """No white space, lower case."""
    return F.lower(F.regexp_replace(x, SPACE, ""))


def entity_key(x: Column) -> Column:
    return F.regexp_replace(squeezed(x), ORG_SUFFIX, "")


def relation_type(x: Column) -> Column:
    name = F.upper(F.regexp_replace(F.regexp_replace(strip(x), "[^0-9A-Za-z_]+", "_"), "^_+|_+$", ""))
    return F.when(name.isin(*RELATION_TYPES), name).otherwise("RELATED_TO")


def provenance(source: Column, chunk: Column) -> Column:
    return F.concat_ws("::", F.nullif(source, F.lit("")), F.nullif(chunk, F.lit("")))


def sentences(x: Column) -> Column:
    """Cut after sentence marks and the white space that follows them."""
    return F.split(x, rf"(?<=[{SENTENCE_END}])\s*")


def doc_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in DOC_TYPES.items() for v in kv])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))], F.lit("unknown"))


def doc_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat_ws("#chunk-", doc, index.cast("string"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def vector_id(name: Column) -> Column:
    """The version-5 UUID of a name in the URL name space."""
    space = bytes.fromhex("6ba7b8119dad11d180b400c04fd430c8")
    h = F.sha1(F.concat(F.lit(space), name.cast("binary")))
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def rpartition(x: Column, mark: str) -> Column:
    """Struct (head, tail) at the last ``mark``; without it all is head."""
    tail = F.substring_index(x, mark, -1)
    has = F.contains(x, F.lit(mark))
    head = F.substring(x, F.lit(1), F.char_length(x) - F.char_length(tail) - len(mark))
    return F.struct(F.when(has, head).otherwise(x).alias("head"), F.when(has, tail).otherwise("").alias("tail"))


def without_fence(x: Column) -> Column:
    """A reply without a code fence (and its language) around it."""
    return strip(F.regexp_replace(strip(x), r"^```[A-Za-z]*[ \t]*\r?\n?|\r?\n?```$", ""))


def data_url(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\r?\n", ""))


def iso_utc(at: Column) -> Column:
    """ISO-8601 text of a timestamp, in UTC by the session's zone."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
