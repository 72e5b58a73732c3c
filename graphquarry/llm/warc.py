"""WARC archives with a two-level capture index.

Pages are dealt by ranges of their reversed-host key and written in key order: a gzip member per record, so that any
record is one range read. Beside each archive stand compressed blocks of index lines (key, place, length), and a sparse
directory (a row per block: first and last key, place) is returned as a table, never gathered. A look-up searches each
part of the directory by halves, reads one block, searches that by halves, and reads the record by its place.

Of records with equal payloads the one with the largest page_id is a response and the others are revisits that refer to
it. A null html is an empty payload. Rows that repeat a page_id are written each; of equal payloads all rows with the
largest page_id are responses. A null page_id counts as smaller than any; where equal payloads have no other, all are
responses. A null url has the empty key. Other columns are left out. Files count only through the directory of the task
attempt that succeeded.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, map_arrow, written

#: A block closes at so many lines, or when its records have so many bytes.
BLOCK_LINES, BLOCK_BYTES = 1000, 8_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: str) -> Column:
    """``com,example)/path?query`` of ``http://example.com/path?query``; text without a scheme and host is its own key. White space and controls are written as %20."""
    u = F.coalesce(F.col(url), F.lit(""))
    match = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)(?::(\d*))?(.*)$"
    host, port, rest = (F.regexp_extract(u, match, k) for k in (1, 2, 3))
    turned = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    own = F.concat(turned, F.when((port != "") & ~port.isin("80", "443"), F.concat(F.lit(":"), port)).otherwise(""), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.regexp_replace(F.when(host == "", u).otherwise(own), r"[\x00-\x20\x7f]", "%20")


def header_value(x) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit keeps the headers of its response and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzipped(raw: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parsed(raw: bytes) -> dict:
    """What a record (as stored) says: page_id, url, type, refers_to, payload, payload_bytes, payload_digest."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: None if x == "None" else int(x)
    number = lambda name: page(fields[name][len("<urn:page:") : -1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    out = {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "refers_to": None, "payload": None}
    if out["type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return out | {"refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": stated}
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated:
        raise ValueError(f"payload digest of page {out['page_id']} is {digest}, stated {stated}")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of rows whose payload another page_id answers. Only hashes are shuffled; counted before dealing."""
    own = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("size")).where(F.col("size") >= least)
    first = own.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count("*").alias("n"), F.count("page_id").alias("known"))
    first = first.where((F.col("low") < F.col("refers_to")) | ((F.col("known") < F.col("n")) & (F.col("known") > 0))).select("sha", "refers_to")
    return own.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes a record for each row and gives the directory: first_key, last_key, archive, index, offset, length, lines."""
    spark, folder = pages.sparkSession, folder or fresh_path(pages.sparkSession, "warc")
    key, sha = reversed_host_key("url"), F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select(key.alias("key"), "page_id", sha.alias("sha"), F.lit(1).alias("page"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"))
    # a notice that a payload is answered elsewhere stands right before its record, so html is dealt out once
    notices = pages.select(key.alias("key"), "page_id", sha.alias("sha")).distinct().withColumnsRenamed({"page_id": "p", "sha": "s"}).join(revisits(pages, least), F.col("p").eqNullSafe(F.col("page_id")) & (F.col("s") == F.col("sha")))
    notices = notices.select("key", "page_id", "sha", F.lit(0).alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "refers_to")
    order = ("key", "page_id", "sha", "page")
    rows = rows.unionByName(notices).repartitionByRange("key", "page_id").sortWithinPartitions(*order).select(*order, "url", "html", "refers_to")

    def run(batches):
        fs, inner = filesystem(folder)
        fs.create_dir(inner, recursive=True)
        name, out, index, notice = uuid.uuid4().hex[:16], None, None, None
        lines, held, place, found = [], 0, 0, []

        def close():
            nonlocal lines, held
            raw = zlib.compress("".join(f"{k}\t{p}\t{n}\n" for k, p, n in lines).encode(), 6)
            found.append((lines[0][0], lines[-1][0], f"{folder}/{name}.warc.gz", f"{folder}/{name}.cdx", index.tell(), len(raw), len(lines)))
            index.write(raw)
            lines, held = [], 0

        for batch in batches:
            if out is None:
                out, index = fs.open_output_stream(f"{inner}/{name}.warc.gz", compression=None), fs.open_output_stream(f"{inner}/{name}.cdx", compression=None)
            for key, page_id, sha, page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if not page:
                    notice = (key, page_id, sha), refers_to
                    continue
                raw = gzipped(record(page_id, url, html, notice[1] if notice and notice[0] == (key, page_id, sha) else None))
                out.write(raw)
                lines.append((key, place, len(raw)))
                place, held = place + len(raw), held + len(raw)
                if len(lines) >= BLOCK_LINES or held >= BLOCK_BYTES:
                    close()
        if out is not None:
            if lines:
                close()
            out.close()
            index.close()
        names = ["first_key", "last_key", "archive", "index", "offset", "length", "lines"]
        kinds = [pa.string()] * 4 + [pa.int64()] * 3
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    schema = "first_key string, last_key string, archive string, index string, offset long, length long, lines long"
    return written(map_arrow(rows, run, schema), "warc-directory")


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
KINDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}


def captures(found: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r["type" if n == "record_type" else n] for r in found], KINDS.get(n, pa.string())) for n in names], names)


def block_lines(fs, index: str, offset: int, length: int) -> list[tuple[str, int, int]]:
    with fs.open_input_file(index) as f:
        raw = zlib.decompress(f.read_at(length, offset))
    return [(k, int(p), int(n)) for k, p, n in (x.rsplit("\t", 2) for x in raw.decode().split("\n")[:-1])]


def read_archives(directory: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record through the index: a block of lines, then the records that it names, in one range read."""

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                fs, index = filesystem(x["index"])
                lines = block_lines(fs, index, x["offset"], x["length"])
                first, end = lines[0][1], lines[-1][1] + lines[-1][2]
                with fs.open_input_file(filesystem(x["archive"])[1]) as f:
                    raw = f.read_at(end - first, first)
                found = [parsed(raw[p - first : p - first + n]) for _, p, n in lines]
                yield captures(found, [*COLUMNS, *["payload"] * with_payload])

    blocks = max(1, directory.count())
    schema = SCHEMA + ", payload binary" * with_payload
    tasks = min(blocks, 4 * directory.sparkSession.sparkContext.defaultParallelism)
    return map_arrow(directory.repartition(max(tasks, blocks // 64)), run, schema)


def lookup(directory: DataFrame, keys: list[str]) -> DataFrame:
    """All captures of some reversed-host keys, as ``read_archives`` gives them, with their key."""
    asked = sorted(set(keys))
    some = directory.where(F.exists(F.lit(asked or [""]), lambda k: (F.col("first_key") <= k) & (F.col("last_key") >= k)))

    def run(batches):
        for batch in batches:
            blocks = sorted(batch.to_pylist(), key=lambda b: (b["last_key"], b["first_key"]))
            last, out = [b["last_key"] for b in blocks], []
            for key in asked:
                for block in blocks[bisect.bisect_left(last, key) :]:
                    if block["first_key"] > key:
                        continue
                    fs, index = filesystem(block["index"])
                    lines = block_lines(fs, index, block["offset"], block["length"])
                    at = bisect.bisect_left(lines, (key,))
                    with fs.open_input_file(filesystem(block["archive"])[1]) as f:
                        while at < len(lines) and lines[at][0] == key:
                            out.append({"key": key} | parsed(f.read_at(lines[at][2], lines[at][1])))
                            at += 1
            yield captures(out, ["key", *COLUMNS, "payload"])

    return map_arrow(some, run, f"key string, {SCHEMA}, payload binary")
