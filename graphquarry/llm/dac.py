"""Token-id files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, level k the chunk k of the ids
that have one; a level's bitmap says which of its ids go on, and a rank directory (ones before every 512th bit) turns a
place of a level into the place of the next. So any token is read without decoding what stands before it.

A file holds whole documents in ascending key order: magic, JSON header (levels, directories), then the arrays. Files
get a new name at each attempt and count only through the manifest of the attempt that succeeded, so a lost executor
leaves at most files that nobody reads. Null and empty texts are stored as the end id alone; rows that repeat a key are
stored one after the other, by text; null keys come first. Other columns are left out.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ChunkStore
from .common import filesystem, fresh_path, map_arrow, utf8, written

MAGIC = b"DAC1"
STEP = 512
#: Ids after which a writer begins a new file.
FILE_IDS = 4_000_000
#: Chunks kept by a worker; see ChunkStore.
KEPT = 1_300_000


def pack(ids: np.ndarray, keys: list, starts: np.ndarray) -> bytes:
    """A file of ids, with its documents' keys and the place of each one's first id."""
    rest, levels, parts = ids.astype(np.uint32), [], []
    while True:
        parts.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        last = not more.any()
        levels.append({"n": len(rest), "last": bool(last)})
        if last:
            break
        padded = np.zeros(-(-len(more) // STEP) * STEP, bool)
        padded[: len(more)] = more
        ones = padded.reshape(-1, STEP).sum(axis=1, dtype=np.uint32)
        parts += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()]
        rest = rest[more] >> 8
    header = json.dumps({"levels": levels, "documents": len(starts), "ids": len(ids), "keys": keys}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + starts.astype("<u8").tobytes() + b"".join(parts)


class Reader:
    """Random access to the ids of one file, by range reads: ``read(offset, size)`` gives its bytes.

    Opening reads the header alone. A token takes three short reads for each of its levels but the last one it has,
    whatever the size of the file.
    """

    def __init__(self, read):
        start = read(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a token-id file")
        (size,) = struct.unpack_from("<I", start, 4)
        header, at = json.loads(read(8, size)), 8 + size
        self.read, self.keys, self.n, self.documents = read, header["keys"], header["ids"], header["documents"]
        self.first, at = at, at + 8 * header["documents"]
        self.levels = []  # (ids, places of the chunks, of the bitmap and of the rank directory)
        for level in header["levels"]:
            blocks = 0 if level["last"] else -(-level["n"] // STEP)
            self.levels.append((level["n"], at, at + level["n"], at + level["n"] + blocks * STEP // 8, level["last"]))
            at += level["n"] + blocks * (STEP // 8 + 4)

    @property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self.read(self.first, 8 * self.documents), "<u8").astype(np.int64)

    def token(self, place: int) -> int:
        """The id at one place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        out = 0
        for k, (_, chunks, bits, ranks, last) in enumerate(self.levels):
            out |= self.read(chunks + place, 1)[0] << (8 * k)
            if last:
                break
            block, bit = divmod(place, STEP)
            line = int.from_bytes(self.read(bits + block * STEP // 8, STEP // 8), "little")
            if not line >> bit & 1:
                break
            place = int.from_bytes(self.read(ranks + 4 * block, 4), "little") + (line & ((1 << bit) - 1)).bit_count()
        return out

    def every(self) -> np.ndarray:
        """All ids, level by level."""
        out, which = np.zeros(self.n, np.uint32), slice(None)
        for k, (n, chunks, bits, ranks, last) in enumerate(self.levels):
            out[which] |= np.frombuffer(self.read(chunks, n), np.uint8).astype(np.uint32) << (8 * k)
            if last:
                break
            more = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(bits, ranks - bits), np.uint8), count=n, bitorder="little"))
            which = more if k == 0 else which[more]
        return out


@lru_cache(2)
def library_store(path: str) -> ChunkStore:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    from .ranks import read_bytes

    tokenizer = Tokenizer.from_str(read_bytes(path).decode())

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return ChunkStore(lambda text: [text], encode, KEPT)


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes token-id files in ascending key order.

    Gives the manifest: path, seq, first key, documents, ids, and base, the number of ids in all files before. Only texts
    are shuffled, by key ranges; the manifest has a row per file.
    """
    spark, folder = docs.sparkSession, folder or fresh_path(docs.sparkSession, "ids")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        fs, inner = filesystem(folder)
        fs.create_dir(inner, recursive=True)
        attempt, seq, keys, packed, held = uuid.uuid4().hex[:16], 0, [], [], 0

        def flush():
            nonlocal seq, keys, packed, held
            ids = np.frombuffer(b"".join(packed), "<u4")
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            name = f"{attempt}-{seq:05d}.dac"
            with fs.open_output_stream(f"{inner}/{name}") as f:
                f.write(pack(ids, keys, np.cumsum(sizes) - sizes))
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([seq], pa.int64()), pa.array(keys[:1], first_type), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64())], ["path", "seq", "first_key", "documents", "ids"])
            seq, keys, packed, held = seq + 1, [], [], 0
            return row

        store, end, first_type = library_store(path), struct.pack("<I", end_id), None
        for batch in batches:
            first_type = batch.schema.field(0).type
            ids, at = store.of_texts([x.decode("utf-8", "replace") for x in batch.column(1).to_pylist()])
            for k, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                keys.append(k)
                packed.append(ids[a:b].tobytes() + end)
                held += b - a + 1
                if held >= file_ids:
                    yield flush()
        if keys:
            yield flush()

    ordered = docs.select(F.col(key).alias("k"), utf8(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    manifest = written(map_arrow(ordered, run, f"path string, seq long, first_key {kind}, documents long, ids long"), "id-manifest")
    order = Window.orderBy(F.col("first_key").asc_nulls_first(), "seq")
    return manifest.withColumn("base", F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids"))


def read_ids(manifest: DataFrame, key: str = "doc_id", kind: str = "bigint", with_ids: bool = True) -> DataFrame:
    """From the files: ``key``, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as f:
                    reader = Reader(lambda at, size: f.read_at(size, at))
                    every, starts = reader.every(), reader.starts
                every, ends = every.astype("<u4", copy=False), np.append(starts, reader.n).tolist()
                columns = [pa.array(reader.keys, out_kind), pa.array(starts + base, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(every[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())]
                names = ["k", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, reader.n).astype(np.int32)), pa.array(every.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    out_kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]
    files = max(1, manifest.count())
    schema = f"k {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_arrow(manifest.select("path", "base").repartition(files), run, schema).withColumnRenamed("k", key)


def tokens_at(path: str, places: list[int]) -> list[int]:
    """Tokens at any places of one file, by range reads."""
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        reader = Reader(lambda at, size: f.read_at(size, at))
        return [reader.token(p) for p in places]
