"""Byte-level BPE encoding and decoding by ranks.

A segment tree over byte positions keeps at its root the lowest rank of a live adjacent pair and, of equal ranks, the
leftmost place; a merge updates the leaves of the merged place and its two live neighbours, each in logarithmic steps.
Short pieces share one tree array and are merged in step, a row each; long ones have a tree of their own.

Null and empty texts encode to no ids. Repeated rows give repeated results. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkStore
from .common import map_arrow, utf8
from .ranks import Ranks, tiktoken_ranks

#: No pair. Leaves are rank << PLACE | place.
PLACE = 32
NONE = (1 << 62) - 1
#: Chunks kept in a task, beside other workers' stores; texts encoded at once. No result depends on them.
KEPT, BATCH = 150_000, 512
#: Bytes of the longest piece that is merged in step with others.
SHORT = 32


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks: Ranks = tiktoken_ranks(path)
        self.pattern = regex.compile(pattern)
        self.by_byte = np.array(self.ranks.by_byte, np.int64)
        self.tokens = [self.ranks.tokens.get(i, b"") for i in range(max(self.ranks.tokens) + 1)]
        ids, pairs = self.ranks.ids, {}
        for token, i in ids.items():  # every way to cut a token in two known ones merges to it
            for cut in range(1, len(token)):
                if (a := ids.get(token[:cut])) is not None and (b := ids.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.to = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.store = ChunkStore(self.pattern.findall, self.encode_pieces, KEPT)

    def lookup(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (a, b) at places; ids of -1 make no pair."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.to[at] << PLACE | place, NONE)

    def in_step(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` (a power of two) bytes."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        symbol = np.where(place < size[:, None], self.by_byte[raw], -1)
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width : 2 * width - 1] = self.lookup(symbol[:, :-1], symbol[:, 1:], place[:-1])
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)

        def put(row: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
            node = at + width
            tree[row, node] = leaf
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        while len(live):
            best = tree[live, 1]
            i, new = best & 0xFFFFFFFF, best >> PLACE
            j = after[live, i]
            k = after[live, j]
            symbol[live, i], symbol[live, j] = new, -1
            after[live, i] = k
            inside = k < size[live]
            right = np.where(inside, symbol[live, np.minimum(k, width - 1)], -1)
            before[live[inside], k[inside]] = i[inside]
            put(live, j, np.full(len(live), NONE))
            put(live, i, self.lookup(new, right, i))
            p = before[live, i]
            has = p >= 0
            row, q = live[has], p[has]
            put(row, q, self.lookup(symbol[row, q], new[has], q))
            live = live[tree[live, 1] != NONE]
        kept = symbol >= 0
        flat = symbol[kept].tolist()
        ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def alone(self, piece: bytes) -> list[int]:
        """Ids of one long piece, by a tree of its own."""
        n, pairs = len(piece), self.pairs
        symbol = [self.ranks.by_byte[b] for b in piece]
        width = 1 << (n - 1).bit_length()
        leaf = lambda a, b, at: NONE if (m := pairs.get(a << 32 | b)) is None else m << PLACE | at
        tree = [NONE] * (2 * width)
        tree[width : width + n - 1] = [leaf(symbol[i], symbol[i + 1], i) for i in range(n - 1)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low

        while (best := tree[1]) != NONE:
            i, new = best & 0xFFFFFFFF, best >> PLACE
            j = after[i]
            k = after[i] = after[j]
            symbol[i], symbol[j] = new, -1
            put(j, NONE)
            if k < n:
                before[k] = i
                put(i, leaf(new, symbol[k], i))
            else:
                put(i, NONE)
            if (p := before[i]) >= 0:
                put(p, leaf(symbol[p], new, p))
        return [s for s in symbol if s >= 0]

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        pieces = [t.encode() for t in texts]
        out, groups = [[]] * len(pieces), {}
        for k, p in enumerate(pieces):
            if len(p) > SHORT:
                out[k] = self.alone(p)
            else:
                groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, members in groups.items():
            for at in range(0, len(members), 20_000):
                part = members[at : at + 20_000]
                for k, ids in zip(part, self.in_step([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        ids, at = self.store.of_texts(texts)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (packed) and decoded text; one pass, no shuffle."""

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in (b.slice(a, BATCH) for b in batches for a in range(0, b.num_rows, BATCH)):
            ids = bpe.encode([x.decode("utf-8", "replace") for x in batch.column(1).to_pylist()])
            decoded = [bpe.decode(x) for x in ids]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.store.clear()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return map_arrow(docs.select(F.col(key).alias("k"), utf8(text).alias("t")), run, schema).withColumnRenamed("k", key)
