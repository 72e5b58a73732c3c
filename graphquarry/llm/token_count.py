"""Token counts without identifiers: heap-and-linked-list byte-pair merging.

Null and empty texts have no bytes and no tokens. Repeated rows give repeated results. Other columns are left out.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkStore
from .common import map_arrow, utf8
from .ranks import json_ranks

LIMIT = 1024


def count_merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left after all merges, lowest rank first and of those the leftmost.

    The heap holds (rank, place, left, right) of adjacent pairs; a popped pair counts only if both symbols still stand
    there. Each merge links the left place past the right one and pushes the two new neighbours.
    """
    n = len(symbols)
    if n < 2:
        return n
    find, pop, push = merges.get, heapq.heappop, heapq.heappush
    heap = [(m[0], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (m := find(pair))]
    heapq.heapify(heap)
    symbols, after, before, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        _, i, a, b = pop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        new = merges[a, b][1]
        symbols[i], symbols[j] = new, -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if m := find((new, symbols[k])):
                push(heap, (m[0], i, new, symbols[k]))
        p = before[i]
        if p >= 0 and (m := find((symbols[p], new))):
            push(heap, (m[0], p, symbols[p], new))
    return left


class Counter:
    def __init__(self, path: str, pattern: str):
        self.ranks, self.special = json_ranks(path)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(pattern)
        self.store = ChunkStore(self.cut, self.pieces)

    def cut(self, text: str) -> list[str]:
        if not self.cut_special:
            return self.pattern.findall(text)
        return [p for k, part in enumerate(self.cut_special.split(text)) for p in ([part] if k % 2 else self.pattern.findall(part))]

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """The count of each piece, as a single number in place of ids."""
        by_byte, merges, special = self.ranks.by_byte, self.ranks.merges, self.special
        return [[1 if p in special else count_merged([by_byte[b] for b in p.encode()], merges)] for p in pieces]

    def counts(self, texts: list[str]) -> list[int]:
        numbers, at = self.store.of_texts(texts)
        total = np.concatenate([[0], np.cumsum(numbers, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]).tolist()


@lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of every whole text; one pass, no shuffle."""

    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            got = count.counts([x.decode("utf-8", "replace") for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(got, pa.int64()), pa.array([n > limit for n in got])], ["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    found = map_arrow(docs.select(F.col(key).alias("k"), utf8(text).alias("t")), run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("k", key)
