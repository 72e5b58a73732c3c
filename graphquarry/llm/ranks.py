"""Byte-pair vocabularies as tables: bytes of each id, and the rank of each adjacent pair of ids."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa


def read_bytes(path: str) -> bytes:
    from .common import filesystem

    fs, inner = filesystem(path)
    with fs.open_input_stream(inner) as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ranks:
    """``tokens``: bytes by id. ``merged(a, b)``: the id that ids a and b merge to, whose order is the rank, or none."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[bytes, bytes]] | None = None):
        self.tokens = tokens
        self.ids = {v: k for k, v in tokens.items()}
        self.by_byte = [self.ids[bytes([b])] for b in range(256)]
        self.merges = merges and {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}


@lru_cache(4)
def tiktoken_ranks(path: str) -> Ranks:
    return Ranks({int(rank): base64.b64decode(token) for token, rank in map(bytes.split, read_bytes(path).splitlines()) if token})


@lru_cache(4)
def json_ranks(path: str) -> tuple[Ranks, list[str]]:
    """The merges of a byte-level tokenizer file, and its special strings."""
    spec, letter = json.loads(read_bytes(path)), byte_letters()
    special = [t["content"] for t in spec["added_tokens"]]
    raw = lambda s: bytes(letter[c] for c in s)
    tokens = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return Ranks(tokens, [(raw(a), raw(b)) for a, b in pairs]), special


def as_arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))
