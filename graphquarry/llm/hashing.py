"""64-bit hashes of words and word runs, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3, P4 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63))
S33 = np.uint64(33)


class WordHashes(dict):
    """Hash of a word's bytes, kept by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> S33)) * P2
    x = (x ^ (x >> S33)) * P3
    return x ^ (x >> S33)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
