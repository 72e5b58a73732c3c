"""Texts cut into space-separated chunks that tokenize on their own.

The pre-tokenizer pattern lets a token span a single leading space but no other white space. So a chunk of a space and
a run that starts and ends with something else than white space is cut the same way alone as in its text, and what it
encodes to can be kept by chunk. Texts with other spacing (two spaces, a space beside a line end) are cut as a whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a worker, some 180 bytes each. Beyond it only those met most often since the last time stay, half as many
#: at most. A memory bound that no result depends on.
KEPT = 800_000
#: Longer ones aren't kept.
LONG = 100
#: Marks that end most chunks that aren't letters alone.
ENDS = frozenset(".,;:!?")


def joined(lists) -> list[int]:
    return [*itertools.chain.from_iterable(lists)]


class ChunkStore:
    """Ids of texts put together from the ids of their chunks.

    ``cut``: text to pieces. ``encode``: distinct pieces to lists of ids. A run of letters with or without a space before
    it is always one piece, and so is a mark of ENDS after letters before a space. A batch's distinct chunks are looked up
    once each; the ids are then gathered by array.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]], kept: int = KEPT):
        self.cut, self.encode, self.kept = cut, encode, kept
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}  # by the chunk without its space
        self.marks: dict[str, list[int]] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.met, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def add(self, values: list[list[int]]) -> range:
        """Places of new values."""
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        total, n = int(sizes.sum()), self.n + len(values)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        if n >= len(self.start):
            more = max(len(self.start), len(values) + 1)
            self.start, self.met = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.start, self.met))
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(values), np.uint32, total)
        self.start[self.n + 1 : n + 1] = self.used + np.cumsum(sizes)
        made, self.used, self.n = range(self.n, n), self.used + total, n
        return made

    def value(self, place: int) -> list[int]:
        return self.flat[self.start[place] : self.start[place + 1]].tolist()

    def trim(self) -> None:
        if self.n <= self.kept:
            return
        words = [w for w in self.places if len(w) <= LONG]
        places = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        met = self.met[places]
        least = max(2, int(np.partition(met, -(self.kept // 2))[-(self.kept // 2)]) + 1) if len(met) > self.kept // 2 else 2
        old = np.flatnonzero(met >= least).tolist()
        values = [self.value(places[k]) for k in old]
        self.clear()
        self.places = dict(zip((words[k] for k in old), self.add(values)))

    def learn(self, words: list[str]) -> None:
        """Encodes chunks that aren't kept yet; none of them starts or ends with white space."""
        letters, marked, other = [], [], {}
        for w, plain in zip(words, map(str.isalpha, words)):
            if plain:
                letters.append(w)
            elif w[-1] in ENDS and w[:-1].isalpha():
                marked.append(w)
            else:
                other[w] = self.cut(" " + w)
        letters += {w[:-1] for w in marked}.difference(self.places).difference(letters)
        asked = [*set().union(*other.values(), ENDS.difference(self.marks))]
        got = self.encode([" " + w for w in letters] + asked)
        pieces = dict(zip(asked, got[len(letters) :]))
        self.marks |= {m: pieces[m] for m in ENDS if m in pieces}
        self.places.update(zip(letters, self.add(got[: len(letters)])))
        own = dict(zip(letters, got))
        stem = lambda w: own[w] if w in own else self.value(self.places[w])
        self.places.update(zip(marked, self.add([stem(w[:-1]) + self.marks[w[-1]] for w in marked])))
        self.places.update(zip(other, self.add([joined(map(pieces.__getitem__, p)) for p in other.values()])))

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): the ids of text i stand from offsets[i] to offsets[i + 1]."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.trim()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
        heads = bounds[:-1]
        inner = np.ones(len(code), bool)
        inner[heads] = False
        used = np.zeros(len(words), bool)
        used[code[inner]] = True
        get = self.places.get
        place = np.fromiter(map(get, words, itertools.repeat(-1)), np.int32, len(words))
        fresh = np.flatnonzero(used & (place < 0)).tolist()
        odd = [k for k in fresh if not (w := words[k]) or w[0].isspace() or w[-1].isspace()]
        if odd:
            fresh = [*set(fresh).difference(odd)]
        self.learn([words[k] for k in fresh])
        place[fresh] = [self.places[words[k]] for k in fresh]
        whole = np.zeros(len(texts), bool)
        if odd:
            bad = np.zeros(len(words), bool)
            bad[odd] = True
            whole = np.add.reduceat(bad[code] & inner, heads) > 0
        first = [words[c] for c in code[heads].tolist()]
        whole |= np.fromiter((f[-1:].isspace() or not f for f in first), bool, len(first))
        alone = {t: None for t, w in zip(texts, whole.tolist()) if w} | {f: None for f, w in zip(first, whole.tolist()) if not w}
        cuts = {t: self.cut(t) for t in alone}
        asked = [*set().union(*cuts.values())]
        pieces = dict(zip(asked, self.encode(asked)))
        made = dict(zip(cuts, self.add([joined(map(pieces.__getitem__, p)) for p in cuts.values()])))
        at = place[code]
        at[heads] = [made[t if w else f] for t, f, w in zip(texts, first, whole.tolist())]
        keep = np.ones(len(code), bool)
        if whole.any():
            keep = inner & ~np.repeat(whole, np.diff(bounds))
            keep[heads] = True
            at = at[keep]
        self.met[: self.n] += np.bincount(at, minlength=self.n).astype(np.int32)
        kept = pa.LargeListArray.from_arrays(pa.array(self.start[: self.n + 1]), pa.array(self.flat[: self.used]))
        got = kept.take(pa.array(at))
        ends = np.asarray(got.offsets)
        chunks = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, heads, dtype=np.int64))])
        for k in fresh:  # long ones aren't kept; heads and whole texts are never looked up again
            if len(words[k]) > LONG:
                self.places.pop(words[k], None)
        return np.asarray(got.flatten()), ends[chunks]
