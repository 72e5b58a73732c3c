"""The default embedding: hashed n-grams with signs, as a column of the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import content_key

#: Three counts of 21 bits share a long, so that a long's 63 bits of a feature are counted by 21 sums.
LANES, WIDTH = 3, 21
DIMS = LANES * WIDTH
EVERY = sum(1 << (WIDTH * k) for k in range(LANES))


def features(text: Column) -> Column:
    """Hashes of the words and of the runs of three characters of a text, white space and case aside; spaces stand around it."""
    # what is used more than once is bound by a lambda, or it would be computed anew for each element
    def of(key: Column) -> Column:
        spaced = F.array(F.split(F.concat(F.lit(" "), key, F.lit(" ")), ""))
        grams = F.transform(spaced, lambda c: F.filter(F.transform(c, lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2))), lambda g: g.isNotNull()))[0]
        words = F.transform(F.split(key, " "), lambda w: F.concat(F.lit("\n"), w))
        return F.when(key != "", F.transform(F.concat(words, grams), lambda f: F.xxhash64(f))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(content_key(F.coalesce(text, F.lit("")))), of)[0]


def numbers(lanes: list[Column], size: Column) -> Column:
    """The array of ``DIMS`` numbers from the sums of lanes and the number of features."""
    one = lambda lane, j: (F.shiftrightunsigned(lane, WIDTH * j).bitwiseAND(2**WIDTH - 1) * 2 - size).cast("double")
    return F.array(*[one(lane, j) for j in range(LANES) for lane in lanes])


def lane(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, k).bitwiseAND(EVERY)


def embed(text: Column) -> Column:
    """An array of ``DIMS`` numbers: each feature adds 1 or -1 to every one of them by a bit of its hash.

    Texts that share most words and runs of characters have a high cosine, others one near 0 (about ±0.13). Null and blank texts
    give zeros. No model, no Python and no shuffle; up to two million features a text are counted without overflow. A
    model's vectors take its place as a column, or by ``operators.providers``. For short texts such as names, questions and
    sentences; ``embed_rows`` gives the same and is faster for long ones."""

    def counts(f: Column) -> Column:
        added = lambda k: lambda n, h: n + lane(h, k)
        lanes = [F.aggregate(f, F.lit(0).cast("long"), added(k)) for k in range(WIDTH)]
        return F.transform(F.array(F.array(*lanes)), lambda held: numbers([held[k] for k in range(WIDTH)], F.size(f)))[0]

    return F.transform(F.array(features(text)), counts)[0]


def embed_rows(rows: DataFrame, key: str | list[str], text: str, into: str = "embedding") -> DataFrame:
    """(``key``, ``into``) with ``embed`` of each row's text, for distinct keys (one column or several): features are exploded, hashed
    and summed by key in compiled code, before the shuffle, which moves 22 numbers a row."""
    by = [key] if isinstance(key, str) else list(key)
    none = F.array().cast("array<string>")
    # each step is a projection of its own, as what is used more than once would be computed anew for each use
    keyed = rows.select(*by, content_key(F.coalesce(F.col(text), F.lit(""))).alias("#t"))
    cut = keyed.select(*by, "#t", F.split(F.concat(F.lit(" "), "#t", F.lit(" ")), "").alias("#a"), F.split("#t", " ").alias("#w"))
    shifted = cut.select(*by, "#t", "#a", "#w", F.slice("#a", F.lit(2), F.size("#a")).alias("#b"), F.slice("#a", F.lit(3), F.size("#a")).alias("#c"))
    named = lambda *c: F.arrays_zip(*(x.alias(n) for x, n in zip(c, "abc"))).cast("array<struct<a:string,b:string,c:string>>")
    both = F.concat(named(none, F.col("#w"), none), named(F.col("#a"), F.col("#b"), F.col("#c")))  # a word has no a, the last runs no c
    each = shifted.select(*by, F.explode_outer(F.when(F.col("#t") != "", both)).alias("#f"))
    said = F.when(F.col("#f.a").isNull(), F.concat(F.lit("\n"), "#f.b")).otherwise(F.concat("#f.a", "#f.b", "#f.c"))
    each = each.select(*by, said.alias("#s"))
    each = each.select(*by, F.when(F.col("#s").isNotNull(), F.xxhash64("#s")).alias("#h"))
    sums = each.groupBy(*by).agg(*[F.coalesce(F.sum(lane(F.col("#h"), k)), F.lit(0)).alias(f"#{k}") for k in range(WIDTH)], F.count("#h").alias("#n"))
    return sums.select(*by, numbers([F.col(f"#{k}") for k in range(WIDTH)], F.col("#n")).alias(into))


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = np.uint64(42)
#: Bytes of texts that are hashed at once, and features that one byte counts.
AT_ONCE, BYTE = 1 << 16, 255


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``xxhash64`` of the ``n`` bytes from each of ``starts`` on, as Spark has it."""
    def held(at: int, size: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for j in range(size):
            out |= data[starts + (at + j)].astype(np.uint64) << np.uint64(8 * j)
        return out

    at = 0
    if n >= 32:
        with np.errstate(over="ignore"):
            lanes = [np.full(len(starts), v, np.uint64) for v in (SEED + P1 + P2, SEED + P2, SEED, SEED - P1)]
        while at <= n - 32:
            lanes = [turned(v + held(at + 8 * j, 8) * P2, 31) * P1 for j, v in enumerate(lanes)]
            at += 32
        h = turned(lanes[0], 1) + turned(lanes[1], 7) + turned(lanes[2], 12) + turned(lanes[3], 18)
        for v in lanes:
            h = (h ^ (turned(v * P2, 31) * P1)) * P1 + P4
    else:
        h = np.full(len(starts), SEED, np.uint64) + P5
    h += np.uint64(n)
    while at + 8 <= n:
        h = turned(h ^ (turned(held(at, 8) * P2, 31) * P1), 27) * P1 + P4
        at += 8
    if at + 4 <= n:
        h = turned(h ^ (held(at, 4) * P1), 23) * P2 + P3
        at += 4
    for at in range(at, n):
        h = turned(h ^ (data[starts + at].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def key_vectors(keys: pa.Array) -> np.ndarray:
    """``embed`` of texts by their ``content_key``, a row each, by numpy; the numbers stand in the order of a hash's bits."""
    out = np.zeros((len(keys), DIMS))
    held = [(k or "").encode() for k in keys.to_pylist()]
    size = np.cumsum([len(k) for k in held])
    at = 0
    while at < len(held):  # as many as fit the processor's caches
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
        few_vectors(held[at:to], out[at:to])
        at = to
    return out


def few_vectors(keys: list[bytes], out: np.ndarray) -> None:
    # a space before and behind each key, and a line end before each, which stands for the one before each word
    data = np.frombuffer(b"".join(b"\n %b \n" % k for k in keys), np.uint8)
    line = data == 10
    key_of = ((np.cumsum(line, dtype=np.int32) - 1) >> 1).astype(np.int32)
    ends = np.flatnonzero(line)[1::2]
    full = np.array([k != b"" for k in keys])
    space = data == 32
    lined = np.where(space, np.uint8(10), data)
    marks = np.flatnonzero(space[:-1] & ~line[1:] & full[key_of[:-1]])  # the space before each word
    stops = np.flatnonzero(space[1:] & ~line[:-1] & full[key_of[1:]]) + 1
    word_of = key_of[marks]
    chars = np.flatnonzero(((data & 0xC0) != 0x80) & ~line)
    own, after = key_of[chars], np.append(chars, len(data))
    runs = np.flatnonzero(own[:-2] == own[2:])
    run_of, run_at = own[runs], chars[runs]
    closing = np.append(own, -1)[runs + 3] != run_of
    run_end = np.where(closing, ends[run_of], after[runs + 3])
    for source, at, length, of in ((lined, marks, stops - marks, word_of), (data, run_at, run_end - run_at, run_of)):
        order = np.argsort(length.astype(np.uint16) if length.max(initial=0) < 1 << 16 else length, kind="stable")
        h = np.empty(len(at), np.uint64)
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(group):
                h[group] = hashes(source, at[group], int(length[group[0]]))
        counted(h, of, out)
    out *= 2
    out -= (np.bincount(word_of, minlength=len(keys)) + np.bincount(run_of, minlength=len(keys)))[:, None]


def counted(h: np.ndarray, of: np.ndarray, into: np.ndarray) -> None:
    """Adds to row ``of`` of ``into`` (rows in order) the bits of each hash: eight counts share a number, each in one of its bytes."""
    if not len(h):
        return
    first = np.flatnonzero(np.diff(of, prepend=-1))
    lengths = np.diff(np.append(first, len(of)))
    parts = -(-lengths // BYTE)
    cuts = np.repeat(first, parts) + BYTE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.empty((len(cuts), 64), np.uint8)
    for k in range(8):
        ones = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts)
        sums[:, k::8] = ones.view(np.uint8).reshape(len(cuts), 8)
    rows = np.cumsum(parts) - parts
    into[of[first]] += np.add.reduceat(sums[:, :DIMS], rows, axis=0, dtype=np.float64)
