"""Substring dedup by FM-indexes of shards: every word covered by a window of words that starts anywhere else too.

Shards must be such that equal windows meet. Each window's anchor is the smallest hash of its runs of ``GRAM`` words; the
windows of one anchor's place make a segment, so equal windows stand at equal places of segments with equal anchors.
Anchors met once are dropped after a count by hash. Of the rest, segments met twice as a whole are covered as a whole (a
pre-aggregation: a hot passage isn't shuffled copy by copy); those met once, whose anchor has other segments, go with one
copy of each other segment to the anchor's shard. There an FM-index (suffix array, BWT, wavelet matrix with rank
directories) is built, and the segments are streamed through it by backward search: their matching statistics say which
windows occur twice or more. The segments of an anchor with over ``HOT`` distinct ones are texts of their own, cut again
by anchors of the fourfold number of smallest runs, so that a hot passage is dealt over many shards. An anchor of all of a
window's runs holds one distinct window, so this ends.

Words are runs without ASCII white space, as they are. Null, empty and short texts have no windows. Repeated rows count
as occurrences of their own, so all of them lose their windows; rows that share an id but not the text are told apart by
the text's hash. Segments are told apart by 64-bit hashes under a 64-bit anchor. Other columns are kept by
``without_repeats`` and left out by ``repeated_words``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, utf8, written
from .hashing import P1, P2, P3, P4, WordHashes, mixed, signed

WINDOW, GRAM = 35, 16
#: Words of a shard; distinct segments of an anchor beyond which they are cut again.
SHARD_WORDS, HOT = 100_000, 1000
RUNS = "array<struct<start:int,size:int>>"


def segments(w: np.ndarray, window: int = WINDOW, gram: int = GRAM, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, hashes, starts, sizes in words) of a text's segments. ``gram`` is a power of two, at most half a window.
    An anchor is the hash of the ``least`` smallest runs of a window; a segment is windows side by side with one anchor."""
    none = np.zeros(0, np.uint64)
    if len(w) < window:
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        runs, step = w, 1
        while step < gram:
            runs = mixed(runs[:-step] * P1 + runs[step:] * P2 + np.uint64(step))
            step *= 2
        span = window - gram + 1
        views = np.lib.stride_tricks.sliding_window_view(runs, span)
        if least == 1:
            at = views.argmin(axis=1) + np.arange(len(w) - window + 1)
            anchor = runs[at]
        else:
            anchor = np.zeros(len(views), np.uint64)
            for k in range(0, len(views), 20_000):
                some = np.sort(views[k : k + 20_000], axis=1)[:, : min(least, span)]
                for column in some.T:
                    anchor[k : k + 20_000] = mixed(anchor[k : k + 20_000] * P3 + column)
            at = anchor if least < span else np.arange(len(views))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        size = last - first + window
        end = first + size - gram
        name = size.astype(np.uint64)
        for k in range(-(-(2 * window) // gram)):
            name = mixed(name * P3 + runs[np.minimum(first + k * gram, end)])
        return anchor[first], name, first, size


def cut(docs: DataFrame, window: int, least: int) -> DataFrame:
    """Of texts (k, th, cnt, t): k, th, cnt and their segments; written once."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [segments(hashes.of(t.split()), window, least=least) for t in batch.column(3).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
            lists = []
            for i, kind in enumerate((np.int64, np.int64, np.int32, np.int32)):
                flat = np.concatenate([f[i].view(np.int64) if i < 2 else f[i].astype(np.int32) for f in found]) if found else np.zeros(0, kind)
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["k", "th", "cnt", "anchor", "seg", "start", "size"])

    return written(map_arrow(docs, run, f"k {kind}, th long, cnt long, anchor array<long>, seg array<long>, start array<int>, size array<int>"), "fm-segments")


class FMIndex:
    """Over segments of symbols 1.. and up, each ended by a separator."""

    def __init__(self, pieces: list[np.ndarray]):
        ends = np.cumsum([len(p) + 1 for p in pieces])
        n = int(ends[-1])
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[ends - 1] = False
        text[body] = np.concatenate(pieces)
        rank = text + len(pieces)
        rank[ends - 1] = np.arange(len(pieces))  # separators differ, so suffixes are told apart within their segment
        longest, step = int(max(len(p) for p in pieces)) + 1, 1
        while True:
            order = np.argsort(rank, kind="stable") if step == 1 else np.argsort(rank * (n + 1) + np.concatenate([rank[step // 2 :] + 1, np.zeros(step // 2, np.int64)]), kind="stable")
            value = rank if step == 1 else rank * (n + 1) + np.concatenate([rank[step // 2 :] + 1, np.zeros(step // 2, np.int64)])
            sorted_ = value[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
            if rank[order[-1]] == n - 1 or step > 2 * longest:
                break
            step *= 2
        self.n = n
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels, self.zeros = [], []
        self.bits = max(1, int(text.max()).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, bool)
            padded[:n] = bit
            lines = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(lines).astype(np.int64)
            self.levels.append((lines, np.cumsum(ones) - ones))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        every = np.arange(len(self.before) - 1)
        self.origin = np.zeros(len(every), np.int64)
        self.origin = self.walk(every, self.origin)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, ((lines, ranks), zeros) in enumerate(zip(self.levels, self.zeros)):
            line = at >> 6
            ones = ranks[line] + np.bitwise_count(lines[line] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that start with ``symbol`` and go on with those in the ranges."""
        at = self.walk(np.concatenate([symbol, symbol]), np.concatenate([low, high])) - np.concatenate([self.origin[symbol]] * 2) + np.concatenate([self.before[symbol]] * 2)
        return at[: len(symbol)], at[len(symbol) :]


def repeated_windows(index: FMIndex, pieces: list[np.ndarray], window: int = WINDOW) -> list[np.ndarray]:
    """For each piece (itself in the index) the starts of its windows that occur twice or more.

    A search goes left from an end; where it meets a range of under two suffixes at f, no window with [f, end) repeats.
    Short searches of doubled reach then find a run from f that is unique already, and the next end lies before its end.
    """
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(pieces)
    good = np.zeros(len(flat), bool)
    n = len(pieces)
    which, end, left = np.arange(n), sizes.copy(), sizes.copy()
    low, high = np.zeros(n, np.int64), np.full(n, index.n)
    reach, fail, unique = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)  # reach 0: a full search
    live = sizes >= window
    state = [a[live] for a in (which, end, left, low, high, reach, fail, unique)]
    while len(state[0]):
        which, end, left, low, high, reach, fail, unique = state
        low2, high2 = index.extend(flat[starts[which] + left - 1], low, high)
        ok = high2 - low2 >= 2
        left = np.where(ok, left - 1, left)
        low, high = np.where(ok, low2, low), np.where(ok, high2, high)
        marked = ok & (end - left >= window)
        good[(starts[which] + left)[marked]] = True
        probing = reach > 0
        # a full search failed: look for a shorter unique run from the same place
        broke = ~ok & ~probing
        fail, unique = np.where(broke, left - 1, fail), np.where(broke, end, unique)
        # a probe found a unique run, or passed its place and is doubled
        short = ~ok & probing
        unique = np.where(short, np.minimum(unique, end), unique)
        passed = ok & probing & (left <= fail)
        reach = np.where(broke, 2, np.where(passed, reach * 2, reach))
        longer = (broke | passed) & (fail + reach < unique)
        done = short | ((broke | passed) & ~longer)
        fresh = longer | done
        end = np.where(longer, fail + reach, np.where(done, np.minimum(unique - 1, fail + window), end))
        reach = np.where(done, 0, reach)
        left = np.where(fresh, end, left)
        low, high = np.where(fresh, 0, low), np.where(fresh, index.n, high)
        go = np.where(reach > 0, True, (left > 0) & (end >= window))
        state = [a[go] for a in (which, end, left, low, high, reach, fail, unique)]
    return [np.flatnonzero(good[s : s + m]) for s, m in zip(starts.tolist(), sizes.tolist())]


def runs_of(starts: np.ndarray, window: int) -> list[dict]:
    """Spans (start, size) of the words that windows at ``starts``, in order, cover."""
    if not len(starts):
        return []
    first = np.concatenate([[True], np.diff(starts) > window])
    last = np.concatenate([first[1:], [True]])
    return [{"start": a, "size": b - a + window} for a, b in zip(starts[first].tolist(), starts[last].tolist())]


def shard_hits(rows: pa.Table, window: int) -> pa.Table:
    """(anchor, seg, runs) of the words in windows that repeat, of the segments met once in a shard."""
    numbers: dict[bytes, int] = {}
    pieces = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in t.split(b" ")), np.int64) for t in rows["words"].to_pylist()]
    once = [i for i, n in enumerate(rows["cnt"].to_pylist()) if n == 1]
    found = repeated_windows(FMIndex(pieces), [pieces[i] for i in once], window)
    return pa.table({"anchor": rows["anchor"].take(pa.array(once)), "seg": rows["seg"].take(pa.array(once)), "runs": pa.array([runs_of(f, window) for f in found], pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))})


def covered(docs: DataFrame, window: int, least: int = 1) -> DataFrame:
    """(k, th, spans): the covered spans (start, size) of every text that has any, of texts (k, th, cnt, t); cnt is how
    often a text counts."""
    base = cut(docs, window, least)
    every = base.select("k", "th", "cnt", F.inline(F.arrays_zip("anchor", "seg", "start", "size")))
    live = every.groupBy("anchor").agg(F.sum("cnt").alias("times"), (F.min("seg") == F.max("seg")).alias("alike")).where("times > 1").select("anchor", "alike")
    found = written(every.join(live, "anchor"), "fm-live")
    discard(base)
    varied = found.where("NOT alike").groupBy("anchor", "seg").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("k", "th", "start", "size")).alias("at"))
    varied = written(varied, "fm-varied")
    asked = varied.groupBy("anchor").agg(F.min("cnt").alias("lowest"), F.count("*").alias("kinds")).where("lowest = 1").select("anchor", (F.col("kinds") > HOT).alias("hot"))
    asked = written(varied.join(asked, "anchor").select("anchor", "seg", "cnt", "hot", "at.*"), "fm-asked")
    total = asked.agg(F.sum("size")).first()[0] or 0
    per_text = asked.groupBy("k", "th").agg(F.collect_list(F.struct("anchor", "seg", "cnt", "hot", "start", "size")).alias("parts"))
    wanted = per_text.withColumnsRenamed({"k": "k2", "th": "th2"}).hint("shuffle_hash")
    texts = docs.join(wanted, F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2"))).select("t", "parts")

    def read(batches):
        """The asked segments' words."""
        names = ["anchor", "seg", "cnt", "hot"]
        for batch in batches:
            out, said = [], []
            for raw, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = raw.split()
                out += parts
                said += [b" ".join(words[p["start"] : p["start"] + p["size"]]) for p in parts]
            yield pa.RecordBatch.from_arrays([*[pa.array([p[n] for p in out], pa.bool_() if n == "hot" else pa.int64()) for n in names], pa.array(said, pa.binary())], [*names, "words"])

    words = map_arrow(texts, read, "anchor long, seg long, cnt long, hot boolean, words binary").dropDuplicates(["anchor", "seg"])
    words = written(words, "fm-words")
    shards = max(1, -(-total // SHARD_WORDS))
    dealt = words.where("NOT hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    state = hits = written(dealt.groupBy("shard").applyInArrow(lambda rows: shard_hits(rows, window), f"anchor long, seg long, runs {RUNS}").where("size(runs) > 0"), "fm-hits")
    hot = words.where("hot").select(F.col("anchor").alias("k"), F.col("seg").alias("th"), "cnt", F.col("words").alias("t"))
    if hot.limit(1).count():
        state = state.unionByName(covered(hot, window, 4 * least).select(F.col("k").alias("anchor"), F.col("th").alias("seg"), F.col("spans").alias("runs")))
    state = state.unionByName(varied.where("cnt > 1").select("anchor", "seg", F.lit(None).cast(RUNS).alias("runs")))
    spans = found.where("NOT alike").join(state, ["anchor", "seg"]).select("k", "th", "start", "size", "runs")
    spans = spans.select("k", "th", F.explode(F.when(F.col("runs").isNull(), F.array(F.struct("start", "size"))).otherwise(F.transform("runs", lambda p: F.struct((F.col("start") + p["start"]).alias("start"), p["size"].alias("size"))))).alias("span"))
    spans = spans.unionByName(found.where("alike").select("k", "th", F.struct("start", "size").alias("span")))
    out = written(spans.groupBy("k", "th").agg(F.collect_set("span").alias("spans")), "fm-covered")
    discard(found, varied, asked, words, hits)
    return out


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    step = np.zeros(len(words) + 1, np.int64)
    at, size = (np.array([s[k] for s in spans], np.int64) for k in ("start", "size"))
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]


def with_spans(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.lit(1).cast("long").alias("cnt"), utf8(f"`{text}`").alias("t"))
    found = covered(texts, window).withColumnsRenamed({"k": "#k", "th": "#th", "spans": "#spans"})
    return docs.join(found, F.col(f"`{key}`").eqNullSafe(F.col("#k")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("#th")), "left").drop("#k", "#th")


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key``, n_words, n_removed and kept_sha256 (kept words joined by a space) of every document."""

    def run(batches):
        for batch in batches:
            n, gone, sha = [], [], []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = raw.split()
                kept = kept_words(words, spans) if spans else words
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["k", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = with_spans(docs.select(key, text), key, text, window).select(F.col(key).alias("k"), utf8(text).alias("t"), "#spans")
    return map_arrow(rows, run, f"k {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("k", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with texts that had covered words cut to their kept words, joined by a space; texts left without words go."""

    rows = with_spans(docs, key, text, window)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    texts[i] = b" ".join(kept_words(texts[i].encode().split(), spans)).decode()
                keep.append(not spans or texts[i] != "")
            columns = [pa.array(texts, batch.schema.types[at]) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(rows, run, docs.schema)
