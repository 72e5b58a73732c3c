"""N-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

Documents with equal shingle sets are one class. Sizes are cut into bands such that linked sizes lie in one band or in
neighbouring ones. Linked sets differ in at most k(band) shingles, so of the k+1+spare parts into which the shingles are
dealt by hash, more than spare are equal; a tile holds the classes of a band that agree in a part. Each class leaves out
its spare parts of fewest shingles, which unlinked sets agree in most easily: of a pair's equal parts, the last one by
shingles and content comes after spare others on both sides, so it always makes a tile. In a tile, pairs pass by sizes,
then by bitmaps (bits that only one side has bound the overlap from above; short ones in the tile, then ones as long as
the sets), and then by the exact intersection of sorted arrays.

Tiles are first searched as stars around their smallest class. Of the tiles that still hold several components, crowded
ones (more than ``CROWDED`` classes) are searched around some classes of lowest hash. Then, in every other open tile, the
classes outside of its largest component are held against all of its other components: at most CROWDED pairs a row. The
classes of crowded tiles meet by rare shingles instead, whatever their tiles: their shingles are ordered by how many of
these classes have each, then by hash. A linked pair shares at least 2p/(1+p) of the smaller set and p of the larger one,
so its rarest common shingle lies in the first (1-p)/(1+p) of the smaller set and in the first 1-p of the larger one. Sets
that were edited too much fill their first places with shingles that nobody else has, so they meet nobody. Of those that do
meet, the places of the rarest common shingle bound the overlap, and so do bitmaps of the shingles that others have, without
those that nobody else has; a pair that meets again soon after isn't given again. So every pair that shares a tile is linked,
connected, ruled out or compared, no tile is gathered in one place, and none is expanded into all of its pairs.

Words are runs without ASCII white space, A-Z in lower case; a shingle is ``SHINGLE`` words, and a shorter text's whole
word sequence is one. Null, empty and blank texts have no shingles and link with nothing. Shingles are compared by their
64-bit hashes, classes by 128 bits. Repeated rows are one class. Other columns are kept by ``one_of_each`` and left out
by ``jaccard_components``.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, map_arrow, utf8, written
from .components import components
from .hashing import P1, P2, P3, P4, WordHashes, mixed, signed

SHINGLE, PERCENT = 4, 85
LONGS = 8
#: Classes that each crowded tile is held against in a round, and rounds at most before the exhaustive one.
LEADERS, ROUNDS = 2, 1
#: Classes of an open tile beyond which they meet by rare shingles.
CROWDED = 32
#: Rarer shingles that go with each rare shingle of a crowded class, so that a pair that they brought together isn't given again.
BEFORE = 8
#: Sets of a task whose parts have been given; an equal set met again in the task gives none.
SEEN = 200_000


def bands(percent: int, most: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, most differing shingles of a linked pair up to that size)."""
    out, low = [], 1
    while low < most:
        high = max(low, low * 100 // percent)
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


def shingles(hashes: WordHashes, raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = hashes.of(words)
    n = min(size, len(w))
    found = np.full(len(w) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i, p in zip(range(n), (P1, P2, P3, P4) * (n // 4 + 1)):
            found = mixed(found * p + w[i : len(w) - n + 1 + i])
    return np.unique(found)


def part_keys(own: np.ndarray, weight: np.ndarray, band: int, differing: int) -> np.ndarray:
    """A key of each part of a set in a band's tiles, without the spare parts."""
    spare = 2 + differing // 4
    parts = differing + 1 + spare
    part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight)])[cut]
    names = mixed(np.diff(total) ^ mixed((np.uint64(band) << np.uint64(32) | np.arange(parts, dtype=np.uint64)) * P1 + P4))
    return names[np.lexsort((names, np.diff(cut)))[spare:]]


def signature(own: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * LONGS, bool)
    bits[(own & np.uint64(64 * LONGS - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


BITS = [f"b{i}" for i in range(LONGS)]


def sketched(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """A row per document: k, th (text hash), n, c (class), s (its first 64 bits), bitmap and tile keys; written once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        hashes, seen, limits = WordHashes(), set(), bands(percent)
        lows = [b[0] for b in limits]
        for batch in batches:
            sizes, classes, firsts, maps, keys = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                own = shingles(hashes, raw, size)
                sizes.append(len(own))
                if not len(own):
                    classes.append(None)
                    firsts.append(None)
                    maps.append(np.zeros(LONGS, np.int64))
                    keys.append(np.zeros(0, np.int64))
                    continue
                name = xxhash.xxh3_128_digest(own.tobytes())
                classes.append(name)
                firsts.append(int.from_bytes(name[:8], "little", signed=True))
                maps.append(signature(own))
                if name in seen:
                    keys.append(np.zeros(0, np.int64))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                band = bisect.bisect_right(lows, len(own)) - 1
                with np.errstate(over="ignore"):
                    weight = mixed(own * P3 + P2)
                    found = [part_keys(own, weight, b, limits[b][2]) for b in (band, band + 1) if limits[b][2]]
                keys.append(signed(np.concatenate(found)) if found else np.zeros(0, np.int64))
            grid = np.vstack(maps) if maps else np.zeros((0, LONGS), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            arrays = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(firsts, pa.int64())]
            arrays += [pa.array(grid[:, i]) for i in range(LONGS)]
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, ["k", "th", "n", "c", "s", *BITS, "keys"])

    schema = f"k {kind}, th long, n long, c binary, s long, {', '.join(f'{b} long' for b in BITS)}, keys array<long>"
    return written(map_arrow(docs.select(F.col(key).alias("k"), utf8(text).alias("t"), F.xxhash64(text).alias("th")), run, schema), "jaccard-sketches")


def may_link(a: str, b: str, percent: int, of: str = "n") -> Column:
    """By sizes and by bitmaps of the ``of`` shingles that can be common: false only for pairs that can't be linked."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    only = lambda p, q: sum((F.bit_count(p(c).bitwiseAND(F.bitwise_not(q(c)))) for c in BITS[1:]), F.bit_count(p(BITS[0]).bitwiseAND(F.bitwise_not(q(BITS[0])))))
    overlap = F.least(x(of) - only(x, y), y(of) - only(y, x))
    return (100 * x("n") >= percent * y("n")) & (100 * y("n") >= percent * x("n")) & ((100 + percent) * overlap >= percent * (x("n") + y("n")))


def packed_map(own: np.ndarray) -> bytes:
    """The set's size, and a bitmap of four to eight bits a shingle by the hashes' low bits (so halves fold together)."""
    bits = np.zeros(max(64, 1 << (4 * len(own) - 1).bit_length()), bool)
    bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return len(own).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def maps_allow(a: bytes, b: bytes, percent: int) -> bool:
    """False only for sets that aren't linked."""
    sizes, maps = [int.from_bytes(m[:8], "little") for m in (a, b)], [np.frombuffer(m, np.uint64, -1, 8) for m in (a, b)]
    while len(maps[0]) != len(maps[1]):
        k = int(len(maps[1]) > len(maps[0]))
        half = len(maps[k]) // 2
        maps[k] = maps[k][:half] | maps[k][half:]
    only = [int(np.bitwise_count(maps[i] & ~maps[1 - i]).sum()) for i in (0, 1)]
    return (100 + percent) * min(sizes[0] - only[0], sizes[1] - only[1]) >= percent * sum(sizes)


def sets_linked(a: bytes, b: bytes, percent: int) -> bool:
    """Exactly, by merging the sorted arrays."""
    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def texts_of(names: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(c, t): the text that stands for each of the classes ``names`` (c); repeated rows give it again."""
    needed = written(names.join(classes.select("c", "rep"), "c").select("c", F.col("rep.k").alias("k2"), F.col("rep.th").alias("th2")), "jaccard-needed")
    some = bounded_broadcast(needed)
    own = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), utf8(text).alias("t"))
    return own.join(some, F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2"))).select("c", "t")


def rare_pairs(members: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Pairs (x, y) of the classes ``members`` (s, label) of other labels that sizes, bitmaps and rare shingles allow.

    Shingles that only classes of one label hold can't be what a pair shares, so they stand first in the order of rareness,
    with those of a single class, and aren't joined. Bitmaps are of the others: what a class lacks isn't hidden by its own
    edits. A pair is given at its rarest common shingle, and at later ones only where ``BEFORE`` others or more lie between.
    Classes that no other class shares enough shingles with are left out before shingles are joined with their counts."""

    def exploded(batches):
        hashes = WordHashes()
        for batch in batches:
            for c, raw, label in zip(*(column.to_pylist() for column in batch.columns)):
                found = shingles(hashes, raw, size)
                own, group = (np.full(len(found), x, np.int64) for x in (int.from_bytes(c[:8], "little", signed=True), label))
                for at in range(0, len(found), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(found[part])), pa.array(own[part]), pa.array(group[part])], ["g", "s", "l"])

    members = written(members.distinct().join(classes.select("c", "s", "n"), "s"), "jaccard-crowd")
    texts = texts_of(members.select("c"), classes, docs, key, text).dropDuplicates(["c"])
    texts = texts.join(members.select("c", F.col("label").cast("long").alias("l")).dropDuplicates(["c"]), "c").select("c", "t", "l")
    each = written(map_arrow(texts, exploded, "g long, s long, l long"), "jaccard-crowd-shingles")
    alone = each.groupBy("g").agg(F.count("*").alias("df"), F.min("s").alias("s")).where("df = 1").groupBy("s").agg(F.count("*").alias("alone"))
    whole, members = members, members.join(alone, "s", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).drop("alone")
    members = written(members, "jaccard-linkable")
    crowd, each = each, each.join(bounded_broadcast(members.select("s")), "s", "left_semi")
    held = each.groupBy("g").agg(F.count("*").alias("df"), F.min("l").alias("low"), F.max("l").alias("high")).where("low < high").select("g", "df")
    own = Window.partitionBy("s")
    order = own.orderBy("df", "g")
    bits = [F.bit_or(F.expr(f"IF((g & {64 * LONGS - 1}) DIV 64 = {i}, shiftleft(1L, CAST(g & 63 AS INT)), 0L)")).over(own).alias(b) for i, b in enumerate(BITS)]
    before = F.collect_list("g").over(order.rowsBetween(-BEFORE, -1)).alias("before")
    ranked = each.drop("l").join(held, "g").select("g", "s", F.row_number().over(order).alias("at"), before, F.count("*").over(own).alias("m"), *bits)
    ranked = ranked.join(members, "s").withColumn("at", F.col("n") - F.col("m") + F.col("at"))
    reach = lambda share: F.floor(F.col("n") * (100 - percent) / share) + 1
    first = written(ranked.where(F.col("at") <= reach(100)).withColumn("small", F.col("at") <= reach(100 + percent)), "jaccard-rare")
    discard(crowd, whole, members)
    a, b = first.where("small").alias("a"), first.alias("b")
    later = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.s") < F.col("b.s")))
    rest = (100 + percent) * (1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))) >= percent * (F.col("a.n") + F.col("b.n"))
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & later & (F.col("a.label") != F.col("b.label")) & rest & may_link("a", "b", percent, "m") & ~F.arrays_overlap("a.before", "b.before"))
    return met.select(F.least("a.c", "b.c").alias("x"), F.greatest("a.c", "b.c").alias("y"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) of classes that are linked: by bitmaps that grow with the sets, then what is left by the sets."""
    for make, test, name in ((packed_map, maps_allow, "sieved"), (np.ndarray.tobytes, sets_linked, "links")):
        if pairs.isEmpty():
            return pairs
        own = texts_of(pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct(), classes, docs, key, text)

        def payloads(batches, make=make):
            hashes = WordHashes()
            for batch in batches:
                names, out = [], []
                for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = shingles(hashes, raw, size)
                    if xxhash.xxh3_128_digest(found.tobytes()) == c:  # a repeated id can have another text
                        names.append(c)
                        out.append(make(found))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.binary())], ["c", "own"])

        def passing(batches, test=test):
            for batch in batches:
                keep = [test(a, b, percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

        own = written(map_arrow(own, payloads, "c binary, own binary").dropDuplicates(["c"]), "jaccard-payloads")
        left, right = (own.withColumnsRenamed({"c": n, "own": f"own_{n}"}) for n in "xy")
        spent = pairs
        pairs = written(map_arrow(pairs.join(left, "x").join(right, "y").select("x", "y", "own_x", "own_y"), passing, "x binary, y binary"), f"jaccard-{name}")
        discard(spent, own)
    return pairs


def candidates(raw: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of classes, from pairs (s1, s2) of their first 64 bits, that sizes and short bitmaps allow."""
    two = raw.select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")).distinct()
    a, b = classes.withColumnRenamed("s", "s1").alias("a"), classes.withColumnRenamed("s", "s2").alias("b")
    allowed = two.join(a, "s1").join(b, "s2").where(may_link("a", "b", percent))
    return written(allowed.select(F.col("a.c").alias("x"), F.col("b.c").alias("y")), "jaccard-pairs")


def labelled(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, s, label, crowded) of the tiles that still hold more than one of the components ``found``."""
    roots = found.where("node != root").join(classes.select(F.col("c").alias("node"), "s"), "node").join(classes.select(F.col("c").alias("root"), F.col("s").alias("label")), "root").select("s", "label")
    now = members.select("key", "s").join(bounded_broadcast(written(roots, "jaccard-roots")), "s", "left").withColumn("label", F.coalesce("label", "s"))
    parted = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low < high").select("key", (F.col("rows") > CROWDED).alias("crowded"))
    return written(now.join(parted, "key"), "jaccard-open")


def classed(docs: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(k, th, n, c) of every document, and (c, root, component) of every class: its component's smallest class and smallest id (null if all are)."""
    base = sketched(docs, key, text, size, percent)
    classes = base.where("c IS NOT NULL").groupBy("c", "s").agg(F.min("k").alias("k"), F.min(F.struct("k", "th")).alias("rep"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in BITS])
    classes = written(classes, "jaccard-classes")
    tiles = base.select(F.explode("keys").alias("key"), "s")
    live = written(tiles.groupBy("key").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low < high").select("key", "low"), "jaccard-tiles")
    members = written(tiles.join(live, "key").distinct(), "jaccard-members")
    slim = written(base.select("k", "th", "n", "c"), "jaccard-documents")
    discard(base, live)
    check = lambda raw: verified(candidates(raw, classes, percent), classes, docs, key, text, size, percent)
    merged = lambda found, more: components(found.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(more))
    found = components(check(members.where("s != low").select(F.col("low").alias("s1"), F.col("s").alias("s2"))))
    spent, members = members, labelled(members, classes, found)
    discard(spent)
    about = classes.drop("k", "rep")
    for turn in range(ROUNDS):  # the same classes lead many tiles, as they have the lowest hashes of the turn
        crowd = written(members.where("crowded").join(about, "s"), "jaccard-crowded")
        picks = [F.min_by("s", F.xxhash64("s", F.lit(turn * LEADERS + i))) for i in range(LEADERS)]
        leads = crowd.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("leads")).select("key", F.explode("leads").alias("s"))
        a, b = crowd.alias("a"), leads.join(crowd, ["key", "s"]).alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & may_link("a", "b", percent))
        met = written(met.select(F.least("a.c", "b.c").alias("x"), F.greatest("a.c", "b.c").alias("y")).distinct(), "jaccard-led")
        more = verified(met, classes, docs, key, text, size, percent)
        discard(crowd)
        if not more.limit(1).count():
            break
        found = merged(found, more)
        spent, members = members, labelled(members, classes, found)
        discard(spent)
    sparse = members.where("NOT crowded")
    main = sparse.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    full = written(sparse.join(main, "key").join(about, "s"), "jaccard-rest")
    a, b = full.where("label != main").alias("a"), full.alias("b")
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.main")) | (F.col("a.s") < F.col("b.s"))) & may_link("a", "b", percent))
    rest = rest.select(F.least("a.c", "b.c").alias("x"), F.greatest("a.c", "b.c").alias("y"))
    rare = rare_pairs(members.where("crowded").select("s", "label"), classes, docs, key, text, size, percent)
    rest = written(rest.unionByName(rare).distinct(), "jaccard-pairs")
    discard(full, members)
    found = merged(found, verified(rest, classes, docs, key, text, size, percent))
    rooted = classes.select("c", "k").join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = rooted.groupBy("root").agg(F.min("k").alias("component"))
    return slim, written(rooted.join(least, "root").select("c", "root", "component"), "jaccard-components")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``key``, n_shingles, component_id (the smallest id reachable by links) of every document."""
    base, named = classed(docs, key, text, size, percent)
    return base.select("k", "n", "c").join(named.drop("root"), "c", "left").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id; rows without shingles stay.

    Rows are told apart by id and text. A null id counts as larger than any other; of
    several texts under a component's smallest id, the one of least hash stays."""
    base, named = classed(docs, key, text, size, percent)
    found = written(base.select("k", "th", "c").join(named, "c").select("k", "th", "root", F.col("k").eqNullSafe(F.col("component")).alias("head")), "jaccard-result")
    heads = found.where("head").groupBy("root").agg(F.min("th").alias("low"), F.max("th").alias("high"))
    several = heads.where("low < high").select("root", "low")
    others = found.where("head").join(several, "root").where("th > low")
    gone = written(found.where("NOT head").select("k", "th").union(others.select("k", "th")).distinct().toDF("#k", "#th"), "jaccard-gone")
    gone = bounded_broadcast(gone)
    left = docs.join(gone, F.col(key).eqNullSafe(F.col("#k")) & (F.xxhash64(text) == F.col("#th")), "left_anti")
    twice = written(found.where("head").groupBy("k", "th").count().where("count > 1").select(F.col("k").alias("#k"), F.col("th").alias("#th")), "jaccard-twice")
    n = twice.count()
    if not n:
        return left
    same = F.col(key).eqNullSafe(F.col("#k")) & (F.xxhash64(text) == F.col("#th"))
    twice = bounded_broadcast(twice)
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates([key, text]))
