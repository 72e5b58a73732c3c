"""Document fingerprints: a Merkle tree over sections (parted by blank lines), paragraphs (lines) and their clauses.

A leaf is the hash of a clause's exact text; each node hashes its children's digests. A fingerprint is the root, a
colon, and the leaves' short digests, with ``.`` between paragraphs and ``|`` between sections, from which the inner
nodes are made again. Equal texts have equal fingerprints; branches whose nodes differ say where an edit is.

Null and empty texts have the fingerprint of no leaf, equal to itself. Rows that repeat a key are ordered by text.
Other columns are left out.
"""

from __future__ import annotations

import difflib
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: A clause ends after marks, at a line's end, or at a space after so many characters.
CLAUSE = re.compile(r"[^.,;:!?\n]{1,160}(?:[^.,;:!?\n ]{0,80} ?)[.,;:!?]*[ \t]*|[.,;:!?]+[ \t]*")
SECTION = re.compile(r"(\n[ \t]*\n\s*)")
#: Bytes of a leaf's digest in the fingerprint.
SHORT = 3


def digest(parts: bytes) -> bytes:
    return hashlib.blake2b(parts, digest_size=8).digest()


def tree_of(text: str) -> list[list[list[int]]]:
    """Leaf hashes of each paragraph of each section."""
    hashed = xxhash.xxh3_64_intdigest
    return [[[hashed(c) for c in CLAUSE.findall(line)] for line in section.split("\n")] for section in SECTION.split(text)] if text else []


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The fingerprint, and its leaves' short digests as sorted numbers."""
    sections, shown, every = [], [], []
    for section in tree_of(text):
        nodes, lines = [], []
        for leaves in section:
            packed = np.array(leaves, "<u8")
            nodes.append(digest(packed.tobytes()))
            lines.append(packed.view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes().hex())
            every += leaves
        sections.append(digest(b"".join(nodes)))
        shown.append(".".join(lines))
    root = hashlib.sha256(b"".join(sections)).hexdigest()[:32]
    return f"{root}:{'|'.join(shown)}", np.sort(np.array(every, np.uint64) & np.uint64((1 << 8 * SHORT) - 1))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    both = np.concatenate([a, b])
    values, at = np.unique(both, return_inverse=True)
    return int(np.minimum(np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))).sum())


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """1 if the roots are equal, else the shared leaves' part of all leaves of both (below 1)."""
    if a[0] == b[0]:
        return 1.0
    total = len(a[1]) + len(b[1])
    return min(2 * common(a[1], b[1]) / total, 1 - 1e-9) if total else 0.0


def leaves(print_: str) -> list[list[list[str]]]:
    return [[[line[i : i + 2 * SHORT] for i in range(0, len(line), 2 * SHORT)] for line in s.split(".")] for s in print_.partition(":")[2].split("|")]


def edits(old: list, new: list) -> list[tuple[int, int, int, int]]:
    """Runs (from, to) of both lists that differ, as equal nodes stand in line."""
    plain = lambda nodes: [tuple(map(tuple, n)) if n and isinstance(n[0], list) else tuple(n) for n in nodes]
    return [op[1:] for op in difflib.SequenceMatcher(None, plain(old), plain(new), autojunk=False).get_opcodes() if op[0] != "equal"]


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``b`` whose branches ``a`` doesn't have there, and the place before which one of ``a`` was
    cut; none if the roots are equal. Equal branches are lined up, so what moved along with an edit doesn't differ. The blank lines between sections count as sections."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    left, right, out = leaves(a), leaves(b), []
    for i, i2, j, j2 in edits(left, right):
        both = min(i2 - i, j2 - j)
        for k in range(both):
            for _, _, p, p2 in edits(left[i + k], right[j + k]):
                out += [(j + k, at) for at in range(p, max(p2, p + 1))]
        out += [(s, p) for s in range(j + both, j2) for p in range(len(right[s]))]
        out += [(j2, 0)] * (i + both < i2)
    return out


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and fingerprint of every whole text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t or "")[0] for t in batch.column(1).to_pylist()])], ["k", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, fingerprint string").withColumnRenamed("k", key)


def with_next(docs: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """Rows (part, k, t, halo) such that in order of (part, k, t) each row's next in descending order stands before it.

    Keys are cut into ranges; the largest row of the range before is copied into each range as its first (halo), and the
    largest of all before the smallest. Ranges are cut at quantiles, so their rows follow the number of ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]
    part = F.lit(0) if not cuts else F.coalesce(F.array_size(F.filter(F.lit(cuts), lambda c: c <= F.col("k"))), F.lit(0))
    dealt = rows.withColumn("part", part.cast("int"))
    tops = {r["part"]: r["top"] for r in dealt.groupBy("part").agg(F.max("k").alias("top")).collect()}
    if not tops:
        return dealt.withColumn("halo", F.lit(False))
    order = sorted(tops)
    wanted = {p: tops[order[i - 1]] for i, p in enumerate(order)}
    # the halo rows: by key, the part that each goes to
    pairs = spark.createDataFrame([(p, k) for p, k in wanted.items()], "to int, h long")
    halo = dealt.where(F.col("k").eqNullSafe(F.lit(None).cast("long")) if None in wanted.values() and set(wanted.values()) == {None} else (F.col("k").isin([k for k in wanted.values() if k is not None])) | (F.col("k").isNull() if None in wanted.values() else F.lit(False)))
    halo = halo.groupBy("k").agg(F.max("t").alias("t"))
    halo = halo.join(F.broadcast(pairs), halo["k"].eqNullSafe(pairs["h"])).select("k", "t", F.col("to").alias("part"), F.lit(True).alias("halo"))
    every = dealt.withColumn("halo", F.lit(False)).unionByName(halo)
    return every.repartition(max(len(order), 1), "part").sortWithinPartitions("part", F.col("halo").desc(), F.col("k").asc_nulls_first(), "t")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, its edited text's, and their likeness to it and to the next document in descending key order."""

    def run(batches):
        import collections

        names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = collections.namedtuple("Row", "text print")("", None)
        for batch in batches:
            out = []
            for _, k, t, halo in zip(*(c.to_pylist() for c in batch.columns)):
                own = type(before)(t, fingerprint(t))
                if not halo:
                    new = edited(t, before.text)
                    changed = fingerprint(new)
                    out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), own.print[0], changed[0], likeness(own.print, changed), likeness(own.print, before.print)))
                before = own
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names)

    rows = with_next(docs, key, text).select("part", "k", "t", "halo")
    schema = "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(rows, run, schema).withColumnRenamed("k", key)
