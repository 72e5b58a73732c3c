"""Language identification by nearest centroid.

A text is the vector of its hashed character 1- to 3-grams within words (runs of Unicode letters), log (1 + count) * idf, of length 1. Each
language has several centroids, found by clustering a bounded sample of its labelled texts by cosine. The nearest
centroid's language is predicted; a text whose cosine is below its language's floor is rejected as too far from all.
Floors come from texts held against centroids that were clustered without them (two halves, each against the other's),
cut to runs of some numbers of words, as short texts lie farther away. A few junk or mislabelled texts don't move them.
A language with a single text has the other languages' median floors; without any, nothing is too far.

A text that is null or has no letter is ``und`` with score 0, and rejected. Without anything to learn from, all texts
are. Languages in which no sampled text has a letter aren't learned. Of rows that repeat a key and a language the least
text is learned from. Other columns are left out.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lowest_hashes, map_arrow, written

#: Sampled texts of a language, at most (the lowest hashes of their ids). Of more than LANGUAGES languages each has fewer,
#: one at least, so that about as many texts are learned from in all.
SAMPLE, LANGUAGES = 1000, 200
BITS, CENTROIDS, ROUNDS = 12, 3, 10
#: A text is rejected below this share of this quantile of its language's cosines, at its number of words; longer texts
#: than the last count as of that length.
FLOOR, QUANTILE = 0.65, 0.1
LENGTHS = (1, 2, 4, 8, 16, 32, 64)
UNKNOWN = "und"
#: Texts that are counted at once.
BATCH = 256
WORD = regex.compile(r"\p{L}+")


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point, whether it is a letter (general category L)."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """1 + log of each n-gram's count, and the number of words, by text; zeros where a text has no letter.

    All texts stand in one array of code points, in which whatever isn't a letter is 0, the edge of words. An n-gram of
    one, two or three places counts if its middle (of two: any) is a letter, so that none crosses from word to word.
    """
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), "<u4") for t in texts]
    size = np.array([len(p) for p in points], np.int64)
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    letter = letters()[flat]
    flat = np.where(letter, flat, 0).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32) << BITS, size)
    out = np.zeros(len(texts) << BITS, np.int64)
    mix = lambda h: (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    with np.errstate(over="ignore"):
        one = flat * np.uint32(0x85EBCA77)
        two = one[:-1] + flat[1:] * np.uint32(0xC2B2AE3D) + np.uint32(7)
        three = two[:-1] + flat[2:] * np.uint32(0x27D4EB2F) + np.uint32(11)
        for hashed, at, counts in ((one, row, letter), (two, row[:-1], letter[:-1] | letter[1:]), (three, row[:-2], letter[1:-1])):
            out += np.bincount(at[counts] + mix(hashed[counts]).astype(np.int32), minlength=len(out))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    words = np.bincount((row >> BITS)[first], minlength=len(texts))
    return np.log1p(out.reshape(len(texts), 1 << BITS).astype(np.float32)), words


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, floors: np.ndarray):
        self.languages, self.centroids, self.idf, self.floors = languages, centroids, idf, floors

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        x, words = counted([t or "" for t in texts])
        x *= self.idf
        cosine = (x @ self.centroids.T) / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        out = [], [], []
        for b, s, n in zip(best.tolist(), score.tolist(), words.tolist()):
            out[0].append(self.languages[b] if n else UNKNOWN)
            out[1].append(s if n else 0.0)
            out[2].append(not n or bool(s < np.interp(np.log(n), np.log(LENGTHS), self.floors[b])))
        return out


def clustered(own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    centers = own[rng.choice(len(own), min(CENTROIDS, len(own)), replace=False)]
    for _ in range(ROUNDS):
        near = (own @ centers.T).argmax(axis=1)
        centers = unit(np.vstack([own[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))]))
    near = np.bincount((own @ centers.T).argmax(axis=1), minlength=len(centers))
    return centers[near >= min(QUANTILE * len(own), near.max())]  # a few outliers have no centroid of their own


class Sample:
    """What is learned from a text: a name by which equal ones are known, and the counts of the whole text (place 0) and of
    a run of each of LENGTHS words (the places after it, without any where the text is shorter), as places and values."""

    def __init__(self, name: int, at: np.ndarray, value: np.ndarray):
        self.name, self.at, self.value = name, at, value

    @classmethod
    def of(cls, text: str) -> Sample | None:
        """None without a letter."""
        words = WORD.findall(text)
        if not words:
            return None
        every = " ".join(words)
        name = zlib.crc32(every.encode("utf-8", "replace"))
        runs = [" ".join(words[name % (len(words) - n + 1) :][:n]) if len(words) >= n else "" for n in LENGTHS]
        found = counted([every, *runs])[0].ravel()
        at = np.flatnonzero(found)
        return cls(name, at.astype(np.int32), found[at])


def dense(samples: list[Sample], place: int) -> np.ndarray:
    """A row for each sample's counts at a place."""
    out = np.zeros((len(samples), 1 << BITS), np.float32)
    for row, s in zip(out, samples):
        a, b = np.searchsorted(s.at, (place << BITS, (place + 1) << BITS))
        row[s.at[a:b] - (place << BITS)] = s.value[a:b]
    return out


def floors_of(samples: list[Sample], own: np.ndarray, idf: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A floor for each of LENGTHS; nan where the language has a single text. Equal texts are in one half."""
    turn = {name: i % 2 for i, name in enumerate(sorted({s.name for s in samples}))}
    half = np.array([turn[s.name] for s in samples])
    if not half.any():
        return np.full(len(LENGTHS), np.nan)
    centers = [clustered(own[half != h], rng) for h in (0, 1)]
    out = []
    for place in range(1, len(LENGTHS) + 1):
        cosines = []
        for a in range(0, len(samples), BATCH):
            runs, side = dense(samples[a : a + BATCH], place), half[a : a + BATCH]
            for h in (0, 1):
                some = runs[(side == h) & runs.any(axis=1)]
                if len(some):
                    cosines.append((unit(some * idf) @ centers[h].T).max(axis=1))
        out.append(FLOOR * float(np.quantile(np.concatenate(cosines), QUANTILE)) if cosines else out[-1])
    return np.array(out)


def fit(samples: list[Sample], languages: list[str], seed: int = 5) -> Centroids:
    """Rows of one language at a time are made dense."""
    if not samples:
        return Centroids([], np.zeros((0, 1 << BITS)), np.ones(1 << BITS, np.float32), np.zeros((0, len(LENGTHS))))
    held = np.zeros(1 << BITS)
    for s in samples:
        held[s.at[: np.searchsorted(s.at, 1 << BITS)]] += 1
    idf = (np.log((1 + len(samples)) / (1 + held)) + 1).astype(np.float32)
    by = {}
    for s, lang in zip(samples, languages):
        by.setdefault(lang, []).append(s)
    rng, names, found, floors = np.random.default_rng(seed), [], [], []
    for lang in sorted(by):
        own = unit(dense(by[lang], 0) * idf)
        centers = clustered(own, rng)
        names += [lang] * len(centers)
        found.append(centers)
        floors += [floors_of(by[lang], own, idf, np.random.default_rng(seed))] * len(centers)
    floors = np.array(floors)
    some = floors[~np.isnan(floors[:, 0])]
    floors[np.isnan(floors[:, 0])] = np.median(some, axis=0) if len(some) else 0.0
    return Centroids(names, np.vstack(found), idf, floors)


def learn(docs: DataFrame, held_out, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Centroids:
    """``held_out``: a function of the key column; rows for which it holds are never learned from."""
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("k").isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(F.col("k")))
    chosen = written(lowest_hashes(rows, "lang", sample).select("k", F.col("lang").alias("l")), "language-sample")
    n = chosen.select("l").distinct().count()
    if n > LANGUAGES:
        order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
        chosen = chosen.withColumn("#at", F.row_number().over(order)).where(F.col("#at") <= max(1, LANGUAGES * sample // n)).drop("#at")
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")).join(F.broadcast(chosen), "k").where(F.col("lang") == F.col("l")).where(F.col("t").isNotNull())
    rows = got.groupBy("k", "lang").agg(F.min("t").alias("t")).select("lang", "t")

    def run(batches):
        for batch in batches:
            out = [(lang, s) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := Sample.of(t))]
            columns = [pa.array([lang for lang, _ in out], pa.string()), pa.array([s.name for _, s in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.at.tobytes() for _, s in out], pa.binary()), pa.array([s.value.tobytes() for _, s in out], pa.binary())], ["lang", "name", "at", "value"])

    # counts have a bounded size, whatever the texts' lengths
    found = sorted((r["lang"], r["name"], bytes(r["at"]), bytes(r["value"])) for r in map_arrow(rows, run, "lang string, name long, at binary, value binary").collect())
    return fit([Sample(name, np.frombuffer(at, np.int32), np.frombuffer(value, np.float32)) for _, name, at, value in found], [f[0] for f in found])


def identify(docs: DataFrame, model: Centroids, key: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """``key``, lang_pred, score and rejected of every whole text; one pass, no shuffle. ``extra``: columns carried along
    (the results then stand after them)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    carried = [docs.schema[c] for c in (extra if extra is not None else [key])]
    place = len(carried)

    def run(batches):
        model = kept.value
        for batch in batches:
            for part in (batch.slice(a, BATCH) for a in range(0, batch.num_rows, BATCH)):
                langs, scores, far = model.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:place], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], [*part.schema.names[:place], "lang_pred", "score", "rejected"])

    schema = T.StructType([*carried, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_arrow(docs.select(*[F.col(f"`{c.name}`") for c in carried], F.col(text).alias("#text")), run, schema)
