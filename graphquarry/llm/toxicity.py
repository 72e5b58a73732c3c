"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct terms of a text. The pair weights
catch what additive weights miss, such as an insult beside a group mention. The model is learned from a bounded sample
of labelled rows (``SAMPLE``) and scores every text whole in one pass without a shuffle.

Null and empty texts have no terms and get the bias alone. Null labels aren't learned from; of different labels of a
document each counts, and of rows that repeat a key the least text. Without labelled rows the score is 0.5 and predicted 1 is not given. Other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashes, map_arrow, utf8

#: Labelled rows that the model is learned from, at most; those with the lowest hashes of their ids.
SAMPLE = 12_000
BITS, TERMS, FACTORS, ROUNDS = 20, 512, 8, 300
EDGE = b".,;:!?\"'()[]{}<>*_-|#/\\\xe2\x80\x9c"


class Terms(dict):
    """The hashed term of a raw word: its bytes without marks around it, in lower case (ASCII letters)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = zlib.crc32(word.strip(EDGE).lower()) >> (32 - BITS)
        return found


def terms_of(terms: Terms, raw: bytes) -> np.ndarray:
    return np.fromiter(set(map(terms.__getitem__, raw.split())), np.int64)


class Machine:
    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias = bias
        self.place = np.full(1 << BITS, len(terms), np.int32)
        self.place[terms] = np.arange(len(terms))
        self.weights = np.append(weights, 0.0)
        self.factors = np.vstack([factors, np.zeros((1, factors.shape[1]))])

    def score(self, found: np.ndarray) -> float:
        at = self.place[found]
        at = at[at < len(self.weights) - 1]
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss with decay, over the terms that tell the labels apart best (by chi-square)."""
    n = len(rows)
    if n == 0 or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (n + 1) if n else 0.4999
        return Machine(np.zeros(0, np.int64), float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, FACTORS)))
    flat = np.concatenate(rows)
    label_of = np.repeat(labels, [len(r) for r in rows])
    both = np.bincount(flat, minlength=1 << BITS).astype(float)
    ones = np.bincount(flat, weights=label_of, minlength=1 << BITS)
    share = labels.mean()
    gap = ones - both * share
    chi = np.where(both >= 3, gap**2 / np.maximum(both * share * (1 - share), 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:TERMS]
    best = np.sort(best[chi[best] > 10])
    place = np.full(1 << BITS, -1, np.int64)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best)))
    at = place[flat]
    row_of = np.repeat(np.arange(n), [len(r) for r in rows])
    x[row_of[at >= 0], at[at >= 0]] = 1
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(len(best)), rng.normal(0, 0.01, (len(best), FACTORS))]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, ROUNDS + 1):
        bias, w, v = params
        xv = x @ v
        z = bias[0] + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        xe = x.T @ error
        grads = [np.array([error.sum()]), xe + 1e-5 * w, x.T @ (error[:, None] * xv) - xe[:, None] * v + 1e-4 * v]
        for k, g in enumerate(grads):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.999 * var[k] + 0.001 * g * g
            params[k] = params[k] - 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(best, float(params[0][0]), params[1], params[2])


def learn(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """``held_out``: a function of the key column; rows for which it holds are never learned from."""
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k")))
    chosen = lowest_hashes(chosen.withColumn("all", F.lit(0)), "all", sample).drop("all")
    rows = docs.select(F.col(key).alias("k"), utf8(text).alias("t")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select("t", "y")

    def run(batches):
        terms = Terms()
        for batch in batches:
            found = [terms_of(terms, t).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in found], pa.binary()), batch.column(1)], ["terms", "y"])

    got = sorted((bytes(r["terms"]), r["y"]) for r in map_arrow(rows, run, "terms binary, y int").collect())
    return fit([np.sort(np.frombuffer(t, np.int32)) for t, _ in got], np.array([y for _, y in got], float))


def score_toxicity(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and predicted of every whole text."""
    kept = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        terms, machine = Terms(), kept.value
        for batch in batches:
            scores = [machine.score(terms_of(terms, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["k", "score", "predicted"])

    return map_arrow(docs.select(F.col(key).alias("k"), utf8(text).alias("t")), run, f"k {kind}, score double, predicted int").withColumnRenamed("k", key)
