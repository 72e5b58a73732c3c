"""The filter audit, the exact top-k search and the fill-in-middle transformation against brute force, with odd inputs."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphquarry.llm import audit, fim, topk

rng = random.Random(11)
ODD = [None, "", " ", "a", "<P>", "x<S", "a <M> b", "naïve café 中文 🙂 é", "\x00<", ">>P<", "x" * 70_000, "🙂" * 9000 + "<S", "A B C D #1", "A" * 50]


def texts(n):
    return ODD + ["".join(rng.choice("ab é中🙂<PSM>\n") for _ in range(rng.randint(1, 90))) for _ in range(n)]


# ---- fill in middle --------------------------------------------------------------------------------------------------


def plainly(key, x, seed=1):
    x = x or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(x)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not x or any(m in x for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, x
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{x[b:]}<P>{x[:a]}<M>{x[a:b]}"
    return n, "psm", a, b - a, f"<P>{x[:a]}<S>{x[b:]}<M>{x[a:b]}"


def test_fill_in_middle(spark):
    rows = [(i if i % 29 else None, t, "clash", 1) for i, t in enumerate(texts(400))]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    found = fim.restore(fim.fill_in_middle(df)).collect()
    key = lambda r: repr(r)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in found), key=key)
    assert got == sorted(((i, *plainly(i, t), t or "") for i, t, *_ in rows), key=key)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0


def test_kernel_takes_slices_of_batches():
    every = pa.array([t or "" for t in texts(60)])
    cut = every.slice(9, 40)
    draws = [np.array([rng.randrange(2**32) for _ in range(40)]) for _ in range(2)]
    got = fim.transformed(cut, *draws, np.zeros(40, bool), np.arange(40) % 2 == 0)
    assert fim.rebuilt(got.column(4), got.column(1)).to_pylist() == cut.to_pylist()
    assert fim.transformed(every.slice(0, 0), *(d[:0] for d in draws), np.zeros(0, bool), np.zeros(0, bool)).num_rows == 0


# ---- top k -----------------------------------------------------------------------------------------------------------


def nearest(rows, k, queries):
    fine = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in fine if queries(i)}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i))[:k]
        out += [(i, rank + 1, j, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, j) in enumerate(scored)]
    return sorted(out)


def vectors(n, dims, spread=1.0):
    centres = np.random.default_rng(3).normal(size=(5, dims))
    g = np.random.default_rng(5)
    return [(i, [float(x) for x in (centres[i % 5] + g.normal(size=dims) * spread) / np.sqrt(dims)]) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(300, 40, 0.2) + [(None, [0.1] * 40), (900, None), (901, [0.5] * 39 + [None]), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] * 40)],
    [(i, [0.5, -0.25]) for i in range(200)] + [(7, [0.5, -0.25]), (20, [0.5, -0.25]), (20, [1.0, 1.0])],  # ties, repeated rows, two vectors of a query id
    [(i, [float((i * 7919) % 1000), -1.0, 3.5e3]) for i in range(120)],  # beyond 2**24
    [(i, [float((i * 7919) % 100) * 1e12 + 0.5, 2.0 - i]) for i in range(120)],  # beyond a long: clamped, in their true order
    [(i, [1.0] * (i % 40)) for i in range(80)],  # of unequal length, and empty ones
    [(0, [1.0])],
], ids=["clusters", "ties", "large", "huge", "ragged", "alone"])
@pytest.mark.parametrize("block", [40, topk.BLOCK])
def test_top_k(spark, rows, block):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    got = topk.top_k(df.where("vec_id % 10 = 0"), df, 5, block=block)
    assert sorted(map(tuple, got.collect())) == nearest(rows, 5, lambda i: i % 10 == 0)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame(vectors(9, 4), "vec_id long, embedding array<float>")
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_bounds_spare_work():
    """Candidates that can't reach the best are left out of later dimensions."""
    rows = vectors(3000, 64, 0.2)
    ids, x = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows]))
    packed = lambda keep: [topk.Block(**b) for b in topk.blocks(iter([pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(list(x[keep] / 256))], ["i", "v"])]), 64 * 500)]
    (queries,) = packed(ids % 100 == 0)
    best = topk.Best(queries, np.zeros(len(queries.ids)), 5)
    done = sum(topk.search(c, best) for c in packed(ids >= 0))
    assert done < 0.6 * len(queries.ids) * x.size


# ---- audit -----------------------------------------------------------------------------------------------------------


def audited(docs, labels):
    """By the definitions: every document through every order."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    keyed = {}
    for k, t, _ in docs:
        if k is not None:
            keyed[t or ""] = min(k, keyed.get(t or "", k))
    failing = []
    for k, t, part in docs:
        x = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": k is not None and keyed[x] < k}
        failing.append((part or "", {z for z in bad if bad[z]}, k in good, k in toxic))
    out, removed_in = {}, {}
    for part in {p for p, *_ in failing}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, z in enumerate(order):
                before = set(order[:step])
                own = [(b, g, t) for p, b, g, t in failing if p == part]
                gone = [(b, g, t) for b, g, t in own if z in b and not b & before]
                out[part, order, step + 1] = [sum(not b & (before | {z}) for b, *_ in own), len(gone), sum(z in b and bool(b & before) for b, *_ in own), sum(b == {z} for b, *_ in own), sum(g for _, g, _ in gone), sum(t for *_, t in gone)]
                removed_in[part, z] = removed_in.get((part, z), 0) + len(gone)
    return sorted((*k, *v, removed_in[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit(spark):
    words = ["alpha", "Beta", "GAMMA", "d#", "eps", "ζ", "é"] + [f"w{i}" for i in range(150)]
    some = ODD + [" ".join(rng.choice(words[: rng.choice([5, 20, 157])]) for _ in range(rng.choice([3, 99, 100, 130]))) for _ in range(60)]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(some)]
    docs += [(500 + i, docs[i % 9][1], "en") for i in range(60)] + [docs[20], docs[20], (20, "other", "fr"), (None, "", "en"), (None, some[30], "de"), (2000, "only here", "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 560, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    d = spark.createDataFrame([(*r, "clash", 3) for r in docs], "doc_id long, text string, lang string, part string, mask int").repartition(4)
    held = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = sorted(map(tuple, audit.audit(d, held).collect()))
    assert got == audited(docs, labels)
    none = audited(docs, [])
    assert sorted(map(tuple, audit.audit(d, held.limit(0)).collect())) == none
    assert audit.audit(d.limit(0), held).count() == 0
