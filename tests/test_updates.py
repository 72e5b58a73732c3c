"""Held tables in buckets, and changed documents carried through all stores, against plain Python."""

import os
import random

from pyspark.sql import functions as F

from graphquarry.operators import incremental, updates
from graphquarry.sources.buckets import BucketTable

rng = random.Random(17)


def stamps(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_buckets(spark, tmp_path):
    rows = [(f"k{i}", i, "x" * 50) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, 1, "y")], "chunk_id string, n int, t string")
    held = BucketTable.create(df, str(tmp_path / "t"), "chunk_id", 32)
    want = {k: n for k, n, _ in rows}
    assert {r["chunk_id"]: r["n"] for r in held.read().collect()} == want
    before = stamps(tmp_path / "t")
    new = spark.createDataFrame([("k3", -1, "", 1), ("k3", -2, "", 2), ("fresh", 7, "", 1), (None, 5, "", 1)], "chunk_id string, n int, t string, pos int")
    assert held.upsert(new) == 2
    want |= {"k3": -2, "fresh": 7}
    assert {r["chunk_id"]: r["n"] for r in held.read().collect()} == want
    after = stamps(tmp_path / "t")
    assert sum(after.get(f) == t for f, t in before.items()) == len(before) - len({f.split("bucket=")[1].split("/")[0] for f in set(before) ^ set(after)} & {f.split("bucket=")[1].split("/")[0] for f in before})
    assert len(set(after) - set(before)) <= 2  # what is written follows the change
    gone = spark.createDataFrame([("k1",), ("k1",), ("nothing",), (None,)], "chunk_id string")
    assert held.delete(gone) == 1
    assert held.delete_where(F.col("n") < 390) == sum(n < 390 for k, n in want.items() if k != "k1")
    assert {r["chunk_id"]: r["n"] for r in held.read().collect()} == {k: n for k, n in want.items() if n >= 390 and k != "k1"}
    assert held.delete_where(F.lit(True)) == 10 and held.read().count() == 0
    assert held.upsert(new) == 2 and held.read().count() == 2
    assert held.upsert(new.limit(0)) == 0 and held.delete(gone.limit(0)) == 0


def test_without_entries(spark):
    entities = [("a", ["s::c1", "s::c2"]), ("b", ["c1"]), ("c", ["s"]), ("d", []), ("e", ["t::s::c3"]), ("f", ["ss::c1x", "t"]), ("g", None), ("x::c1", ["q::x::c1"])]
    relations = [("a", "R", "f", ["s::c2"]), ("a", "R", "b", ["z"]), ("f", "R", "f", ["u"]), ("d", "R", "f", [])]
    gone = [("chunk", "c1"), ("source", "s"), ("chunk", None)]
    e = spark.createDataFrame(entities, "name string, provenance array<string>")
    r = spark.createDataFrame(relations, "head string, rel_type string, tail string, provenance array<string>")
    kept, edges = updates.without_entries(e, r, spark.createDataFrame(gone, "kind string, value string"))
    hit = lambda p: p == "c1" or p.endswith("::c1") or p == "s" or p.startswith("s::")
    left = {n: p if p is None or not any(map(hit, p)) else [x for x in p if not hit(x)] for n, p in entities}
    left = {n: p for n, p in left.items() if p or not any(map(hit, dict(entities)[n] or []))}
    assert {x["name"]: x["provenance"] for x in kept.collect()} == left
    assert sorted((x["head"], x["tail"]) for x in edges.collect()) == [("d", "f"), ("f", "f")]


def simulate(held, files, current):
    """One change after the other, chunk by chunk."""
    vectors, snapshot, prov = dict(held["vectors"]), {d: dict(c) for d, c in held["snapshot"].items()}, {n: list(p) for n, p in held["prov"].items()}
    counts = {}
    for doc, kind in files:
        new, old = current.get(doc, {}), snapshot.get(doc)
        n = dict.fromkeys(("added", "deleted", "unchanged"), 0)

        def forget(test):
            for name in list(prov):
                if any(map(test, prov[name])):
                    prov[name] = [p for p in prov[name] if not test(p)]
                    if not prov[name]:
                        del prov[name]

        stored = {}
        if kind == "deleted" or (kind == "modified" and not old):
            gone = [c for c, (d, _) in vectors.items() if d == doc]
            for c in gone:
                del vectors[c]
            n["deleted"] = len(gone)
            forget(lambda p: p == f"p/{doc}" or p.startswith(f"p/{doc}::"))
            snapshot.pop(doc, None)
            stored = new if kind == "modified" else {}
        elif kind == "created":
            stored = new
        else:
            stale = [c for c, t in old.items() if new.get(c) != t]
            for c in stale:
                vectors.pop(c, None)
            n["deleted"] = len(stale)
            forget(lambda p: any(p == c or p.endswith("::" + c) for c in stale))
            stored = {c: t for c, t in new.items() if old.get(c) != t}
            n["unchanged"] = len(new) - len(stored)
        for c, t in stored.items():
            vectors[c] = (doc, t)
            entry = f"p/{doc}::{c}"
            if entry not in prov.setdefault(t.split()[0], []):
                prov[t.split()[0]].append(entry)
        n["added"] = len(stored)
        if kind != "deleted":
            snapshot[doc] = new
        counts[doc] = tuple(n.values())
    return vectors, {d: c for d, c in snapshot.items() if c}, prov, counts


def test_update_documents(spark):
    docs = [f"d{i}" for i in range(24)]
    text = lambda: f"E{rng.randrange(9)} {rng.randrange(3)}"
    old = {d: {f"{d}#{k}": text() for k in range(rng.randint(1, 5))} for d in docs}
    current = {d: {c: t if rng.random() < 0.5 else text() for c, t in old[d].items() if rng.random() < 0.8} | {f"{d}#new": text()} for d in docs}
    kinds = {d: rng.choice(["created", "modified", "modified", "deleted"]) for d in docs[:20]}
    snapped = {d for d in docs if rng.random() < 0.7} - set([d for d in kinds if kinds[d] == "modified"][:2])
    prov = {}
    for d, chunks in old.items():
        for c, t in chunks.items():
            prov.setdefault(t.split()[0], []).append(f"p/{d}::{c}")
    held = {"vectors": {c: (d, t) for d, cs in old.items() for c, t in cs.items()}, "snapshot": {d: old[d] for d in snapped}, "prov": prov}
    vectors, snapshot, after, counts = simulate(held, sorted(kinds.items()), current)

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    entities = frame([(n, "T", "", 1, p, ["x"], 1, 1) for n, p in prov.items()], "name string, type string, description string, version int, provenance array<string>, aliases array<string>, created_at long, updated_at long")
    relations = frame([("E0", "USES", "E1", 0.5, ["p/d0::d0#0"]), ("E0", "USES", "E2", 0.5, ["other"])], "head string, rel_type string, tail string, confidence double, provenance array<string>")
    stores = updates.Stores(frame([(c, d, t) for c, (d, t) in held["vectors"].items()], "chunk_id string, doc_id string, content string"), entities, relations, frame([(d, c, t) for d in snapped for c, t in old[d].items()], "doc_id string, chunk_id string, content string"))
    now = frame([(d, c, t) for d, cs in current.items() for c, t in cs.items()], "doc_id string, chunk_id string, content string")
    changes = frame([(d, f"p/{d}", k) for d, k in kinds.items()], "doc_id string, file_path string, change_type string")
    first = F.split("content", " ")[0]
    extract = lambda c: (c.select("chunk_id", first.alias("name"), F.lit("T").alias("type"), F.lit("new").alias("description"), F.xxhash64("chunk_id").alias("pos")), c.select("chunk_id", first.alias("head"), F.lit("uses").alias("relation"), F.lit("nobody").alias("tail"), F.lit(0.1).alias("confidence"), F.lit(1).alias("pos")))
    got, told = updates.update_documents(stores, changes, now, lambda c: c.select("chunk_id", "doc_id", "content"), extract, F.lit(5).cast("long"))
    assert {r["chunk_id"]: (r["doc_id"], r["content"]) for r in got.vectors.collect()} == vectors
    assert {(r["doc_id"], r["chunk_id"]): r["content"] for r in got.snapshot.collect()} == {(d, c): t for d, cs in snapshot.items() for c, t in cs.items()}
    assert {r["name"]: sorted(r["provenance"]) for r in got.entities.collect()} == {n: sorted(p) for n, p in after.items()}
    assert {r["doc_id"]: (r["vectors_added"], r["vectors_deleted"], r["chunks_unchanged"]) for r in told.collect()} == counts
    assert set(kinds.values()) == {"created", "modified", "deleted"} and {kinds[d] for d in kinds if d not in snapped} >= {"modified"}
    assert {(r["head"], r["tail"]) for r in got.relations.collect()} <= {("E0", "E1"), ("E0", "E2")}
    same, none = updates.update_documents(stores, changes.limit(0), now, lambda c: c.select("chunk_id", "doc_id", "content"), extract, F.lit(5).cast("long"))
    assert none.count() == 0 and same.vectors.count() == stores.vectors.count() and same.entities.count() == len(prov)


def test_registry_changes(spark):
    held = spark.createDataFrame([(1, "new", 0, 1), (2, "new", 0, 1)], "file_id int, status string, chunks_count int, updated_at int")
    changes = spark.createDataFrame([(1, 1, "processing", None), (1, 2, None, 7), (1, 3, "success", None), (9, 1, "x", 1)], "file_id int, pos int, status string, chunks_count int")
    got = incremental.registry_update(held, changes, F.lit(5))
    assert sorted(map(tuple, got.collect())) == [(1, "success", 7, 5), (2, "new", 0, 1)]
    registry = spark.createDataFrame([("a", "failed"), ("a", "success"), ("b", "rejected"), ("b", "failed"), ("c", "processing")], "sha string, status string")
    uploads = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "a")], "file_id int, sha string")
    assert {r["file_id"]: r["outcome"] for r in incremental.upload_outcomes(registry, uploads).collect()} == {1: "already_exists", 2: "retried", 3: "already_exists", 4: "processing", 5: "already_exists"}
