"""Streams of changes: held states, one result a change, retries, and a watched folder over restarts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graphquarry.streaming import cdc, watcher


def put(folder, name, *changes):
    (folder / name).write_text("".join(json.dumps(dict(zip(("file_path", "change_type", "seq", "new_hash"), c))) + "\n" for c in changes))


def results(spark, target):
    got = cdc.change_results(spark, str(target)).orderBy("batch", "file_path", "events").collect()
    return [(r["batch"], r["file_path"], r["seq"], r["change_type"], r["old_hash"], r["events"], r["outcome"], r["attempts"]) for r in got]


def test_changes_stream(spark, tmp_path):
    """A result for each change, in order over several batches; state of one row a path; odd changes are set apart."""
    (tmp_path / "in").mkdir()
    calls = tmp_path / "calls"
    calls.mkdir()

    def handler(changes):
        """q fails always, r at first; s gets no result."""
        number = len(list(calls.iterdir()))
        (calls / str(number)).write_text("")
        return changes.where("file_path <> 's'").select("file_path", (~((F.col("file_path") == "q") | ((F.col("file_path") == "r") & F.lit(number % 2 == 0)))).alias("success"), F.when(F.col("file_path") == "q", "broken").alias("error"))

    run = lambda: cdc.apply_changes(cdc.change_stream(spark, str(tmp_path / "in"), default_type="modified"), str(tmp_path / "out"), str(tmp_path / "state"), handler)
    put(tmp_path / "in", "a.json", ("p", "created", 1, "x"), ("p", "deleted", 3, None), ("p", "modified", 2, "y"), (None, "modified", 4, None), ("q", "odd", 5, None), ("q", None, 6, "z"), ("s", "created", None, "s"))
    run()
    put(tmp_path / "in", "b.json", ("p", "modified", 2, "late"), ("p", "created", 9, "w"), ("r", "created", 10, None), ("s", "modified", None, "t"))
    run()
    assert results(spark, tmp_path / "out") == [
        (0, "p", 1, "created", None, 1, "superseded", 0), (0, "p", 2, "modified", "x", 2, "superseded", 0), (0, "p", 3, "deleted", "y", 3, "done", 1),
        (0, "q", 6, "modified", None, 1, "failed", 2), (0, "s", 1, "created", None, 1, "failed", 2),
        (1, "p", 2, "modified", None, 4, "late", 0), (1, "p", 9, "created", None, 5, "done", 1), (1, "r", 10, "created", None, 1, "done", 2), (1, "s", 2, "modified", "s", 2, "failed", 2),
    ]
    held = cdc.last_states(spark, str(tmp_path / "state")).orderBy("file_path").collect()
    assert [tuple(r) for r in held] == [("p", "created", "w", 9, 5), ("q", "modified", "z", 6, 1), ("r", "created", None, 10, 1), ("s", "modified", "t", 2, 2)]
    assert cdc.rejected_changes(spark, str(tmp_path / "out")).count() == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_retries_lose_nothing(spark):
    """A handler that fails by chance: its plan gives other results each time it is run."""
    changes = spark.createDataFrame([(f"p{i}", i) for i in range(200)], "file_path string, seq long").repartition(4)
    handler = lambda df: df.select("file_path", (F.rand() < 0.5).alias("success"))
    got = cdc.retried(handler, changes)
    first, second = got.collect(), got.collect()
    assert sorted(r["file_path"] for r in first) == sorted(f"p{i}" for i in range(200)) and sorted(first) == sorted(second)
    assert all(r["attempts"] == 2 for r in first if not r["success"]) and 0 < sum(not r["success"] for r in first) < 100
    assert cdc.retried(handler, changes.limit(0)).count() == 0


class Stopped(Exception):
    pass


def test_watched_folder_over_restarts(spark, tmp_path):
    """Creates, modifies and deletes; a batch that broke off is given again, and nothing twice."""
    folder, seen = tmp_path / "docs", []
    (folder / "deep").mkdir(parents=True)
    rng, held = random.Random(5), {}

    def poll(breaks=False):
        def batch(df, number):
            rows = [(r["file_path"].rsplit("/", 1)[1], r["change_type"]) for r in df.collect()]
            if breaks and rows:
                raise Stopped
            seen.append((number, sorted(rows)))

        query = watcher.watched(spark, str(folder), str(tmp_path / "state")).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    want = []
    for turn in range(5):
        now = []
        for k in rng.sample(range(12), 6):
            name = folder / ("deep" if k % 2 else ".") / f"f{k}.md"
            if k in held and rng.random() < 0.4:
                os.remove(name)
                del held[k]
                now.append((name.name, "deleted"))
            else:
                name.write_text("x" * (turn + 1))
                now.append((name.name, "modified" if k in held else "created"))
                held[k] = turn
        (folder / ".hidden").write_text(str(turn))
        if turn == 2:
            with pytest.raises(Exception, match="Stopped"):
                poll(breaks=True)
        poll()
        want.append(sorted(now))
    got = [rows for _, rows in seen if rows]
    assert got == want and len({n for n, rows in seen if rows}) == len(want)
    assert len(list((tmp_path / "state").glob("listing-*"))) <= 2 * len(seen)


def test_watched_states(spark, tmp_path):
    """A watched folder through the change stream."""
    (tmp_path / "docs").mkdir()
    run = lambda: cdc.apply_changes(watcher.watched(spark, str(tmp_path / "docs"), str(tmp_path / "list")), str(tmp_path / "out"), str(tmp_path / "state"))
    (tmp_path / "docs/a.md").write_text("one")
    (tmp_path / "docs/b.md").write_text("two")
    run()
    (tmp_path / "docs/a.md").unlink()
    run()
    run()
    (tmp_path / "docs/c.md").write_text("three")
    run()
    got = {r["file_path"].rsplit("/", 1)[1]: (r["change_type"], r["events"]) for r in cdc.last_states(spark, str(tmp_path / "state")).collect()}
    assert got == {"a.md": ("deleted", 2), "b.md": ("created", 1), "c.md": ("created", 1)}


def test_changes_reach_the_stores(spark, tmp_path):
    """Files are created, modified and deleted; vectors, graph and snapshots follow, and a broken file changes nothing."""
    from graphquarry.operators.updates import Stores
    from graphquarry.sources import office
    from graphquarry.streaming.stores import HeldStores, store_handler

    docs = tmp_path / "docs"
    docs.mkdir()
    frame = lambda schema: spark.createDataFrame([], schema)
    held = HeldStores(spark, f"file://{tmp_path}/held")
    with pytest.raises(ValueError, match="published"):
        held.load()
    held.publish(Stores(frame("chunk_id string, doc_id string, content string"), frame("name string, type string, description string, version int, provenance array<string>, aliases array<string>, created_at long, updated_at long"), frame("head string, rel_type string, tail string, confidence double, provenance array<string>"), frame("doc_id string, chunk_id string, content string")))

    def parse(files):
        found = office.parse_files(spark, f"file://{docs}").withColumn("file_path", F.regexp_replace("path", "^file:/*", "/"))
        own = found.join(files, "file_path", "left_semi")
        chunks = office.block_chunks(own).select(F.regexp_replace("source", "^file:/*", "/").alias("file_path"), F.concat_ws("#", F.substring_index("source", "/", -1), "chunk_index").alias("chunk_id"), "content")
        bad = own.where("parse_error IS NOT NULL").select("file_path", "parse_error")
        return chunks.join(bad, "file_path", "full_outer").select("file_path", "chunk_id", "content", F.col("parse_error").alias("error"))

    first = F.regexp_extract("content", r"(\w+)", 1)
    extract = lambda c: (c.select("chunk_id", first.alias("name"), F.lit("T").alias("type"), F.lit("").alias("description"), F.xxhash64("chunk_id").alias("pos")), c.select("chunk_id", first.alias("head"), F.lit("uses").alias("relation"), F.lit("one").alias("tail"), F.lit(1.0).alias("confidence"), F.lit(1).alias("pos")))
    handler = store_handler(held, parse, lambda c: c.select("chunk_id", "doc_id", "content"), extract, F.lit(1).cast("long"))

    def run():
        cdc.apply_changes(watcher.watched(spark, str(docs), str(tmp_path / "list")), str(tmp_path / "out"), str(tmp_path / "state"), handler)
        stores = held.load()
        return {r["chunk_id"]: r["content"] for r in stores.vectors.collect()}, {r["name"]: len(r["provenance"]) for r in stores.entities.collect()}, stores.snapshot.count()

    (docs / "a.txt").write_text("one text")
    (docs / "b.md").write_text("# two\nof them")
    (docs / "bad.txt").write_bytes(b"\xff\xfe")
    assert run() == ({"a.txt#0": "one text", "b.md#0": "two", "b.md#1": "of them"}, {"one": 1, "two": 1, "of": 1}, 3)
    (docs / "a.txt").unlink()
    (docs / "b.md").write_text("# two\nnow of more")
    assert run() == ({"b.md#0": "two", "b.md#1": "now of more"}, {"two": 1, "now": 1}, 2)
    outcomes = {(r["file_path"].rsplit("/", 1)[1], r["change_type"]): (r["outcome"], r["attempts"]) for r in cdc.change_results(spark, str(tmp_path / "out")).collect()}
    assert outcomes == {("a.txt", "created"): ("done", 1), ("b.md", "created"): ("done", 1), ("bad.txt", "created"): ("failed", 2), ("a.txt", "deleted"): ("done", 1), ("b.md", "modified"): ("done", 1)}
