"""Change detection, snapshot differences and the document registry."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LINE_END


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, state): stale, added, changed or unchanged, of (chunk_id, content)."""
    both = old.select("chunk_id", F.col("content").alias("was"), F.lit(True).alias("o")).join(new.select("chunk_id", F.col("content").alias("now"), F.lit(True).alias("n")), "chunk_id", "full_outer")
    state = F.when(F.col("n").isNull(), "stale").when(F.col("o").isNull(), "added").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return both.select("chunk_id", state.alias("state"))


def change_counts(states: DataFrame) -> DataFrame:
    """A changed chunk is deleted and added again."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return states.agg(n("added", "changed").alias("added"), n("stale", "changed").alias("deleted"), n("added", "changed").alias("reprocessed"), n("unchanged").alias("unchanged"))


def detect_changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change_type) of (path, hash) tables; an unreadable file has an empty hash and is created again."""
    both = known.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    kind = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull() | (F.col("old") == ""), "created").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", kind.alias("change_type")).where("change_type IS NOT NULL")


def register(registry: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads (file_id, sha, pos) with the file that holds their content and whether they made it; only hashes move."""
    held = registry.select("sha", F.col("file_id").alias("registered"))
    first = uploads.groupBy("sha").agg(F.min_by("file_id", "pos").alias("first"))
    owner = first.join(held, "sha", "left").select("sha", F.coalesce("registered", "first").alias("owner"), F.col("registered").isNull().alias("new"))
    return uploads.join(owner, "sha").select("file_id", "sha", "owner", (F.col("new") & (F.col("file_id") == F.col("owner"))).alias("created"))


def upsert(held: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "pos") -> DataFrame:
    """``held`` with the rows of ``new`` in place of those of equal keys; of new rows of a key the last by ``order`` stays.
    Columns are those of ``held``. Null keys replace nothing and are left out of ``new``."""
    payload = F.struct(*[c for c in held.columns if c != key])
    last = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(payload, order).alias("#row")).select(key, "#row.*")
    return held.join(last.select(key), key, "left_anti").unionByName(last.select(held.columns))


def delete_documents(held: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``held`` without the rows whose ``key`` is in ``gone``."""
    return held.join(gone.select(key).distinct(), key, "left_anti")


def delete_counts(held: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """(asked, deleted): the distinct keys named, and the rows that ``delete_documents`` takes away."""
    keys = gone.select(key).where(F.col(key).isNotNull()).distinct()
    asked, deleted = keys.agg(F.count("*").alias("asked")), held.join(keys, key, "left_semi").agg(F.count("*").alias("deleted"))
    return asked.join(deleted)  # a row each


def approved(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """The rows that may be stored: all but those with a review (``key``, approved) that rejects them. An unreviewed row or
    a null answer passes."""
    return rows.join(reviews.where(~F.col("approved")).select(key).distinct(), key, "left_anti")


DIFF = T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("blocks", T.IntegerType()), T.StructField("change_ratio", T.DoubleType()), T.StructField("major", T.BooleanType()), T.StructField("summary", T.ArrayType(T.StringType()))])


@F.pandas_udf(DIFF)
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Lines added and removed, blocks of change, their share of the lines of both texts together (rounded), major if the
    share before rounding is over 0.3, and a summary of the first five added and the first five removed lines."""
    rows = []
    for a, b in zip(old, new):
        a, b = (re.split(LINE_END, t or "") for t in (a, b))
        a, b = a[: -1 if a[-1] == "" else None], b[: -1 if b[-1] == "" else None]
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        gone, came = [x for o in ops for x in a[o[1] : o[2]]], [x for o in ops for x in b[o[3] : o[4]]]
        ratio = (len(came) + len(gone)) / max(1, len(a) + len(b))
        rows.append((len(came), len(gone), len(ops), round(ratio, 4), ratio > 0.3, [f"+ {x}" for x in came[:5]] + [f"- {x}" for x in gone[:5]]))
    return pd.DataFrame(rows, columns=[f.name for f in DIFF])


def registry_update(held: DataFrame, changes: DataFrame, now) -> DataFrame:
    """``held`` (file_id, ..., updated_at) with the fields of ``changes`` (file_id and some of UPDATABLE; null: as it was);
    other columns of ``changes`` are ignored. Of several changes of an id each field takes its last value by ``pos`` (by the
    value where there is no such column). ``now`` is a column for updated_at."""
    fields = [c for c in UPDATABLE if c in changes.columns and c in held.columns]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("pos", c) if "pos" in changes.columns else F.col(c)))
    new = changes.groupBy("file_id").agg(*[last(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("hit"))
    both = held.join(new, "file_id", "left")
    some = F.col("hit") & F.coalesce(*[F.col(f"new_{c}").isNotNull() for c in fields], F.lit(False)) if len(fields) == 1 else F.col("hit") & sum((F.col(f"new_{c}").isNotNull().cast("int") for c in fields), F.lit(0)).cast("boolean")
    values = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in fields} | ({"updated_at": F.when(some, now).otherwise(F.col("updated_at"))} if fields else {})
    return both.select([values.get(c, F.col(c)).alias(c) for c in held.columns])


#: Registry fields that may be updated. Fixed values.
UPDATABLE = ("status", "chunks_count", "entities_count", "relations_count", "thread_id", "error_message")


def upload_outcomes(registry: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads (file_id, sha) against registered (sha, status): already_exists, retried after failure or rejection, or
    processing; one outcome an upload. A content that is registered more than once exists if any of them neither failed nor
    was rejected."""
    lost = F.col("status").isin("failed", "rejected")
    held = registry.groupBy("sha").agg(F.min_by("status", F.struct(lost.cast("int"), "status")).alias("status"))
    state = F.when(F.col("status").isNull(), "processing").when(F.col("status").isin("failed", "rejected"), "retried").otherwise("already_exists")
    return uploads.join(held, "sha", "left").select("file_id", "sha", state.alias("outcome"))


def delete_chunks(held: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``held`` without the chunks of ``ids`` (chunk_id), and the count that a delete states: the ids asked for."""
    return held.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti"), ids.agg(F.count("*").alias("deleted"))


def document_handlers(states: DataFrame, snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, action) for the last change of each document: ``states`` (doc_id, change_type), ``snapshot`` and
    ``current`` (doc_id, chunk_id, content). A created document's chunks are stored; a modified one's changed and new chunks
    are stored and its changed and stale ones removed, others kept (without a snapshot all are stored); a deleted one's
    chunks are removed."""
    was = snapshot.select("doc_id", "chunk_id", F.col("content").alias("was"), F.lit(True).alias("o"))
    now = current.select("doc_id", "chunk_id", F.col("content").alias("now"), F.lit(True).alias("n"))
    both = states.join(was.join(now, ["doc_id", "chunk_id"], "full_outer"), "doc_id")
    deleted, created = F.col("change_type") == "deleted", F.col("change_type") == "created"
    action = F.when(deleted, F.when(F.col("o"), "remove")).when(created, F.when(F.col("n"), "store"))
    action = action.when(F.col("n").isNull(), "remove").when(F.col("o").isNull(), "store").when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("replace")
    return both.select("doc_id", "chunk_id", action.alias("action")).where("action IS NOT NULL")
