"""Guards in front of statements and paths that come from outside."""

from __future__ import annotations

import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import strip

#: Words that a read-only graph statement may not hold, not even in a string, and words that one starts with. Fixed values.
WRITING = ("CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "ALTER", "CALL", r"LOAD\s+CSV", "FOREACH", "GRANT", "DENY", "REVOKE", "TERMINATE", "START", "STOP")
READING = ("MATCH", r"OPTIONAL\s+MATCH", "WITH", "UNWIND", "RETURN")


def read_only_state(statement: Column) -> Column:
    """Whether a graph statement may run: ``accepted``, or why not: ``not_single`` (empty ones too), ``writes`` or
    ``not_a_query``. A null statement is empty."""
    text = strip(F.coalesce(statement, F.lit("")))
    body = F.regexp_replace(text, ";+$", "")
    state = F.when((text == "") | body.contains(";"), "not_single").when(text.rlike(rf"(?iU)\b({'|'.join(WRITING)})\b"), "writes")
    return state.when(~text.rlike(rf"(?iU)^({'|'.join(READING)})\b"), "not_a_query").otherwise("accepted")


def read_only_text(statement: Column) -> Column:
    """An accepted statement without white space and semicolons at its ends; null for others."""
    return F.when(read_only_state(statement) == "accepted", strip(F.regexp_replace(strip(statement), ";+$", "")))


def read_only_sql(spark: SparkSession, statement: str):
    """The result of a statement that only reads; ValueError for any that has a command or an insert in its parsed plan."""
    of = lambda name: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
    kinds = [of("Command"), of("ParsedStatement")]
    open_ = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    while open_:
        node = open_.pop()
        if any(k.isInstance(node) for k in kinds):
            raise ValueError(f"not a read-only statement: {node.nodeName()}")
        open_ += [part.apply(i) for part in (node.children(), node.innerChildren()) for i in range(part.size()) if of("LogicalPlan").isInstance(part.apply(i))]
    return spark.sql(statement)


def managed_path(path: str, root: str) -> str:
    """The real path of ``path`` (relative ones from ``root``), which must lie in ``root``; else ValueError."""
    root = os.path.realpath(root)
    found = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([root, found]) != root:
        raise ValueError("the path must lie inside the managed folder")
    return found
