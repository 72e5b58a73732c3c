"""Connected components by alternating large-star and small-star steps; every step is written to the shared folder.

A round is three short queries instead of one that repeats its inputs, as the driver holds each query's plan anew for every
stage. Rounds end as soon as every node has one smaller neighbour at most, and no larger ones if it has one: no further
round is needed to see that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of (x, y) and the smallest node that it reaches; written. No group is gathered in one place."""
    state = written(edges.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "components")
    while True:
        ends = state.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other")))).alias("e")).select("e.*")
        smaller = F.count_if(F.col("other") < F.col("node"))
        low = ends.groupBy("node").agg(F.min("other").alias("m"), ((smaller > 1) | ((smaller > 0) & (smaller < F.count("*")))).alias("open"))
        roots = written(low.select("node", F.least("node", "m").alias("root"), "open"), "components-roots")
        if not roots.agg(F.max("open")).first()[0]:
            discard(state)
            return roots.select("node", "root")
        large = state.join(roots.select(F.col("node").alias("y"), "root"), "y").select("x", F.col("root").alias("y"))
        large, spent = written(large.distinct(), "components-large"), state
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        state = written(small.distinct(), "components")
        discard(spent, roots, large)
