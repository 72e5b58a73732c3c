"""Exact vector search over stored cells: nearest vectors of many queries, and all similar pairs.

An index is a folder of Parquet, partitioned by cell. Vectors are made unit, given to the nearest of the cells' centres, and
packed by falling nearness into blocks that hold their smallest and largest angle to the centre. Angles obey the triangle
inequality, so a query with a known floor passes over a cell (and a block within) whose angles differ too much from its own
angle to the centre; what is left is multiplied block by block. Results don't depend on cells. Where vectors lie alike in all
directions, angles to a centre tell little and most cells are visited; the work is then a matrix product, without a row for
each pair.

Blocks meet by an equi-join. Cells of many vectors are dealt over parts, so that none is one task's; for the last search cells
and parts are gathered into regions of like size, about one a task, and a query is sent once to each region that has an open cell,
so that what is sent grows with the queries and tasks, not with the cells. Centres
are means over a bounded sample (``SAMPLE``), at most ``CELLS`` of them, and the only thing besides a row for each cell that
reaches the driver. Scores are cosines rounded to six places, ties go to the smaller id. Null vectors take no part; vectors of
length 0 have cosine 0 with all. Vectors of another length raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import settled, shared_folder, spent

#: Cells and sampled vectors at most; rows of a block, of a part of a cell, and of a block of queries.
CELLS, SAMPLE, BLOCK, PART, ASKED = 1024, 16_384, 2048, 65_536, 512
#: Vectors of a region at least, if there are as many.
REGION = 8192
#: Bytes of vectors that are copied for several cells at once.
SENT = 16_000_000
#: Bytes of an Arrow batch at most: rows hold whole blocks.
BATCH = 8_000_000
#: Added to angles and taken from floors, for rounding.
SLACK = 2e-6
#: The cell of vectors without a direction; it is always visited.
NOWHERE = -1


@dataclass
class Index:
    folder: str
    key: T.DataType
    centres: np.ndarray
    #: Of each cell: id, parts, smallest and largest angle, vectors.
    cells: list[tuple[int, int, float, float, int]]

    def blocks(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("ids", T.ArrayType(self.key)), T.StructField("data", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        return spark.read.schema(schema).parquet(f"{self.folder}/blocks")


def unit(rows: pa.Array) -> np.ndarray:
    x = np.array(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def centres_of(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Directions of ``cells`` means of a sample; a mean of nothing keeps its place."""
    held = sample[:cells].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ held.T, 1)
        for c in np.unique(own):
            mean = sample[own == c].sum(0)
            size = np.linalg.norm(mean)
            if size > 0:
                held[c] = mean / size
    return held


def packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, angle, id, data, ...) that come sorted by cell and part, as rows of lists of at most ``rows``."""
    for batch in batches:
        cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
        edges = [0, *cuts.tolist(), len(cell)]
        for a, b in zip(edges, edges[1:]):
            for at in range(a, b, rows):
                own = batch.slice(at, min(rows, b - at))
                angle = own.column(2).to_numpy()
                whole = pa.array([b"".join(own.column(4).to_pylist())], pa.binary())
                lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(k)) for k in (3, *range(5, own.num_columns))]
                yield pa.RecordBatch.from_arrays([lists[0], whole, pa.array([int(part[at])], pa.int32()), pa.array([angle.min()]), pa.array([angle.max()]), *lists[1:], pa.array([int(cell[at])], pa.int32())], ["ids", "data", "part", "low", "high", *[f"more{k}" for k in range(len(lists) - 1)], "cell"])


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, if they are larger, so that a worker's memory doesn't grow with its rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not held.isdigit() or not 0 < int(held) <= BATCH:
        spark.conf.set(name, str(BATCH))


def unit_blocks(rows: DataFrame, key: str, vector: str, prefix: str, size: int) -> DataFrame:
    """Unit vectors of ``rows`` in blocks: (``prefix``ids, ``prefix``data); null vectors and those of length 0 aren't in any."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, size) for at in range(0, batch.num_rows, size)):
                x = unit(part.column(1))
                some = np.flatnonzero(np.any(x != 0, 1))
                if len(some):
                    ids = part.column(0).take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids), pa.array([x[some].tobytes()], pa.binary())], [f"{prefix}ids", f"{prefix}data"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"{prefix}ids array<{kind}>, {prefix}data binary")


def likest_before(rows: DataFrame, heads: DataFrame, least: float, key: str = "pos", vector: str = "vector") -> DataFrame:
    """(y, x, score): for each of ``rows`` the likest of ``heads`` with a smaller key, the smallest key of equals, if their cosine,
    rounded to six places, is ``least`` or more; exact. Blocks of rows meet blocks of heads, and a pair of blocks gives a
    row of ``rows`` at most one row."""
    kind = rows.schema[key].dataType.simpleString()
    bounded_batches(rows.sparkSession)
    # both sides are written first, so that a task has one worker at a time
    met = settled(unit_blocks(rows, key, vector, "", ASKED), "blocks").crossJoin(settled(unit_blocks(heads, key, vector, "h_", BLOCK), "blocks"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, h_ids = (batch.column(c)[row].values for c in (0, 2))
                a, b = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(len(i), -1) for c, i in ((1, ids), (3, h_ids)))
                own, other = np.array(ids.to_pylist()), np.array(h_ids.to_pylist())
                order = np.argsort(other, kind="stable")
                scores = np.round(a @ b[order].T, 6) + 0.0
                scores[(scores < least) | (other[order][None, :] >= own[:, None])] = -2.0
                at = np.argmax(scores, 1)
                found = np.flatnonzero(scores[np.arange(len(own)), at] > -2.0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found)), h_ids.take(pa.array(order[at[found]])), pa.array(scores[found, at[found]])], ["y", "x", "score"])

    best = met.mapInArrow(run, f"y {kind}, x {kind}, score double").groupBy("y").agg(F.min(F.struct((-F.col("score")).alias("s"), "x")).alias("b"))
    return best.select("y", F.col("b.x").alias("x"), (-F.col("b.s")).alias("score"))


def build(vectors: DataFrame, folder: str | None = None, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Index:
    """An index of ``vectors`` in ``folder`` (a fresh shared one if none is named)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    folder = folder or shared_folder(spark, "vectors")
    kind = vectors.schema[key].dataType
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    n, short, long = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if short != long:
        raise ValueError(f"vectors have {short} to {long} components")
    cells = max(1, min(cells or math.isqrt(n) // 2, CELLS))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 16 * cells)).select("v").toArrow().column(0).combine_chunks() if n else None
    sample = unit(some)[: len(some)] if n else np.zeros((0, 1))
    sample = sample[np.any(sample != 0, 1)]
    centres = centres_of(sample, min(cells, len(sample))) if len(sample) else np.zeros((0, long or 1))

    def placed(batches):
        for batch in batches:
            x = unit(batch.column(1))
            near = x @ centres.T if len(centres) else np.zeros((len(x), 1))
            cell = np.where(np.any(x != 0, 1), np.argmax(near, 1), NOWHERE).astype(np.int32)
            angle = angles(near[np.arange(len(x)), np.maximum(cell, 0)])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["cell", "angle", "id", "data"])

    spread = settled(rows.mapInArrow(placed, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("id", kind), T.StructField("data", T.BinaryType())])), "placed")
    held = spread.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.min("angle"), F.max("angle"), F.count("*")).orderBy("cell")
    known = [tuple(r) for r in held.collect()]
    parts = F.coalesce(F.create_map(*[F.lit(x) for c in known for x in c[:2]])[F.col("cell")], F.lit(1)) if known else F.lit(1)
    dealt = spread.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).select("cell", "part", "angle", "id", "data")
    ordered = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "angle", "id")
    index = Index(folder, kind, centres, known)
    schema = "ids array<%s>, data binary, part int, low double, high double, cell int" % kind.simpleString()
    ordered.mapInArrow(lambda batches: packed(batches, BLOCK), schema).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/blocks")
    spent(spread)
    return index


def regions_of(index: Index, tasks: int) -> list[tuple[int, int, int]]:
    """(cell, part, region) of all parts of cells: neighbours in the list share a region until it has its size."""
    least = max(-(-sum(c[4] for c in index.cells) // tasks), min(REGION, PART))
    out, region, held = [], 0, 0.0
    for cell, parts, _, _, n in index.cells:
        for part in range(parts):
            if held >= least:
                region, held = region + 1, 0.0
            out.append((cell, part, region))
            held += n / parts
    return out


def visiting(index: Index, floors: bool, skip: int, regions: list[tuple[int, int, int]] | None = None):
    """Rows (cell, part, angle, id, data, floor, place) of queries (id, v, floor): each cell that may hold a score of its floor.

    Without floors, the nearest cells that together hold ``skip`` vectors; with them, the others. With ``regions``, each region
    (as cell, part 0) that has such a cell, those of the nearest included, and the nearest cell's number as angle."""
    centres, cells = index.centres, index.cells
    real = [c for c in cells if c[0] != NOWHERE]
    names = np.array([c[0] for c in real], np.int32)
    low, high, sizes = (np.array([c[k] for c in real], np.float64) for k in (2, 3, 4))
    parts = {c[0]: c[1] for c in cells}
    lost = [c[0] for c in cells if c[0] == NOWHERE]

    goals = 1 + max((r for _, _, r in regions), default=0) if regions else sum(parts.values())
    few = max(1, SENT // max(1, 8 * centres.shape[1] * goals))  # queries at once, as each can go to every cell
    where = {int(c): k for k, c in enumerate(names)}
    within = np.zeros((len(names), goals), bool)
    for c, _, r in regions or ():
        if c in where:
            within[where[c], r] = True
    always = sorted({r for c, _, r in regions or () if c == NOWHERE})

    def run(batches):
        for batch in (b.slice(at, few) for b in batches for at in range(0, b.num_rows, few)):
            x = unit(batch.column(1))
            if len(x) and centres.size and x.shape[1] != centres.shape[1]:
                raise ValueError(f"queries have {x.shape[1]} components, the index {centres.shape[1]}")
            floor = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            angle = angles(x @ centres[names].T) if len(names) else np.zeros((len(x), 0))
            order = np.argsort(angle, 1, kind="stable")
            filled = np.cumsum(sizes[order], 1) - sizes[order] < skip
            first = np.zeros(angle.shape, bool)
            np.put_along_axis(first, order, filled, 1)
            first[~np.any(x != 0, 1)] = False
            if not floors:
                meets = first
            else:
                reach = angles(floor - SLACK)[:, None] + SLACK
                meets = (angle - reach <= high) & (angle + reach >= low)
                meets &= ~first | bool(regions)
            raw = np.array([r.tobytes() for r in x] + [b""], object)[:-1]
            if regions:
                sent = (meets.astype(np.float32) @ within.astype(np.float32)) > 0
                sent[:, always] = True
                q, r = np.nonzero(sent)
                near = (order[:, 0] if len(names) else np.zeros(len(x))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(np.zeros(len(q), np.int32)), pa.array(near[q]), batch.column(0).take(pa.array(q)), pa.array(raw[q].tolist(), pa.binary()), pa.array(floor[q])], ["cell", "part", "angle", "id", "data", "floor"])
                continue
            q, c = np.nonzero(meets)
            extra = np.arange(len(x)) if floors and lost else np.zeros(0, int)
            q, cell, at = np.concatenate([q, extra]), np.concatenate([names[c], np.full(len(extra), NOWHERE, np.int32)]), np.concatenate([angle[q, c], np.zeros(len(extra))])
            times = np.array([parts[k] for k in cell.tolist()], int)
            part = np.concatenate([np.arange(t) for t in times.tolist()] or [np.zeros(0, int)]).astype(np.int32)
            q, cell, at = (np.repeat(v, times) for v in (q, cell, at))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part), pa.array(at), batch.column(0).take(pa.array(q)), pa.array(raw[q].tolist(), pa.binary()), pa.array(floor[q])], ["cell", "part", "angle", "id", "data", "floor"])

    return run


def at_least(raw: np.ndarray, floor: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's ``k`` best scores of its floor or more, rounded; ties go to the smaller id. Only what may
    reach its floor is rounded and sorted; with known floors that is little."""
    a, b = np.nonzero(raw >= floor[:, None] - SLACK)
    s = np.round(raw[a, b], 6) + 0.0
    some = s >= floor[a]
    a, b, s = a[some], b[some], s[some]
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((place[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    starts = np.searchsorted(a, a, "left")
    kept = np.arange(len(a)) - starts < k
    return a[kept], b[kept], s[kept]


def visited(index: Index, asked: DataFrame, k: int, floors: bool) -> DataFrame:
    """(query_id, vec_id, score): what the visited blocks hold of the queries' (id, v, floor) k best, at most k a block. Without
    floors these are blocks of the nearest cells, with them all that may hold a score of its floor."""
    spark, kind, centres = asked.sparkSession, asked.schema["id"].dataType, index.centres
    name, own = kind.simpleString(), index.key.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that tasks of few bytes and much work aren't coalesced
    regions = regions_of(index, tasks) if floors else None
    rows = asked.mapInArrow(visiting(index, floors, k, regions), f"cell int, part int, angle double, id {name}, data binary, floor double")
    blocks = index.blocks(spark)
    if regions:
        # regions take names that are dealt evenly over tasks
        dealt: dict[int, list[int]] = {}
        for label, task in spark.range(64 * tasks).select(F.col("id").cast("int").alias("label"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("task")).collect():
            dealt.setdefault(task, []).append(label)
        spread = sorted(dealt.values(), key=len, reverse=True)
        free = [labels[k] for k in range(len(spread[0])) for labels in spread if k < len(labels)]
        names = {r: free[r] if r < len(free) else 64 * tasks + r for r in {r for _, _, r in regions}}
        label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        rows = rows.withColumn("cell", label[F.col("cell")])
        placed = spark.createDataFrame([(c, p, names[r]) for c, p, r in regions], "cell int, part int, goal int")
        blocks = blocks.join(F.broadcast(placed), ["cell", "part"]).withColumn("at_part", F.lit(0))
    else:
        blocks = blocks.withColumns({"goal": F.col("cell"), "at_part": F.col("part")})
    rows = rows.select("cell", "part", "angle", "id", "data", "floor", F.col("angle").alias("at")).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "angle")
    queries = rows.mapInArrow(lambda b: packed(b, ASKED), f"q_ids array<{name}>, q_data binary, part int, q_low double, q_high double, floors array<double>, ats array<double>, cell int")
    queries = queries.select("q_ids", "q_data", "floors", "ats", F.col("cell").alias("goal"), F.col("part").alias("at_part"))
    met = queries.hint("merge").join(blocks.repartition(tasks, "goal", "at_part"), ["goal", "at_part"]).select("q_ids", "q_data", "floors", "ats", "ids", "data", "low", "high", "cell")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, floor, at, ids = (batch.column(c)[row].values for c in (0, 2, 3, 4))
                floor, at = floor.to_numpy(zero_copy_only=False), at.to_numpy(zero_copy_only=False)
                low, high, cell = (batch.column(c)[row].as_py() for c in (6, 7, 8))
                q = np.frombuffer(batch.column(1)[row].as_buffer(), np.float64).reshape(len(q_ids), -1)
                if floors and cell != NOWHERE:
                    at = angles(q @ centres[cell])
                reach = angles(floor - SLACK) + SLACK
                near = np.flatnonzero((at - reach <= high) & (at + reach >= low) | (cell == NOWHERE))
                if not len(near):
                    continue
                x = np.frombuffer(batch.column(5)[row].as_buffer(), np.float64).reshape(len(ids), -1)
                a, b, s = at_least(q[near] @ x.T, floor[near], np.array(ids.to_pylist()), k)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(near[a])), ids.take(pa.array(b)), pa.array(s)], ["query_id", "vec_id", "score"])

    return met.mapInArrow(run, f"query_id {name}, vec_id {own}, score double")


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries`` (query_id, query; ids distinct): the k of highest cosine, exactly.

    The nearest cells give each query a floor first, its k-th best score in them; then all cells that can hold as good ones
    are visited. The result is written once."""
    asked = queries.select(F.col("query_id").alias("id"), F.col("query").alias("v"), F.lit(-2.0).alias("floor")).where("v IS NOT NULL")
    first = settled(best(visited(index, asked, k, False), k), "first-cells")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asked.drop("floor").join(floors, "id", "left").select("id", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    out = settled(best(visited(index, known, k, True), k).select("query_id", "rank", "vec_id", "score"), "nearest")
    spent(first)
    return out


def similar(index: Index, spark: SparkSession, least: float) -> DataFrame:
    """(x, y, score), x before y, of all vectors whose cosine, rounded to six places, is ``least`` or more.

    Blocks go to the cells that their angles leave open. Vectors of length 0 are like nothing."""
    kind, reach, centres = index.key.simpleString(), float(angles(np.array(least - SLACK))) + SLACK, index.centres
    cells = [c for c in index.cells if c[0] != NOWHERE]
    parts = {c[0]: c[1] for c in cells}

    def goals(cell: int, high: float, angle: np.ndarray) -> list[tuple[int, int]]:
        open_ = [c[0] for c in cells if c[0] >= cell and angle[c[0]] - high - c[3] <= reach]
        return [(c, p) for c in open_ for p in range(parts[c])]

    def out(batches):
        between = angles(centres @ centres.T) if len(centres) else None
        for batch in batches:
            for row in batch.to_pylist():
                every = goals(row["cell"], row["high"], between[row["cell"]])
                few = max(1, SENT // len(row["data"]))
                for to in (every[at : at + few] for at in range(0, len(every), few)):
                    n = len(to)
                    yield pa.RecordBatch.from_arrays([pa.array([row["ids"]] * n, pa.list_(batch.schema.field("ids").type.value_type)), pa.array([row["data"]] * n, pa.binary()), pa.array([row["cell"]] * n, pa.int32()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["high"]] * n), pa.array([c for c, _ in to], pa.int32()), pa.array([p for _, p in to], pa.int32())], ["a_ids", "a_data", "a_cell", "a_part", "a_high", "cell", "part"])

    blocks = index.blocks(spark).where(F.col("cell") != NOWHERE)
    sent = blocks.mapInArrow(out, f"a_ids array<{kind}>, a_data binary, a_cell int, a_part int, a_high double, cell int, part int")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = sent.repartition(tasks, "cell", "part").hint("merge").join(blocks.repartition(tasks, "cell", "part"), ["cell", "part"]).where("a_cell < cell OR a_part <= part").select("a_ids", "a_data", "a_cell", "a_part", "a_high", "ids", "data", "high", "cell", "part")

    def run(batches):
        between = angles(centres @ centres.T) if len(centres) else None
        for batch in batches:
            for row in range(batch.num_rows):
                a_cell, a_part, a_high, high, cell, part = (batch.column(c)[row].as_py() for c in (2, 3, 4, 7, 8, 9))
                if between[a_cell, cell] - a_high - high > reach:
                    continue
                a_ids, ids = (batch.column(c)[row].values for c in (0, 5))
                a, b = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(len(i), -1) for c, i in ((1, a_ids), (6, ids)))
                raw = a @ b.T
                i, j = np.nonzero(raw >= least - SLACK)
                scores = np.round(raw[i, j], 6) + 0.0
                i, j, scores = (v[scores >= least] for v in (i, j, scores))
                x, y, same = np.array(a_ids.to_pylist())[i], np.array(ids.to_pylist())[j], (a_cell, a_part) == (cell, part)
                keep = x < y if same else x != y  # blocks of one part meet both ways
                x, y, s = x[keep], y[keep], scores[keep]
                turned = x > y
                yield pa.RecordBatch.from_arrays([pa.array(np.where(turned, y, x)).cast(ids.type), pa.array(np.where(turned, x, y)).cast(ids.type), pa.array(s)], ["x", "y", "score"])

    return met.mapInArrow(run, f"x {kind}, y {kind}, score double")
