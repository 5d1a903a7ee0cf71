"""Exact top-k search with vector-approximation files.

Components become integers.  Each dimension's range is cut into equal cells; the approximation of
a vector is the cell number of each component.  Blocks of queries meet blocks of approximations
on a grid.  From a cell's edges follow a lower and an upper bound of the inner product; a vector
stays a candidate if its upper bound reaches the k-th largest lower bound seen.  Exact vectors
are then read in the order of their bounds: first the few with the best bounds of each query,
then only those whose bound still reaches the k-th exact score so far, after which the result is
certain.

Equal vectors are searched once: each different vector stands for its rows, of which the k + 1 with
the smallest ids can be in a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.tables import Scratch, map_batches

#: Cells per dimension, vectors and queries per block, and blocks that meet a block of queries at once.
CELLS = 64
VECTORS, QUERIES = 4096, 512
MET = 16

#: Components beyond it are refused, so that differences of two fit 64 bits.
LARGEST = 2.0**61

#: Scores are two limbs, high * LIMB + low.
LIMB = 1 << 62


def _whole(scale: float):
    """(id, vector) to (uid, id, d, ints): rows with a finite vector; uid numbers the rows."""
    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            uids, ids, sizes, ints = [], [], [], []
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                uid += 1
                values = vector.values
                if name is None or values is None or values.null_count or not len(values):
                    continue
                values = values.to_numpy().astype(np.float64)
                if np.isfinite(values).all():
                    uids.append(uid)
                    ids.append(name)
                    sizes.append(len(values))
                    whole = np.floor(scale * values)
                    if np.abs(whole).max() > LARGEST:
                        raise OverflowError(f"a component of row {name} does not fit 62 bits")
                    ints.append(whole.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(ints, pa.binary())], ["uid", "id", "d", "ints"]
            )

    return run


def _matrix(rows: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), d)


def _by_size(batch, column: int):
    """Row numbers of a batch by the number of dimensions."""
    sizes = batch.column(column).to_numpy()
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def _ranges(batches):
    """Smallest and largest component of each dimension: (d, low, high) per task and size."""
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        rows = batch.column(1).to_pylist()
        for d, at in _by_size(batch, 0):
            block = _matrix([rows[i] for i in at], d)
            low, high = found.get(d, (block[0], block[0]))
            found[d] = [np.minimum(low, block.min(axis=0)), np.maximum(high, block.max(axis=0))]
    for d, (low, high) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "dim", "low", "high"]
        )


def _blocks(size: int, sides: int, grid, cells: int | None):
    """Vectors to blocks: (d, side, uids, data).  With ``cells`` the data are cell numbers."""
    def run(batches):
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() * 7919  # neighbours start at different sides

        def block(d, rows):
            nonlocal number
            number += 1
            ints = _matrix([r[1] for r in rows], d)
            data = cell_numbers(ints, grid[d], cells).tobytes() if cells else ints.tobytes()
            uids = np.array([r[0] for r in rows], "<i8").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([number % sides], pa.int32()), pa.array([uids], pa.binary()), pa.array([data], pa.binary())],
                ["d", "side", "uids", "data"],
            )

        for batch in batches:
            for uid, d, ints in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = held.setdefault(d, [])
                rows.append((uid, ints))
                if len(rows) == size:
                    yield block(d, held.pop(d))
        for d, rows in held.items():
            yield block(d, rows)

    return run


def cell_numbers(ints: np.ndarray, ranges: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    low, width = ranges[0], cell_width(ranges, cells)
    return ((ints - low) // width).astype(np.uint8)


def cell_width(ranges: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    return (ranges[1] - ranges[0]) // cells + 1


def largest_product(queries: np.ndarray, ranges: tuple[np.ndarray, np.ndarray]) -> float:
    """No inner product, nor a sum on the way to it, is larger."""
    return float(np.abs(queries).max(initial=0)) * float(max(np.abs(ranges[0]).max(initial=0), np.abs(ranges[1]).max(initial=0))) * queries.shape[-1]


def bounds(queries: np.ndarray, codes: np.ndarray, ranges, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries x approximations."""
    low, width = ranges[0], cell_width(ranges, cells)
    bottom = low + codes.astype(np.int64) * width
    top = np.minimum(bottom + width - 1, ranges[1])
    plus, minus, bottom, top = (x.astype(np.float64) for x in (np.maximum(queries, 0), np.minimum(queries, 0), bottom, top))
    largest = largest_product(queries, ranges)
    # Exact in floating point up to 2^52; beyond, the bounds give way by more than all roundings.
    slack = 0.0 if largest < 2.0**52 else largest * (queries.shape[1] + 4) * 2.0**-50
    return plus @ bottom.T + minus @ top.T - slack, plus @ top.T + minus @ bottom.T + slack


def _scan(k: int, grid, cells: int):
    """Grid cells to candidates (query uid, vector uid, lower, upper): those that may be among the best k."""
    def run(batches):
        for batch in batches:
            for d, quids, queries, blocks in zip(*(batch.column(i).to_pylist() for i in range(4))):
                quids = np.frombuffer(quids, "<i8")
                queries = np.frombuffer(queries, "<i8").reshape(-1, d)
                best = np.full((len(quids), k), -np.inf)
                kept: list[list[np.ndarray]] = []
                for block in blocks:
                    uids = np.frombuffer(block["uids"], "<i8")
                    lower, upper = bounds(queries, np.frombuffer(block["data"], np.uint8).reshape(-1, d), grid[d], cells)
                    top = lower if lower.shape[1] <= k else -np.partition(-lower, k - 1, axis=1)[:, :k]
                    best = -np.sort(-np.concatenate([best, top], axis=1), axis=1)[:, :k]
                    # Bounds of other blocks may be better still, so this keeps too many at first.
                    q, v = np.nonzero(upper >= best[:, -1:])
                    kept.append([q, uids[v], lower[q, v], upper[q, v]])
                q, v, low, high = (np.concatenate(x) for x in zip(*kept))
                stay = high >= best[q, -1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(quids[q[stay]]), pa.array(v[stay]), pa.array(low[stay]), pa.array(high[stay])],
                    ["query", "uid", "lower", "upper"],
                )

    return run


def _scores(large: set[int]):
    """Pairs of vectors to their inner products: (query, uid, high, low, near), near rounded to floating point."""
    def run(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                found.append(sum(x * y for x, y in zip(a.tolist(), b.tolist())) if len(a) in large else int(a @ b))
            limbs = [pa.array([x // LIMB for x in found], pa.int64()), pa.array([x % LIMB for x in found], pa.int64()), pa.array([float(x) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *limbs], ["query", "uid", "high", "low", "near"])

    return run


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, cells: int = CELLS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` best rows by integer inner product for each row whose id is divisible by ``every``.

    Components x count as floor(scale * x).  Returns query_id, rank (from 1), vec_id, score; ties
    go to the smaller id, then to the row read first.  A row is no candidate for itself, but a
    repeated row with the same id is.  Vectors that are null, empty, or hold null or non-finite
    components, and rows without id, take no part; vectors only meet vectors of equal length.
    A component that does not fit 62 bits is an error, as is a score of the result beyond 64 bits; larger
    scores on the way are exact.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vafile")
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = scratch.write(map_batches(source, _whole(scale), "uid BIGINT, id BIGINT, d INT, ints BINARY"), "rows")
    # One more than asked for: a query's own row is left out at the end.
    more = k + 1
    equal = Window.partitionBy("d", "ints").orderBy("id", "uid")
    members = rows.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= more).withColumn("class", F.first("uid").over(equal))
    members = scratch.write(members.select("class", "n", "uid", "id", "d", F.when(F.col("n") == 1, F.col("ints")).alias("ints")), "members")
    exact = members.where("n = 1").select("uid", "id", "d", "ints")
    asking = rows.where(F.col("id") % every == 0).join(exact.select(F.col("uid").alias("query"), "d", "ints"), ["d", "ints"])
    asking = scratch.write(asking.select("query", F.col("uid").alias("query_uid"), F.col("id").alias("query_id")), "asking")
    limits = map_batches(exact.select("d", "ints"), _ranges, "d INT, dim INT, low BIGINT, high BIGINT")
    limits = limits.groupBy("d", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d", "dim").collect()
    grid: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in sorted({r["d"] for r in limits}):
        own = [r for r in limits if r["d"] == d]
        grid[d] = (np.array([r["low"] for r in own], np.int64), np.array([r["high"] for r in own], np.int64))
    block = "d INT, side INT, uids BINARY, data BINARY"
    large = {d for d, ranges in grid.items() if largest_product(np.maximum(np.abs(ranges[0]), np.abs(ranges[1])), ranges) >= 2.0**62}
    different = exact.select("uid", "d", "ints")
    sides = max(MET, -(-exact.count() // (VECTORS * MET)))
    approximate = map_batches(different, _blocks(VECTORS, sides, grid, cells), block)
    asked = different.join(asking.select(F.col("query").alias("uid")).distinct(), "uid").select("uid", "d", "ints")
    asked = map_batches(asked, _blocks(QUERIES, sides, grid, None), block)
    # Every block of queries goes to each side of the approximations; a side holds a bounded number of blocks.
    spread = asked.select("d", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"), F.col("uids").alias("quids"), F.col("data").alias("queries"))
    gathered = approximate.groupBy("d", "side").agg(F.collect_list(F.struct("uids", "data")).alias("blocks"))
    cells_met = spread.join(gathered, ["d", "side"]).select("d", "quids", "queries", "blocks")
    found = scratch.write(map_batches(cells_met, _scan(more, grid, cells), "query BIGINT, uid BIGINT, lower DOUBLE, upper DOUBLE"), "candidates")
    by_lower = Window.partitionBy("query").orderBy(F.desc("lower"), "uid")
    least = found.withColumn("n", F.row_number().over(by_lower)).where(F.col("n") == more).select("query", F.col("lower").alias("least"))
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "uid")
    left = found.join(least, "query", "left").where("least is null or upper >= least").withColumn("turn", F.row_number().over(order))
    left = scratch.write(left.select("query", "uid", "upper", "turn"), "ordered")

    def read(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(exact.select("uid", F.col("ints").alias("vector")), "uid")
        pairs = pairs.join(exact.select(F.col("uid").alias("query"), F.col("ints").alias("asked")), "query")
        return map_batches(pairs.select("query", "uid", "vector", "asked"), _scores(large), "query BIGINT, uid BIGINT, high BIGINT, low BIGINT, near DOUBLE")

    first = scratch.write(read(left.where(F.col("turn") <= 2 * more)), "first")
    score = [F.desc("high"), F.desc("low")]
    by_score = Window.partitionBy("query").orderBy(*score, "uid")
    reached = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == more).select("query", F.col("near").alias("reached"))
    second = read(left.where(F.col("turn") > 2 * more).join(reached, "query").where("upper >= reached"))
    scored = first.unionByName(second).join(exact.select("uid", "id"), "uid")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*score, "id", "uid"))).where(F.col("n") <= more)
    best = best.select("query", "high", "low", F.col("uid").alias("class")).join(members.select("class", "uid", "id"), "class")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*score, "id", "uid"))).where(F.col("n") <= more)
    lists = scratch.write(best.select("query", "uid", "id", "high", "low"), "lists")
    others = asking.join(lists, "query").where("uid <> query_uid")
    final = Window.partitionBy("query_uid").orderBy(*score, "id", "uid")
    top = others.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    whole = F.when(F.col("high").between(-2, 1), F.col("high") * LIMB + F.col("low")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")))
    return top.select("query_id", "rank", F.col("id").alias("vec_id"), whole.cast("bigint").alias("score"))
