"""Hard-negative mining with rotated one-bit codes.

Components become integers.  A vector is rotated (random signs, then a Hadamard matrix, so that
rotated components are integers too) and keeps one bit per component, its length, and its
alignment: the inner product with the unit vector its bits stand for.  A query is rotated as well
and cut into levels of eight bits; counting the ones in the bits that a code and each bit plane
share gives the query's product with the code's unit vector up to the rounding of the levels.  What is left of both
vectors is orthogonal to that unit vector, so by the Cauchy-Schwarz inequality the product of its
lengths bounds the rest: every inner product lies in a certain interval.  Only rows whose interval
can reach the best ones so far are scored, with integers.

All rows are dealt once to sides of bounded size; blocks of queries go to every side and bring
back, per side, no more rows than were asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.tables import Scratch, map_batches
from axonframe.llm.words import mix

#: Vectors and queries per block, blocks per side, and the least number of sides.
VECTORS, QUERIES = 2048, 64
MET = 16
SIDES = 16

#: Pairs scored at once.
PAIRS = 1 << 14

LEVELS = 8
SEED = 13

_ROWS = "uid BIGINT, id BIGINT, label BIGINT, d INT, ints BINARY"


def _whole(scale: float):
    """(id, label, vector) to rows that take part; uid numbers them.  Whole numbers are kept as doubles, which hold them exactly."""
    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            kept = []
            for name, label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                uid += 1
                values = vector.values
                if name is None or label is None or values is None or values.null_count or not len(values):
                    continue
                values = values.to_numpy().astype(np.float64)
                if np.isfinite(values).all():
                    kept.append((uid, name, label, len(values), np.floor(scale * values).astype("<f8").tobytes()))
            columns = list(zip(*kept)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["uid", "id", "label", "d", "ints"])

    return run


def rotated(ints: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows times random signs and an (unscaled) Hadamard matrix; the width grows to a power of two, 64 at least."""
    n, d = ints.shape
    width = max(64, 1 << (d - 1).bit_length())
    signs = 1.0 - 2.0 * (mix(np.arange(d, dtype=np.uint64) + np.uint64(seed << 32)) & np.uint64(1))
    out = np.zeros((n, width))
    out[:, :d] = ints * signs
    half = 1
    while half < width:
        pairs = out.reshape(n, -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return out


class Codes:
    """One bit per rotated component (1 for not negative), squared lengths and alignments of vectors."""

    def __init__(self, ints: np.ndarray):
        turned = rotated(ints)
        self.width = turned.shape[1]
        self.bits = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
        self.lengths = (ints * ints).sum(axis=1)
        self.align = np.abs(turned).sum(axis=1) / self.width


class Asked:
    """Rotated queries as bit planes of levels, with the rounding error of the levels."""

    def __init__(self, ints: np.ndarray):
        turned = rotated(ints)
        n, self.width = turned.shape
        self.lengths = (ints * ints).sum(axis=1)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << LEVELS) - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None])
        rounded = self.low[:, None] + levels * self.step[:, None]
        self.error = np.abs(turned - rounded).sum(axis=1) / self.width
        self.sums = rounded.sum(axis=1)
        planes = (levels.astype(np.int64)[:, :, None] >> np.arange(LEVELS)) & 1
        self.planes = [np.packbits(planes[:, :, j].astype(bool), axis=1, bitorder="little").view(np.uint64) for j in range(LEVELS)]


def intervals(asked: Asked, codes: Codes, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of all queries with some of the vectors."""
    bits = codes.bits[rows]
    ones = np.zeros((len(asked.low), len(bits)), np.int64)
    shared = np.zeros_like(ones)
    for word in range(bits.shape[1]):
        own = bits[:, word]
        ones += np.bitwise_count(own)[None, :]
        for j, plane in enumerate(asked.planes):
            shared += np.bitwise_count(plane[:, word, None] & own[None, :]).astype(np.int64) << j
    # Components with a one minus those without: twice the former less all.
    near = (2.0 * (asked.low[:, None] * ones + asked.step[:, None] * shared) - asked.sums[:, None]) / asked.width
    error = asked.error[:, None]
    align, lengths = codes.align[rows][None, :], codes.lengths[rows][None, :]
    least = np.maximum(np.abs(near) - error, 0.0)
    rest = np.sqrt(np.maximum(asked.lengths[:, None] - least * least, 0.0) * np.maximum(lengths - align * align, 0.0))
    # Room for floating-point errors, far above them.
    rest += align * error + 1e-6 * np.sqrt(asked.lengths[:, None] * lengths) + 1e-6
    middle = align * near
    return middle - rest, middle + rest


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows.  One beyond 64 bits is an error; it never wraps around."""
    rough = np.einsum("ij,ij->i", a, b)
    if not len(rough) or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return rough.astype(np.int64)
    if float(np.abs(rough).max()) < 2.0**62 and max(float(np.abs(a).max()), float(np.abs(b).max())) < 2.0**62:
        with np.errstate(over="ignore"):  # Sums modulo 2^64 end at the right number.
            return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)
    exact = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]
    if max(map(abs, exact)) >= 1 << 63:
        raise OverflowError("an inner product of whole-number vectors does not fit 64 bits")
    return np.array(exact, np.int64)


class Best:
    """The k best rows of each owner: highest score, then smallest id, then smallest row number."""

    def __init__(self, owners: int, k: int):
        self.k, self.owners = k, owners
        self.rows = np.zeros((4, 0), np.int64)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([owner, score, ids, uids])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], ~rows[1], rows[0]))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, rank < self.k]

    def reached(self) -> np.ndarray:
        """The score a further row must have, or minus infinity while there are fewer than k."""
        out = np.full(self.owners, -np.inf)
        full = np.searchsorted(self.rows[0], np.arange(self.owners), "right") - 1
        counts = np.bincount(self.rows[0], minlength=self.owners)
        out[counts == self.k] = self.rows[1][full[counts == self.k]]
        return out


def _blocks(size: int, sides: int, queries: bool):
    """Rows (uid, id, label, d, ints[, goals]) to blocks of one length of vectors; a block of vectors goes to one side."""
    def run(batches):
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() * 7919  # neighbours start at different sides

        def block(d, rows):
            nonlocal number
            number += 1
            side = -1 if queries else number % sides
            packed = [np.array([r[i] for r in rows], "<i8").tobytes() for i in range(3)]
            goals = [r[4] for r in rows] if queries else []
            return pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([side], pa.int32()), *(pa.array([p], pa.binary()) for p in packed),
                 pa.array([b"".join(r[3] for r in rows)], pa.binary()), pa.array([goals], pa.list_(pa.list_(pa.int64())))],
                ["d", "side", "uids", "ids", "labels", "ints", "goals"],
            )

        for batch in batches:
            for uid, name, label, d, ints, *goals in zip(*(c.to_pylist() for c in batch.columns)):
                rows = held.setdefault(d, [])
                rows.append((uid, name, label, ints, *goals))
                if len(rows) == size:
                    yield block(d, held.pop(d))
        for d, rows in held.items():
            yield block(d, rows)

    return run


_BLOCK = "d INT, side INT, uids BINARY, ids BINARY, labels BINARY, ints BINARY, goals ARRAY<ARRAY<BIGINT>>"


class Side:
    """The vectors of one side, ordered by label."""

    def __init__(self, blocks: list[dict], d: int):
        uids, ids, labels = (np.concatenate([np.frombuffer(b[name], "<i8") for b in blocks]) for name in ("uids", "ids", "labels"))
        ints = np.concatenate([np.frombuffer(b["ints"], "<f8").reshape(-1, d) for b in blocks])
        order = np.argsort(labels, kind="stable")
        self.uids, self.ids, self.labels, self.ints = uids[order], ids[order], labels[order], ints[order]
        self.codes = Codes(self.ints)

    def parts(self, start: int, stop: int):
        return [slice(a, min(a + VECTORS, stop)) for a in range(start, stop, VECTORS)]

    def add(self, best: Best, part: slice, ints: np.ndarray, q: np.ndarray, v: np.ndarray, owners) -> None:
        """Score pairs (query q, row v of the part) and offer them to the owners that ``owners`` names for (q, v, scores)."""
        for a in range(0, len(q), PAIRS):
            qs, vs = q[a : a + PAIRS], part.start + v[a : a + PAIRS]
            found = scores(ints[qs], self.ints[vs])
            for owner, keep in owners(qs, vs, found):
                best.add(owner[keep], found[keep], self.ids[vs[keep]], self.uids[vs[keep]])


def _kth(lower: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or minus infinity."""
    return -np.partition(-lower, k - 1, axis=1)[:, k - 1] if lower.shape[1] >= k else np.full(len(lower), -np.inf)


def positives_of(side: Side, uids: np.ndarray, labels: np.ndarray, ints: np.ndarray, k: int) -> Best:
    """The k best other rows of each query's label on one side."""
    best = Best(len(uids), k)
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        asked = Asked(ints[at])
        for part in side.parts(np.searchsorted(side.labels, label), np.searchsorted(side.labels, label, "right")):
            lower, upper = intervals(asked, side.codes, part)
            own = uids[at][:, None] == side.uids[part][None, :]
            lower[own] = upper[own] = -np.inf
            needed = np.maximum(best.reached()[at], _kth(lower, k))
            q, v = np.nonzero((upper >= needed[:, None]) & ~own)
            side.add(best, part, ints, at[q], v, lambda qs, vs, found: [(qs, np.ones(len(qs), bool))])
    return best


def negatives_of(side: Side, labels: np.ndarray, ints: np.ndarray, goals: list[list[int]], k: int, low: int, high: int) -> tuple[Best, int]:
    """The k best rows of other labels for each (query, goal) whose score lies between the shares of the goal."""
    most = max(map(len, goals))
    best = Best(len(goals) * most, k)
    asked = Asked(ints)
    # A missing goal is a window nothing fits.
    wanted = np.array([g + [None] * (most - len(g)) for g in goals], object)
    bottom = np.array([[np.inf if g is None else -(-low * g // 100) for g in row] for row in wanted], np.float64)
    top = np.array([[-np.inf if g is None else high * g // 100 for g in row] for row in wanted], np.float64)
    # Shares of a goal as whole numbers, compared exactly.
    exact = [[(1, 0) if g is None else (-(-low * g // 100), high * g // 100) for g in row] for row in wanted]
    exact = np.clip(np.array(exact, object), -(1 << 63), (1 << 63) - 1).astype(np.int64).reshape(len(goals), most, 2)
    for part in side.parts(0, len(side.uids)):
        lower, upper = intervals(asked, side.codes, part)
        other = labels[:, None] != side.labels[part][None, :]
        reach = best.reached().reshape(len(goals), most)
        any_goal = np.zeros(other.shape, bool)
        for j in range(most):
            surely = other & (lower >= bottom[:, j, None]) & (upper <= top[:, j, None])
            needed = np.maximum(np.maximum(reach[:, j], _kth(np.where(surely, lower, -np.inf), k)), bottom[:, j])
            any_goal |= other & (upper >= needed[:, None]) & (lower <= top[:, j, None])
        q, v = np.nonzero(any_goal)

        def owners(qs, vs, found):
            return [(qs * most + j, (found >= exact[qs, j, 0]) & (found <= exact[qs, j, 1])) for j in range(most)]

        side.add(best, part, ints, q, v, owners)
    return best, most


def _meet(run_block):
    """Sorted (d, side) with vectors first: holds one side, lets blocks of queries pass by."""
    def run(batches):
        place, held, side = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["d"], row["side"]) != place:
                    place, held, side = (row["d"], row["side"]), [], None
                if not row["asks"]:
                    held.append(row)
                    continue
                if side is None and held:
                    side, held = Side(held, row["d"]), []
                if side is not None:
                    uids, labels = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                    yield run_block(side, uids, labels, np.frombuffer(row["ints"], "<f8").reshape(len(uids), -1), row["goals"])

    return run


def _find_positives(k: int):
    def run(side, uids, labels, ints, goals):
        owner, score, ids, found = positives_of(side, uids, labels, ints, k).rows
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (uids[owner], score, ids, found)], ["query", "score", "id", "uid"])

    return run


def _find_negatives(k: int, low: int, high: int):
    def run(side, uids, labels, ints, goals):
        best, most = negatives_of(side, labels, ints, goals, k, low, high)
        owner, score, ids, found = best.rows
        goal = np.array([goals[o // most][o % most] for o in owner.tolist()], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (uids[owner // most], goal, score, ids, found)], ["query", "goal", "score", "id", "uid"])

    return run


def _met(queries: DataFrame, vectors: DataFrame, sides: int, run, schema: str) -> DataFrame:
    """Blocks of queries against the blocks of vectors of every side."""
    every = queries.drop("side").withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).withColumn("asks", F.lit(True))
    both = vectors.withColumn("asks", F.lit(False)).unionByName(every)
    return map_batches(both.repartition("d", "side").sortWithinPartitions("d", "side", "asks"), _meet(run), schema)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Near rows of other labels for each anchor (a row whose id is divisible by ``every``) and each of its positives.

    Components x count as floor(scale * x), scores are integer inner products with the anchor;
    higher ones come first, then smaller ids.  An anchor's positives are the first other rows of
    its label.  For each, the first ``negatives`` rows of other labels follow whose score lies between
    ``low`` and ``high`` percent of the positive's.  Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Rows without id or label, and with vectors that are null, empty or hold null or non-finite
    components, take no part.  Vectors only meet vectors of equal length.  Rows that repeat an id
    are rows of their own: each is an anchor, and may be positive or negative of the other.  A positive
    without negatives gives no row, nor does an empty table.  A score beyond 64 bits is an error.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    exact = scratch.write(map_batches(source, _whole(scale), _ROWS), "exact")
    sides = max(SIDES, -(-exact.count() // (VECTORS * MET)))
    blocks = scratch.write(map_batches(exact, _blocks(VECTORS, sides, False), _BLOCK), "blocks")
    anchors = exact.where(F.col("id") % every == 0)
    asked = map_batches(anchors.withColumn("goals", F.expr("cast(array() as array<bigint>)")), _blocks(QUERIES, sides, True), _BLOCK)
    order = [F.desc("score"), F.asc("id"), F.asc("uid")]

    found = _met(asked, blocks, sides, _find_positives(positives), "query BIGINT, score BIGINT, id BIGINT, uid BIGINT")
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= positives)
    first = scratch.write(first.select("query", F.col("id").alias("positive_id"), F.col("score").alias("goal")), "positives")
    goals = first.groupBy("query").agg(F.collect_set("goal").alias("goals"))  # At most ``positives`` numbers.
    asked = map_batches(anchors.join(goals, anchors["uid"] == goals["query"]).drop("query"), _blocks(QUERIES, sides, True), _BLOCK)
    found = _met(asked, blocks, sides, _find_negatives(negatives, low, high), "query BIGINT, goal BIGINT, score BIGINT, id BIGINT, uid BIGINT")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "goal").orderBy(*order))).where(F.col("rank") <= negatives)
    names = anchors.select(F.col("uid").alias("query"), F.col("id").alias("anchor_id"))
    return first.join(best, ["query", "goal"]).join(names, "query").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"),
    )
