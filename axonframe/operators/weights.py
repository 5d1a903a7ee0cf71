"""Connection strengths from model weights, and the strongest connections of every neuron.

The strength between a source row and a target row is the weighted dot product of their
vectors.  The rows searched are dealt to sides and the rows that search to parts, both of bounded
size, per layer searched; one task holds one side, longest vectors first, lets one part pass by and
multiplies blocks as matrices.  Each searching row keeps a running list of its strongest
connections, and a block is skipped when its longest vector cannot reach any list any more, so
pairs are never written out and a side returns no more rows than are asked for.  A row travels
once per side or part it meets: sides and parts are as few as the tasks wanted and their bounds
allow, so that this stays far below the pairs and, until the bounds are met, in proportion to the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.operators.scale import join_sized
from axonframe.schemas import NEURON
from axonframe.session import cut_lineage

#: Vectors multiplied at once, the most blocks per side, and the most bytes of a side's vectors.
BLOCK = 512
SIDE_BLOCKS = 256
SIDE_BYTES = 64 * 1024 * 1024
#: The most blocks of searching rows per part, and the most bytes of a part's vectors.
PART_BLOCKS = 256
PART_BYTES = 128 * 1024 * 1024
#: Sides and parts of fewer blocks are not made for the sake of more tasks.
LEAST_BLOCKS = 4
#: Bytes of a row besides its vector, and of a candidate, as they are shuffled.
ROW_BYTES = 64
CANDIDATE_BYTES = 32
#: Sparse vectors: dimensions multiplied at once, products listed at once, and the time of a listed one in multiplied ones.
SLAB = 1024
LISTED = 4_000_000
LISTED_COST = 400
KEPT = 10
SIGNS = ("positive", "negative")

_CANDIDATES = "sign STRING, layer INT, neuron BIGINT, to_layer INT, to_neuron BIGINT, weight DOUBLE"


def _true_places(hit: np.ndarray) -> np.ndarray:
    """Flat positions of the few true values: eight at a time are looked at first."""
    flat = hit.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    groups = np.flatnonzero(flat.view(np.uint64))
    group, inside = np.nonzero(flat.reshape(-1, 8)[groups])
    return groups[group] * 8 + inside


class _Strongest:
    """Running lists of the ``kept`` largest values of each row; equal ones go to the lower name, NaN comes last."""

    def __init__(self, rows: int, kept: int):
        self.rows, self.kept = rows, kept
        self.row, self.value, self.name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.reached = np.full(rows, -np.inf)
        self.open = np.ones(rows, bool)
        #: For a block of rounded products: how far those of a row may be off, and a function of pairs for the exact ones.
        self.slack, self.exact = 0.0, None

    def see(self, product: np.ndarray, names: np.ndarray, met: Callable[[], np.ndarray] | None = None) -> None:
        """``met`` tells which pairs count at all; the others have the product 0."""
        limit, counted = self.reached, None
        if self.open.any():
            counted = met and met()
            if product.shape[1] > self.kept:
                # Not below the block's own last value either, while lists are not full.
                rows = np.flatnonzero(self.open)
                own = product[rows] if counted is None else np.where(counted[rows], product[rows], -np.inf)
                limit = limit.copy()
                limit[rows] = -np.partition(-own, self.kept - 1, axis=1)[:, self.kept - 1]
                limit[rows] -= np.broadcast_to(self.slack, self.rows)[rows]
        low = limit
        if self.exact:
            low = np.nextafter((limit - self.slack).astype(product.dtype), product.dtype.type(-np.inf))
        hit = product < low[:, None]
        place = _true_places(np.logical_not(hit, out=hit))
        row, column = np.divmod(place, product.shape[1])
        value = self.exact(row, column) if self.exact else product.ravel()[place]
        stay = ~(value < limit[row])
        if met and len(place):
            if counted is None and (value == 0).any():
                counted = met()
            if counted is not None:
                stay &= counted.ravel()[place]
        if not stay.any():
            return
        self.row = np.concatenate([self.row, row[stay]])
        self.value = np.concatenate([self.value, value[stay]])
        self.name = np.concatenate([self.name, names[column[stay]]])
        if self.open.any() or len(self.row) > 3 * self.rows * self.kept:
            self.trim()

    def trim(self) -> None:
        order = np.lexsort((self.name, -self.value, self.row))
        row = self.row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        stay = order[rank < self.kept]
        self.row, self.value, self.name = self.row[stay], self.value[stay], self.name[stay]
        last = rank[rank < self.kept] == self.kept - 1
        self.reached[self.row[last]] = self.value[last]
        self.open[self.row[last]] = False


def _parts(column: pa.Array, what: str) -> tuple[np.ndarray, np.ndarray]:
    """Items per row of a list column, and all items."""
    if column.null_count:
        raise ValueError(f"a {what} is null")
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


class _Dense:
    """Rows with one vector each, all of the same length."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> _Dense:
        sizes, values = _parts(batch.column(5), "vector")
        if len(set(sizes.tolist())) > 1:
            raise ValueError("vectors differ in length")
        return cls(values.astype(np.float64).reshape(len(sizes), -1))

    @classmethod
    def concat(cls, pieces: list[_Dense]) -> _Dense:
        if len({p.matrix.shape[1] for p in pieces}) > 1:
            raise ValueError("vectors differ in length")
        return cls(np.concatenate([p.matrix for p in pieces]))

    def take(self, rows) -> _Dense:
        return _Dense(self.matrix[rows])

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.sqrt((self.matrix * self.matrix).sum(axis=1))

    @cached_property
    def short(self) -> np.ndarray | None:
        """The vectors in single precision, where their products neither overflow nor vanish in it."""
        most = self.lengths.max(initial=0)
        return self.matrix.astype(np.float32) if 1e-6 < most < 1e15 else None

    def row_bytes(self) -> Iterator[bytes]:
        return (row.tobytes() for row in self.matrix)

    def product(self, side: _Dense, start: int, stop: int):
        """Products, how far they may be off, the exact ones of pairs of positions, and which pairs count (None: all)."""
        if self.short is None or side.short is None:
            return self.matrix @ side.matrix[start:stop].T, 0.0, None, None
        width = self.matrix.shape[1]
        # Rounded components, products and sums; the last term is for components that vanish.
        slack = self.lengths * side.lengths[start:stop].max() * (width + 8) * 2.0**-23 + width * 1e-22

        def exact(row: np.ndarray, column: np.ndarray) -> np.ndarray:
            step = max(1, LISTED // (4 * max(width, 1)))
            parts = [slice(low, low + step) for low in range(0, len(row), step)]
            return np.concatenate([np.zeros(0)] + [
                np.einsum("ij,ij->i", self.matrix[row[part]], side.matrix[start + column[part]]) for part in parts
            ])

        return self.short @ side.short[start:stop].T, slack, exact, None


class _Sparse:
    """Rows with the dimensions and values of their non-zero components."""

    def __init__(self, sizes: np.ndarray, dims: np.ndarray, values: np.ndarray):
        self.sizes, self.dims, self.values = sizes, dims, values
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> _Sparse:
        sizes, dims = _parts(batch.column(5), "list of dimensions")
        return cls(sizes, dims, _parts(batch.column(6), "list of values")[1])

    @classmethod
    def concat(cls, pieces: list[_Sparse]) -> _Sparse:
        return cls(*(np.concatenate([getattr(p, name) for p in pieces]) for name in ("sizes", "dims", "values")))

    def take(self, rows) -> _Sparse:
        if isinstance(rows, slice):
            low, high, _ = rows.indices(len(self.sizes))
            inside = slice(self.starts[low], self.starts[high])
            return _Sparse(self.sizes[rows], self.dims[inside], self.values[inside])
        sizes = self.sizes[rows]
        inside = np.repeat(self.starts[:-1][rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return _Sparse(sizes, self.dims[inside], self.values[inside])

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.sqrt(np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), self.values * self.values, len(self.sizes)))

    def row_bytes(self) -> Iterator[bytes]:
        for low, high in zip(self.starts[:-1], self.starts[1:]):
            yield self.dims[low:high].tobytes() + self.values[low:high].tobytes()

    def product(self, side: _Sparse, start: int, stop: int):
        there = side.take(slice(start, stop))
        shape = len(self.sizes), len(there.sizes)
        dims, own = np.unique(self.dims, return_inverse=True)
        place = np.minimum(np.searchsorted(dims, there.dims), max(len(dims) - 1, 0))
        shared = dims[place] == there.dims if len(dims) else np.zeros(len(there.dims), bool)
        other, y = place[shared], there.values[shared]
        column = np.repeat(np.arange(shape[1]), there.sizes)[shared]
        row, x = np.repeat(np.arange(shape[0]), self.sizes), self.values
        order = np.argsort(other, kind="stable")
        other, y, column = other[order], y[order], column[order]
        first = np.searchsorted(other, own)
        many = np.searchsorted(other, own, "right") - first
        finite = np.isfinite(x).all() and np.isfinite(y).all()
        if finite and many.sum() * LISTED_COST > len(dims) * shape[0] * shape[1]:
            def multiplied(x, y, kind):
                total = np.zeros(shape, kind)
                for low in range(0, len(dims), SLAB):
                    left, right = np.zeros((shape[0], SLAB), kind), np.zeros((shape[1], SLAB), kind)
                    mine, theirs = (own >= low) & (own < low + SLAB), (other >= low) & (other < low + SLAB)
                    left[row[mine], own[mine] - low], right[column[theirs], other[theirs] - low] = x[mine], y[theirs]
                    width = min(SLAB, len(dims) - low)
                    total += left[:, :width] @ right[:, :width].T
                return total

            ones = lambda values: np.ones(len(values), np.float32)
            return multiplied(x, y, np.float64), 0.0, None, lambda: multiplied(ones(x), ones(y), np.float32) > 0
        # Few dimensions in common: their products are listed and summed by pair.
        total, met = np.zeros(shape[0] * shape[1]), np.zeros(shape[0] * shape[1], bool)
        upto = np.cumsum(many)
        low = 0
        while low < len(many):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + LISTED, "right")))
            count = many[low:high]
            at = np.repeat(first[low:high] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            pair = np.repeat(row[low:high], count) * shape[1] + column[at]
            total += np.bincount(pair, np.repeat(x[low:high], count) * y[at], len(total))
            met[pair] = True
            low = high
        return total.reshape(shape), 0.0, None, lambda: met.reshape(shape)


def _search(kept: int, block: int, signs: tuple[str, ...] = SIGNS, form: type = _Dense):
    """Sorted (to_layer, side, asks, layer, neuron, vector): holds one side, lets searching rows pass by."""
    def longest_first(names, rows):
        # Of equal vectors, only the lowest ``kept`` names can be on any list.
        seen, keys = Counter(), list(rows.row_bytes())
        stay = []
        for i in np.argsort(names, kind="stable").tolist():
            seen[keys[i]] += 1
            if seen[keys[i]] <= kept:
                stay.append(i)
        names, rows = names[stay], rows.take(np.array(stay, np.int64))
        order = np.argsort(-rows.lengths, kind="stable")
        return names[order], rows.take(order)

    def answer(side, layers, own, query):
        names, vectors = side
        reach, lengths = query.lengths, vectors.lengths
        lists = {sign: _Strongest(len(own), kept) for sign in SIGNS if sign in signs}
        for start in range(0, len(names), block):
            # Later blocks hold shorter vectors.  The margin is far above rounding errors.
            most = reach * lengths[start] * (1 + 1e-9)
            if start and all((most < found.reached).all() for found in lists.values()):
                break
            product, slack, exact, met = query.product(vectors, start, start + block)
            for sign, found in lists.items():
                found.slack, found.exact = slack, exact
                if sign == "negative":
                    product = np.negative(product, out=product)
                    found.exact = exact and (lambda row, column: -exact(row, column))
                found.see(product, names[start : start + block], *([met] if met else []))
        for sign, found in lists.items():
            found.trim()
            yield sign, layers[found.row], own[found.row], found.name, found.value if sign == "positive" else -found.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, side, asking, waiting = None, [], None, [], 0

        def flush():
            layers, own = (np.concatenate([a[i] for a in asking]) for i in range(2))
            rows = form.concat([a[2] for a in asking])
            for low in range(0, len(own), block):
                part = slice(low, low + block)
                for sign, layer, neuron, name, value in answer(side, layers[part], own[part], rows.take(part)):
                    columns = [pa.array([sign] * len(layer)), pa.array(layer.astype(np.int32)), pa.array(neuron), pa.array(np.full(len(layer), place[0], np.int32)), pa.array(name), pa.array(value)]
                    yield pa.RecordBatch.from_arrays(columns, ["sign", "layer", "neuron", "to_layer", "to_neuron", "weight"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if any(batch.column(i).null_count for i in range(5)):
                raise ValueError("a layer or neuron is null")
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rows = form.read(batch)
            new = reduce(np.logical_or, [key[1:] != key[:-1] for key in keys[:3]])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                here = keys[0][low].item(), keys[1][low].item()
                if here != place:
                    if asking:
                        yield from flush()
                    place, held, side, asking, waiting = here, [], None, [], 0
                names, piece = keys[4][low:high], rows.take(slice(low, high))
                if not keys[2][low]:
                    held.append((names, piece))
                    continue
                if side is None:
                    if not held:
                        continue
                    side = longest_first(np.concatenate([h[0] for h in held]), form.concat([h[1] for h in held]))
                    held = []
                asking.append((keys[3][low:high], names, piece))
                waiting += high - low
                if waiting >= block:
                    yield from flush()
                    asking, waiting = [], 0
        if asking:
            yield from flush()

    return run


def scaled(vectors: DataFrame, gains: DataFrame | None) -> DataFrame:
    """Multiply each vector by its layer's gain vector, if there are gains."""
    if gains is None:
        return vectors
    return join_sized(vectors, gains, ["layer"]).withColumn(
        "vector", F.zip_with("vector", "gain", lambda v, g: v * g)
    ).drop("gain")


def _layer_rows(rows: DataFrame, width: str) -> dict[int, tuple[int, int]]:
    """Rows per layer of the model, and the most components of one."""
    found = rows.groupBy("layer").agg(F.count("*").alias("n"), F.max(F.size(width)).alias("width")).collect()
    return {r["layer"]: (r["n"], r["width"] or 0) for r in found if r["layer"] is not None}


def _shape(searched: tuple[int, int], asking: tuple[int, int], tasks: int, answers: int, block: int) -> tuple[int, int]:
    """Sides and parts for rows that are searched and rows that ask, both given as rows and components.

    A searched row travels once per part, an asking one once per side, which gives it up to ``answers``
    candidates.  Of the shapes that make the wanted tasks, the one that moves the fewest bytes is taken.
    Its copies per row grow with the root of the tasks and do not depend on the rows until the bounds are met.
    """
    fewest, most = [], []
    for (rows, width), blocks, room in ((searched, SIDE_BLOCKS, SIDE_BYTES), (asking, PART_BLOCKS, PART_BYTES)):
        held = max(block, min(block * blocks, room // (8 * max(width, 1))))
        fewest.append(-(-rows // held))
        most.append(max(fewest[-1], -(-rows // (block * LEAST_BLOCKS))))
    shapes = []
    for sides in range(fewest[0], max(fewest[0], min(most[0], tasks)) + 1):
        parts = max(fewest[1], min(most[1], -(-tasks // sides)))
        moved = searched[0] * parts * (8 * searched[1] + ROW_BYTES) + asking[0] * sides * (
            8 * asking[1] + ROW_BYTES + min(answers, searched[0] // sides) * CANDIDATE_BYTES
        )
        shapes.append((-min(sides * parts, tasks), moved, sides, parts))
    return min(shapes)[2:]


def _connected(
    asking: DataFrame, searched: DataFrame, layers: dict[int, tuple[int, int]], sizes: dict[int, tuple[int, int]], vector: list[str],
    kept: int, block: int, signs: tuple[str, ...], form: type, allowed: Callable[[int, int], bool],
) -> DataFrame:
    """Candidates for the ``kept`` strongest connections of each asking row, at most kept per sign, row and side.

    ``layers`` has rows and components of the asking layers, ``sizes`` those of the searched ones;
    both are as short as the model has layers.
    """
    spark = asking.sparkSession
    met = {to: [own for own in layers if allowed(own, to)] for to in sizes}
    asks = {to: (sum(layers[own][0] for own in owns), max(layers[own][1] for own in owns)) for to, owns in met.items() if owns}
    pairs = {to: sizes[to][0] * n for to, (n, _) in asks.items()}
    wanted = 2 * spark.sparkContext.defaultParallelism
    places, tasks = {}, 0
    for to in asks:
        share = -(-wanted * pairs[to] // sum(pairs.values()))
        sides, parts = _shape(sizes[to], asks[to], share, kept * len(signs), block)
        places[to] = sides, parts, tasks
        tasks += sides * parts
    shape = "to_layer INT, sides INT, parts INT, first INT"
    # The column side numbers the tasks: first + side * parts + part.
    base_places = spark.createDataFrame([(to, *p) for to, p in places.items()], shape)
    base = searched.join(F.broadcast(base_places.withColumnRenamed("to_layer", "layer")), "layer").withColumn(
        "own", F.col("first") + F.pmod(F.xxhash64("neuron"), F.col("sides")).cast("int") * F.col("parts")
    ).select(
        F.col("layer").alias("to_layer"), F.explode(F.sequence("own", F.col("own") + F.col("parts") - 1)).alias("side"),
        F.lit(False).alias("asks"), "layer", "neuron", *vector,
    )
    table = spark.createDataFrame([(own, to, *places[to]) for to in places for own in met[to]], f"layer INT, {shape}")
    lists = table.groupBy("layer").agg(F.collect_list(F.struct("to_layer", "sides", "parts", "first")).alias("met"))
    asked = asking.join(F.broadcast(lists), "layer").select("layer", "neuron", *vector, F.inline("met")).withColumn(
        # Not the hash that deals rows to sides, so that equal rows of both kinds are spread apart.
        "own", F.col("first") + F.pmod(F.hash("neuron", "layer"), F.col("parts"))
    ).select(
        "to_layer", F.explode(F.sequence("own", F.col("own") + (F.col("sides") - 1) * F.col("parts"), "parts")).alias("side"),
        F.lit(True).alias("asks"), "layer", "neuron", *vector,
    )
    both = base.unionByName(asked)
    ordered = both.repartitionById(max(tasks, 1), F.col("side")).sortWithinPartitions("to_layer", "side", "asks")
    return ordered.mapInArrow(_search(kept, block, signs, form), _CANDIDATES)


def _both_ways(
    sources: DataFrame, targets: DataFrame, vector: list[str], kept: int, block: int, later_layers_only: bool,
    directions: tuple[str, ...], signs: tuple[str, ...], form: type,
) -> DataFrame:
    """The lists of both directions; the rows have layer, neuron and the columns ``vector``."""
    counts = [_layer_rows(side, vector[0]) for side in (sources, targets)]
    found = []
    for direction in directions:
        here, there = (0, 1) if direction == "output" else (1, 0)

        def allowed(own: int, other: int) -> bool:
            return not later_layers_only or (own < other if direction == "output" else own > other)

        rows = (sources, targets)
        candidates = _connected(rows[here], rows[there], counts[here], counts[there], vector, kept, block, signs, form, allowed)
        found.append(candidates.withColumn("direction", F.lit(direction)))
    return _listed(reduce(DataFrame.unionByName, found), kept)


def _listed(candidates: DataFrame, kept: int) -> DataFrame:
    """The ``kept`` strongest of a neuron's candidates, ranked in one round: a neuron has at most ``kept`` per side.

    Where neurons repeat, Spark's group limit trims each task's candidates to ``kept`` per neuron before the shuffle.
    """
    strength = F.when(F.col("sign") == "positive", -F.col("weight")).otherwise(F.col("weight"))
    strongest = Window.partitionBy(*NEURON, "direction", "sign").orderBy(strength, "to_layer", "to_neuron")
    return candidates.withColumn("rank", F.row_number().over(strongest)).where(F.col("rank") <= kept)


DIRECTIONS = ("output", "input")


def strongest_connections(
    outgoing: DataFrame,
    incoming: DataFrame,
    gains: DataFrame | None = None,
    kept: int = KEPT,
    block: int = BLOCK,
    later_layers_only: bool = True,
    directions: tuple[str, ...] = DIRECTIONS,
    signs: tuple[str, ...] = SIGNS,
) -> DataFrame:
    """The ``kept`` most positive and most negative connections of every neuron, both ways.

    ``outgoing`` and ``incoming`` have the columns layer, neuron, vector.  With
    ``later_layers_only`` a source connects to targets of higher layers.  ``direction`` is
    'output' seen from the source and 'input' seen from the target; ``directions`` and ``signs``
    leave some of the lists out.
    """
    sources = outgoing.select(F.col("layer").cast("int"), F.col("neuron").cast("bigint"), F.col("vector").cast("array<double>"))
    targets = scaled(incoming, gains).select(F.col("layer").cast("int"), F.col("neuron").cast("bigint"), F.col("vector").cast("array<double>"))
    return _both_ways(sources, targets, ["vector"], kept, block, later_layers_only, directions, signs, _Dense)


def sparse_connections(
    outgoing: DataFrame, incoming: DataFrame, gains: DataFrame | None = None, kept: int = KEPT, later_layers_only: bool = True,
    directions: tuple[str, ...] = DIRECTIONS, block: int = BLOCK, signs: tuple[str, ...] = SIGNS,
) -> DataFrame:
    """The same lists for sparse vectors: tables layer, neuron, d, value with one row per non-zero component.

    The components of a neuron meet in one row; sides and parts are searched as in the dense form,
    blocks over the dimensions that both have.  Only neurons that share a dimension are connected.
    Repeated components are summed, missing values and keys left out.  ``gains`` has layer, d, gain; a
    dimension without gain counts nothing.
    """
    if gains is not None:
        incoming = join_sized(incoming, gains, ["layer", "d"]).withColumn("value", F.col("value") * F.col("gain"))

    def packed(rows: DataFrame) -> DataFrame:
        """One row per neuron, written once: it is read for its size and for each direction."""
        parts = rows.select(
            F.col("layer").cast("int"), F.col("neuron").cast("bigint"), F.col("d").cast("bigint"), F.col("value").cast("double")
        ).dropna()
        summed = parts.groupBy(*NEURON, "d").agg(F.sum("value").alias("value"))
        lists = summed.groupBy(*NEURON).agg(F.array_sort(F.collect_list(F.struct("d", "value"))).alias("c"))
        return cut_lineage(lists.select(*NEURON, F.col("c.d").alias("dims"), F.col("c.value").alias("values")))

    return _both_ways(packed(outgoing), packed(incoming), ["dims", "values"], kept, block, later_layers_only, directions, signs, _Sparse)


def token_connections(
    neurons: DataFrame, embedding: DataFrame, gains: DataFrame | None = None, kept: int = KEPT, block: int = BLOCK
) -> DataFrame:
    """The tokens with the largest and smallest weight for every neuron.

    ``embedding`` has token_id, token, vector.  Pass input vectors with their layer gains for
    input weights, output vectors with the final gain for output weights.
    """
    vocabulary = embedding.select(F.lit(0).alias("layer"), F.col("token_id").alias("neuron"), "vector")
    found = strongest_connections(scaled(neurons, gains), vocabulary, None, kept, block, False, ("output",))
    names = embedding.select(F.col("token_id").alias("to_neuron"), "token")
    return join_sized(found, names, ["to_neuron"]).select(
        *NEURON, "sign", "rank", "token", "weight"
    )
