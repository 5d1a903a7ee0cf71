"""Positions of rows and tokens in a corpus that is stored in order, without shuffling its texts.

Corpora are normally stored by ascending key, in one file or several.  An input partition then
consists of few runs of ascending keys (files and parts of files, in any order), and the runs
of all partitions do not overlap.  A narrow pass finds the key range and the totals of each run,
the totals are added up in key order, and a second pass numbers rows or cuts tokens where they
lie.  Only what crosses the end of a run, at most one window length of tokens per run, is put
together elsewhere.

The driver holds one small record per run.  A corpus that is not stored in order is recognised
by the first pass; callers then take the way through a tree of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators.scale import BROADCAST_BYTES
from axonframe.session import cut_lineage

#: Tokens of windows put out at once.
TOKENS = 1 << 18

CHANGED = "the partitions of the input changed between two passes: write it as a table first"

#: Runs in one input partition; with more the corpus does not count as stored in order.
MOST_RUNS = 1024

_LAYOUT = "part INT, run INT, first BIGINT, last BIGINT, rows BIGINT, marks ARRAY<BIGINT>"

#: Rows that a capped scan counts first.
FIRST_ROWS = 1024
_EDGES = f"{_LAYOUT}, tokens BIGINT, head ARRAY<STRING>, tail ARRAY<STRING>"


class Run(NamedTuple):
    """A run of ascending keys: its partition and number there, first and last key, rows, and rows (or tokens) before it."""

    part: int
    run: int
    first: int
    last: int
    rows: int
    before: int
    marks: tuple[int, ...] = ()  # The keys of rows 1, 2, 4, 8, ...


def _split(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(key, block, ...) to (run number, part of a batch); a run ends with its block.

    The number is -1 once the partition is not in order; its rest is only read.
    """
    run, last = -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = batch.column(0), batch.column(1).to_numpy()
        values = None if keys.null_count else keys.to_numpy()
        edges = [] if values is None else [0, *(np.flatnonzero((values[1:] <= values[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(values)]
        if values is None or run + len(edges) > MOST_RUNS:
            yield -1, batch
            for _ in batches:
                pass
            return
        for a, b in pairwise(edges):
            if a or last is None or values[0] <= last[0] or blocks[0] != last[1]:
                run += 1
            yield run, batch.slice(a, b - a)
        last = int(values[-1]), int(blocks[-1])


def _known(found: dict[int, list[int]]) -> dict[str, pa.Array]:
    """Run number to [first, last, rows, marks], as columns."""
    part = TaskContext.get().partitionId()
    columns = {"part": [part] * len(found), "run": list(found), "first": [f[0] for f in found.values()], "last": [f[1] for f in found.values()]}
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return {
        **{k: pa.array(v, t) for (k, v), t in zip(columns.items(), types)},
        "rows": pa.array([f[2] for f in found.values()], pa.int64()), "marks": pa.array([f[3] for f in found.values()], pa.list_(pa.int64())),
    }


def _see(found: dict[int, list[int]], run: int, piece: pa.RecordBatch) -> None:
    if run < 0:
        found[run] = [None, None, 0, []]
        return
    keys = piece.column(0)
    own = found.setdefault(run, [keys[0].as_py(), None, 0, []])
    while 1 << len(own[3]) <= own[2] + len(keys):
        own[3].append(keys[(1 << len(own[3])) - 1 - own[2]].as_py())
    own[1], own[2] = keys[-1].as_py(), own[2] + len(keys)


def _ranges(batches):
    found: dict[int, list[int]] = {}
    for run, piece in _split(batches):
        _see(found, run, piece)
    yield pa.RecordBatch.from_pydict(_known(found))


def _runs(rows: Sequence, weight: str) -> list[Run] | None:
    """All runs in key order, or None if there are rows without order or runs overlap."""
    if any(r["run"] < 0 for r in rows):
        return None
    rows = sorted(rows, key=lambda r: r["first"])
    if any(a["last"] >= b["first"] for a, b in pairwise(rows)):
        return None
    before = [0, *accumulate(r[weight] for r in rows)]
    return [Run(*(r[c] for c in ("part", "run", "first", "last", "rows")), n, tuple(r["marks"])) for r, n in zip(rows, before)]


def key_of(order: str) -> Column:
    return F.col(order).cast("bigint")


def _places(docs: DataFrame, order: str) -> list[Column]:
    """The key, and a number for the stretch of a file that a row was read from (0 where there are several sources)."""
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    try:
        docs.select(block)
    except AnalysisException:  # Raised for plans of several sources.
        block = F.lit(0).cast("bigint")
    return [key_of(order).alias("key"), block.alias("block")]


def layout(docs: DataFrame, order: str) -> list[Run] | None:
    """The runs in key order with the rows before each, or None if the corpus is not stored in order.  Reads the keys only."""
    return _runs(docs.select(*_places(docs, order)).mapInArrow(_ranges, _LAYOUT).collect(), "rows")


def _table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of numbers of the driver's, broadcast if they are below the limit."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if 128 * len(rows) <= BROADCAST_BYTES else table


def _with_run(docs: DataFrame, runs: list[Run]) -> DataFrame:
    """Adds ``_run`` (start, first, last, rows, before; null if unknown) and ``_at``, the row's number in it."""
    by_part: dict[int, list[Run]] = {}
    for run in sorted(runs):
        by_part.setdefault(run.part, []).append(run)
    rows = []
    for part, own in by_part.items():
        starts = [0, *accumulate(r.rows for r in own)]
        rows.append((part, [(a, r.first, r.last, r.rows, r.before) for a, r in zip(starts, own)]))
    table = _table(docs.sparkSession, rows, "_part BIGINT, _runs ARRAY<STRUCT<start: BIGINT, first: BIGINT, last: BIGINT, rows: BIGINT, before: BIGINT>>")
    number = F.monotonically_increasing_id()
    placed = docs.withColumn("_at", number).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    own = F.element_at(F.filter("_runs", lambda r: r["start"] <= F.col("_at")), -1)
    found = placed.join(table, "_part", "left").withColumn("_run", own)
    return found.withColumn("_at", F.col("_at") - F.col("_run.start")).drop("_part", "_runs")


def with_row_numbers(docs: DataFrame, runs: list[Run], order: str, out: str) -> DataFrame:
    """Number the rows of an ordered input where they lie, from the rows before each run."""
    key, at = key_of(order), F.col("_at")
    wrong = (
        F.col("_run").isNull() | (at >= F.col("_run.rows"))
        | ((at == 0) & (key != F.col("_run.first"))) | ((at == F.col("_run.rows") - 1) & (key != F.col("_run.last")))
    )
    place = F.when(wrong, F.raise_error(F.lit(CHANGED)).cast("bigint")).otherwise(F.col("_run.before") + at)
    return _with_run(docs, runs).withColumn(out, place).drop("_at", "_run")


def covering(docs: DataFrame, runs: list[Run], order: str, start: int, end: int | None) -> tuple[DataFrame, list[Run]]:
    """Leave out whole runs that hold no row of [start, end): a range of keys that reaches the scan."""
    wanted = [r for r in runs if r.before + r.rows > start and (end is None or r.before < end)]
    if not wanted:
        return docs.where(F.lit(False)), []
    if wanted[0] is not runs[0]:
        docs = docs.where(F.col(order) >= wanted[0].first)
    if wanted[-1] is not runs[-1]:
        docs = docs.where(F.col(order) <= wanted[-1].last)
    return docs, wanted


def leading(docs: DataFrame, runs: list[Run], order: str, rows: int) -> tuple[DataFrame, list[Run]]:
    """At least the first ``rows`` rows, less than twice as many: a bound on the key that reaches the scan."""
    kept = []
    for run in runs:
        if run.before >= rows:
            break
        kept.append(run)
    if kept and kept[-1].before + kept[-1].rows > rows:
        number = (rows - kept[-1].before - 1).bit_length()
        if number < len(kept[-1].marks):
            kept[-1] = kept[-1]._replace(last=kept[-1].marks[number], rows=1 << number)
    if kept == runs:
        return docs, runs
    return docs.where(F.col(order) <= kept[-1].last), kept


class _Edges:
    """Total and outer tokens of one run, from rows of which only those near its ends bring tokens."""

    def __init__(self, edge: int):
        self.edge, self.total, self.n_head, self.open = edge, 0, 0, True
        self.heads: list[pa.Array] = []
        self.tails: list[pa.Array] = []

    def see(self, counts: np.ndarray, head: pa.Array, tail: pa.Array) -> None:
        self.total += int(counts.sum())
        sent = pc.list_value_length(tail).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(sent < counts)  # Rows of which not all tokens were sent.
        if self.open:
            # Up to the first row that is not whole, its own first tokens included, these are the stream itself.
            cut = int(whole[0]) + 1 if len(whole) else len(counts)
            self.heads.append(head.slice(0, cut).flatten().slice(0, self.edge - self.n_head))
            self.n_head += len(self.heads[-1])
            self.open = not len(whole) and self.n_head < self.edge
        # From the last row that is not whole on, these are the stream itself.
        if len(whole):
            self.tails = []
        self.tails.append(tail.slice(int(whole[-1]) if len(whole) else 0).flatten())
        if sum(map(len, self.tails)) > 4 * self.edge + 1024 or len(self.tails) > 64:
            self.tails = [self.tail()]

    def tail(self) -> pa.Array:
        joined = pa.concat_arrays(self.tails)
        return joined.slice(max(0, len(joined) - self.edge))


def _edge_tokens(length: int):
    """(key, block, n, first tokens, last tokens) to one row per run with its total and its outer tokens.

    Rows may leave out their tokens; where too many did, the run has fewer outer tokens than it should.
    """
    def run_all(batches):
        found: dict[int, list[int]] = {}
        edges: dict[int, tuple] = {}
        now = _Edges(length - 1)

        def close() -> None:
            if found:
                edges[list(found)[-1]] = (now.total, pa.concat_arrays(now.heads).to_pylist() if now.heads else [], now.tail().to_pylist() if now.tails else [])

        for run, piece in _split(batches):
            if run not in found:
                close()
                now = _Edges(length - 1)
            _see(found, run, piece)
            if run >= 0:
                now.see(piece.column(2).to_numpy(), piece.column(3), piece.column(4))
        close()
        types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
        own = {name: pa.array([e[i] for e in edges.values()], types[i]) for i, name in enumerate(("tokens", "head", "tail"))}
        yield pa.RecordBatch.from_pydict({**_known(found), **own})

    return run_all


def _inner_windows(length: int, step: int, cap: int | None, runs: list[Run]):
    """(key, block, tokens) to the windows that lie inside a run, cut from its stream of tokens."""
    at_once = max(1, TOKENS // length)
    names = {(r.part, r.run): r for r in runs}

    def run_all(batches):
        part, found, known = TaskContext.get().partitionId(), {}, None
        held = pa.array([], pa.string())
        begin = k = 0

        def check() -> None:
            if known is not None and tuple(found[known.run][:3]) != (known.first, known.last, known.rows):
                raise RuntimeError(CHANGED)

        for run, piece in _split(batches):
            if run not in found:
                check()
                known = names.get((part, run))
                if known is None or known.first != piece.column(0)[0].as_py():
                    raise RuntimeError(CHANGED)
                held, begin, k = held.slice(0, 0), known.before, -(-known.before // step)
            _see(found, run, piece)
            # ``held`` holds the stream from position ``begin``.
            held = pa.concat_arrays([held, piece.column(2).flatten()])
            last = (begin + len(held) - length) // step
            last = last if cap is None else min(last, cap - 1)
            while k <= last:
                some = np.arange(k, min(last, k + at_once - 1) + 1)
                places = (some[:, None] * step - begin + np.arange(length)[None, :]).ravel()
                offsets = np.arange(len(some) + 1, dtype=np.int32) * length
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(offsets), held.take(pa.array(places)))], ["seq_id", "tokens"])
                k += len(some)
            gone = min(max(0, k * step - begin), len(held))
            held, begin = held.slice(gone), begin + gone
        check()

    return run_all


def _pieces(edges: DataFrame, runs: list[Run], length: int, step: int, cap: int | None) -> DataFrame:
    """(seq_id, at, piece) of the windows that cross the end of a run, from the outer tokens of each."""
    table = _table(edges.sparkSession, [(r.part, r.run, r.before) for r in runs], "part INT, run INT, start BIGINT")
    placed = edges.join(table, ["part", "run"]).withColumn("stop", F.col("start") + F.col("tokens"))
    most = F.lit(cap - 1).cast("bigint") if cap else F.lit((1 << 62)).cast("bigint")

    def numbers(low: Column, high: Column) -> Column:
        high = F.least(high, most)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)"))

    # Begun earlier and not over: first tokens.  Begun here and not over at the end: last tokens.
    before = numbers(F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("start") - length) / step) + 1), F.ceil(F.col("start") / step) - 1)
    after = numbers(
        F.greatest(F.ceil(F.col("start") / step), F.floor((F.col("stop") - length) / step) + 1), F.ceil(F.col("stop") / step) - 1
    )
    begun = F.transform(before, lambda k: F.struct(
        k.alias("seq_id"), F.col("start").alias("at"),
        F.slice("head", F.lit(1), (F.least(k * step + length, F.col("stop")) - F.col("start")).cast("int")).alias("piece")))
    open_ = F.transform(after, lambda k: F.struct(
        k.alias("seq_id"), (k * step).alias("at"),
        F.slice("tail", (F.size("tail") - (F.col("stop") - k * step) + 1).cast("int"), (F.col("stop") - k * step).cast("int")).alias("piece")))
    return placed.select(F.inline(F.concat(begun, open_))).where(F.size("piece") > 0)


def ordered_windows(
    texts: DataFrame, order: str, tokens: Callable[[], Column], length: int, step: int, cap: int | None
) -> DataFrame | None:
    """Windows over the tokens of a corpus, or None if it is not stored in order.

    ``tokens`` gives a row's tokens, none for a row that is left out.  With a cap, leading
    rows are counted, more and more, until they hold enough tokens, and the others are left out of
    the scan.
    """
    keys = layout(texts, order)
    if keys is None:
        return None
    places, edge = _places(texts, order), length - 1
    none = F.expr("cast(array() as array<string>)")

    def edges(rows: DataFrame, known: list[Run], margin: int) -> DataFrame:
        """Outer tokens are sent by the rows near the ends of a run."""
        own = _with_run(rows, known).select(*places, tokens().alias("t"), ((F.col("_at") < margin) | (F.col("_run.rows") - F.col("_at") <= margin)).alias("near"))
        first, last = none, none
        if edge:
            first = F.when(F.col("near"), F.slice("t", 1, edge)).otherwise(none)
            last = F.when(~F.col("near"), none).when(F.size("t") > edge, F.slice("t", -edge, edge)).otherwise(F.col("t"))
        narrow = own.select("key", "block", F.size("t").cast("bigint").alias("n"), first.alias("head"), last.alias("tail"))
        return cut_lineage(narrow.mapInArrow(_edge_tokens(length), _EDGES))

    def counted(rows: DataFrame, known: list[Run]) -> tuple[DataFrame, list]:
        margin, most = edge + 16, max((r.rows for r in known), default=0)
        while True:
            written = edges(rows, known, margin)
            short = F.least(F.size("head"), F.size("tail")) < F.least(F.lit(edge), F.col("tokens"))
            found = written.select("part", "run", "first", "last", "rows", "marks", "tokens", short.alias("short")).collect()
            if margin >= most or not any(r["short"] for r in found):
                return written, found
            margin *= 16  # Blank texts at an end.

    total = sum(r.rows for r in keys)
    take = total if cap is None else FIRST_ROWS
    while True:
        read, known = leading(texts, keys, order, take)
        written, found = counted(read, known)
        tokens_read, need = sum(r["tokens"] for r in found), 0 if cap is None else (cap - 1) * step + length
        if take >= total or cap is not None and tokens_read >= need:
            break
        # About as many rows as the tokens so far let expect, and some more.
        take = max(2 * take, int(1.25 * take * need / max(tokens_read, 1))) if tokens_read else 16 * take
    texts = read
    runs = _runs(found, "tokens")
    if runs is None:
        raise RuntimeError(CHANGED)
    own = texts.select(*places, tokens().alias("t"))
    inner = own.mapInArrow(_inner_windows(length, step, cap, runs), "seq_id BIGINT, tokens ARRAY<STRING>")
    crossing = (
        _pieces(written, runs, length, step, cap).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
        .select("seq_id", F.flatten("parts.piece").alias("tokens")).where(F.size("tokens") == length)
    )
    return inner.unionByName(crossing)
