"""Plan shapes that keep every task bounded, whatever the distribution of the keys.

Each helper works in rounds: trim or pre-aggregate inside small groups first, then combine
the few rows that are left per key.  A key that owns a third of the input is spread over
many tasks in the first round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.functions.arrays import count_below
from axonframe.session import cut_lineage

#: A side of a join is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024

#: First-round groups per key when ranking.
RANK_SALTS = 32

#: Rows per bucket in the prefix-sum tree.
TREE_FANOUT = 512


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str = "rank",
    salts: int = RANK_SALTS,
) -> DataFrame:
    """The first ``n`` rows of every key in a total order, with their rank from 1.

    Round one ranks inside (key, input partition modulo ``salts``).  Spark's group limit
    trims each map partition to ``n`` rows per key before the shuffle, and a hot key is
    ranked by ``salts`` tasks.  Round two ranks at most ``salts * n`` rows per key.  The
    result does not depend on how rows were partitioned.
    """
    if n < 0:
        raise ValueError(f"n must not be negative, got {n}")
    salted = df.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    short = (
        salted.withColumn(rank_col, F.row_number().over(first))
        .where(F.col(rank_col) <= n)
        .drop(rank_col, "_salt")
    )
    return short.withColumn(rank_col, F.row_number().over(final)).where(F.col(rank_col) <= n)


def fits(df: DataFrame, limit: int) -> bool:
    """Whether a written table stays below ``limit`` bytes in memory.

    Rows of numbers have a known width, so the row count from the file footers decides.
    Otherwise rows are counted as JSON text plus 64 bytes.
    """
    widths = [8 if isinstance(f.dataType, T.NumericType | T.BooleanType) else None for f in df.schema.fields]
    if None not in widths:
        return df.count() * (64 + sum(widths)) <= limit
    text = F.octet_length(F.to_json(F.struct("*"))) + 64
    return (df.agg(F.sum(text).alias("size")).first()["size"] or 0) <= limit


def join_sized(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    written: bool = False,
) -> DataFrame:
    """Join that broadcasts ``small`` only after measuring it.

    ``small`` is written to the shared folder first (unless it is ``written`` already), so the
    measurement and the join read the same rows and neither recomputes them.  Above the limit the join is shuffled on ``on`` and
    adaptive execution splits skewed partitions of ``big``.
    """
    stored = small if written else cut_lineage(small)
    if fits(stored, limit):
        stored = F.broadcast(stored)
    return big.join(stored, on=list(on), how=how)


def prefix_sum(
    df: DataFrame,
    key: str,
    weight: str,
    out: str = "start",
    fanout: int = TREE_FANOUT,
    limits: tuple[int | None, int | None] | None = None,
) -> DataFrame:
    """Exclusive running total of ``weight`` over the global order of an integer ``key``.

    A tree of bucket totals replaces the single-task window: level i groups keys by
    ``key div fanout^i``, so no window partition ever holds more than ``fanout`` rows.  Keys may
    be negative.  A NULL or repeated key fails, as its place would be arbitrary.  Input rows are
    shuffled once, by their lowest bucket.  ``limits`` spares a scan if the smallest and the
    largest key are known.
    """
    min_key, max_key = limits or df.agg(F.min(key), F.max(key)).first()
    if max_key is None:
        min_key = max_key = 0
    null = F.raise_error(F.lit(f"{key} must not be null")).cast("bigint")
    shifted = F.when(F.col(key).isNull(), null).otherwise(F.col(key) - min(0, min_key))
    levels = 1
    while max_key - min(0, min_key) >= fanout**levels:
        levels += 1

    def level(rows: DataFrame, row_key: str, row_weight: str, out_col: str, depth: int) -> DataFrame:
        """Offsets for rows whose keys are below ``fanout ** depth``."""
        bucket, total, offset = f"_bucket{depth}", f"_total{depth}", f"_offset{depth}"
        bucketed = rows.withColumn(bucket, F.expr(f"`{row_key}` div {fanout}"))
        ordered = Window.partitionBy(bucket).orderBy(row_key)
        inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
        running = F.coalesce(F.sum(row_weight).over(inside), F.lit(0)).cast("bigint")
        if depth == levels:
            again = F.lag(row_key).over(ordered) == F.col(row_key)
            message = F.concat(F.lit(f"{key} must be unique: "), F.col(row_key).cast("string"))
            running = F.when(again, F.raise_error(message).cast("bigint")).otherwise(running)
        if depth == 1:
            return bucketed.withColumn(out_col, running).drop(bucket)
        totals = bucketed.groupBy(bucket).agg(F.sum(row_weight).alias(total))
        offsets = level(totals, bucket, total, offset, depth - 1).select(bucket, offset)
        return (
            bucketed.withColumn(out_col, running)
            .join(offsets, bucket)
            .withColumn(out_col, F.col(out_col) + F.col(offset))
            .drop(bucket, offset)
        )

    if min_key >= 0 and limits:
        return level(df, key, weight, out, levels)
    return level(df.withColumn("_place", shifted), "_place", weight, out, levels).drop("_place")


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    chunk: int = TREE_FANOUT,
    depth: int = 3,
) -> DataFrame:
    """``lag(value)`` per key along an integer ``order``, without one window per key.

    Inside a chunk of ``chunk`` order values the lag is a small window.  The first row of a
    chunk takes the last value of the previous chunk, found on a table of one row per chunk,
    which is resolved the same way ``depth - 1`` more times.
    """
    if depth == 0:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    part, last, before, first = (f"_{name}{depth}" for name in ("chunk", "last", "before", "first"))
    chunked = df.withColumn(part, F.floor(F.col(order) / chunk))
    inside = Window.partitionBy(*keys, part).orderBy(order)
    lagged = chunked.withColumn(out, F.lag(value).over(inside)).withColumn(first, F.row_number().over(inside) == 1)
    ends = chunked.groupBy(*keys, part).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias(last))
    linked = previous_value(ends, keys, part, last, before, chunk, depth - 1).select(*keys, part, before)
    return (
        lagged.join(linked, [*keys, part], "left")
        .withColumn(out, F.when(F.col(first), F.col(f"{before}.v")).otherwise(F.col(out)))
        .drop(part, first, before)
    )


#: Distinct values that one sorted piece should hold, and those of them looked at for the cuts between pieces.
PIECE_ROWS = 100_000
PIECE_LOOKS = 16


def with_piece(rows: DataFrame, points: DataFrame, keys: Sequence[str], value: str, pieces: int = 64) -> DataFrame:
    """Number each value by the sketched cut points of ``points`` that lie below it.

    The cut points are one small row per key.
    """
    share = [i / pieces for i in range(1, pieces)]
    cuts = points.groupBy(*keys).agg(F.percentile_approx(value, share, 16 * pieces).alias("_cuts"))
    number = count_below(F.col("_cuts"), F.col(value))
    return join_sized(rows, cuts, keys).withColumn("piece", number).drop("_cuts")


def ranked_counts(counts: DataFrame, keys: Sequence[str], value: str, weight: str = "n") -> DataFrame:
    """Distinct values with the positions [first, last], from 0, that they take when sorted.

    ``counts``: a written table with one row per key and distinct value.  A key of up to
    ``PIECE_ROWS`` rows is sorted as it is.  A heavier one is cut into as many pieces as its own
    rows need, at values that a hash picks from it, so it is not sorted by one task; only heavy
    keys have cuts, about one per ``PIECE_ROWS`` of their rows.
    """
    heavy = cut_lineage(counts.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > PIECE_ROWS).select(*keys))
    if heavy.isEmpty():
        upto = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counts.select(*keys, value, weight, upto.alias("_upto")).select(
            *keys, value, (F.col("_upto") - F.col(weight)).alias("first"), (F.col("_upto") - 1).alias("last")
        )
    looked = F.pmod(F.xxhash64(value), F.lit(max(1, PIECE_ROWS // PIECE_LOOKS))) == 0
    seen = join_sized(counts.where(looked), heavy, keys, written=True).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_seen"))
    every = F.filter("_seen", lambda _, i: i % PIECE_LOOKS == PIECE_LOOKS - 1)
    cuts = seen.select(*keys, every.alias("_cuts"))
    piece = F.coalesce(count_below(F.col("_cuts"), F.col(value)), F.lit(0))
    pieces = join_sized(counts, cuts, keys, how="left").withColumn("piece", piece).drop("_cuts")
    totals = pieces.groupBy(*keys, "piece").agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "piece", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "piece").orderBy(value)
    upto = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        pieces.withColumn("_upto", upto)
        .join(offsets, [*keys, "piece"])
        .select(
            *keys,
            value,
            (F.col("_offset") + F.col("_upto") - F.col(weight)).alias("first"),
            (F.col("_offset") + F.col("_upto") - 1).alias("last"),
        )
    )


def exact_percentiles(
    df: DataFrame, value: str, probabilities: Sequence[float], bins: int = 4096, small: int = 1_000_000
) -> list[float]:
    """Exact interpolated percentiles of one numeric column of any size.

    Counts per equal-width bin find the bin that holds each wanted order statistic; that bin
    is split again until it holds at most ``small`` rows, and only those are ranked.  The
    driver sees bin counts and order statistics, never the rows.  The frame is scanned once
    per step: pass a written table if it is costly to compute.
    """
    stats = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    n = stats["n"]
    if n == 0:
        return [float("nan") for _ in probabilities]
    lower = [int(p * (n - 1)) for p in probabilities]
    wanted = sorted({rank for low in lower for rank in (low, min(low + 1, n - 1))})

    def pick(lo: float, hi: float, below: int, size: int, ranks: list[int]) -> dict[int, float]:
        """Values at ``ranks``, all of which lie in [lo, hi]; ``below`` rows lie under lo."""
        if lo == hi:
            return {rank: lo for rank in ranks}
        inside = df.where(F.col(value).between(lo, hi))
        width = (hi - lo) / bins
        if size <= small or lo + width == lo:
            upto = F.sum("count").over(Window.orderBy(value)) + F.lit(below)
            hit = reduce(
                lambda a, b: a | b,
                [(F.col("_upto") > rank) & (F.col("_upto") - F.col("count") <= rank) for rank in ranks],
            )
            rows = inside.groupBy(value).count().withColumn("_upto", upto).where(hit).collect()
            return {
                rank: row[value] for rank in ranks for row in rows
                if row["_upto"] - row["count"] <= rank < row["_upto"]
            }
        number = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / width))
        parts = (
            inside.groupBy(number.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
            .orderBy("bin")
            .collect()
        )
        found: dict[int, float] = {}
        for part in parts:
            mine = [rank for rank in ranks if below <= rank < below + part["n"]]
            if mine:
                found.update(pick(part["lo"], part["hi"], below, part["n"], mine))
            below += part["n"]
        return found

    at = pick(stats["lo"], stats["hi"], 0, n, wanted)
    return [
        at[low] + (at[min(low + 1, n - 1)] - at[low]) * (p * (n - 1) - low)
        for p, low in zip(probabilities, lower)
    ]
