"""Texts to fixed token windows, row ranges and shards.

Order comes from an integer column (``doc_id`` by default) that follows the corpus order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.text import is_blank, strip
from axonframe.operators.ordered import covering, layout, ordered_windows, with_row_numbers
from axonframe.operators.scale import TREE_FANOUT, prefix_sum

Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Default tokeniser: runs of characters other than space, newline and tab."""
    return F.filter(F.split(text, "[ \n\t]+"), lambda t: t != "")


def usable_texts(docs: DataFrame, text: str = "text", stripped: bool = False) -> DataFrame:
    """Drop missing and blank texts; strip the others only on request."""
    kept = docs.where(F.col(text).isNotNull() & ~is_blank(F.col(text)))
    return kept.withColumn(text, strip(F.col(text))) if stripped else kept


def check_window(length: int, stride: int | None, context: int | None = None) -> int:
    if length <= 0:
        raise ValueError(f"sequence length must be positive, got {length}")
    if context is not None and length > context:
        raise ValueError(f"sequence length {length} exceeds the context of {context} tokens")
    if stride is not None and stride < 0:
        raise ValueError(f"stride must not be negative, got {stride}")
    return stride or length


def token_windows(
    docs: DataFrame,
    length: int,
    stride: int | None = None,
    max_sequences: int | None = None,
    tokenizer: Tokenizer = words,
    order: str = "doc_id",
    text: str = "text",
    context: int | None = None,
) -> DataFrame:
    """Windows of ``length`` tokens over the concatenation of all texts, in corpus order.

    Window k covers the stream positions [k * stride, k * stride + length); an incomplete
    last window is dropped.  If the corpus is stored in order, its windows are cut
    where the texts lie, and a cap leaves out what is behind it (``ordered_windows``).
    Otherwise each document finds its own start position from a tree of token
    totals and cuts its share of every window it touches.  Windows that lie inside one
    document are complete at once; only the pieces at document ends are shuffled, at most
    ``length`` tokens per window.
    """
    step = check_window(length, stride, context)
    capped = max_sequences is not None and max_sequences > 0

    def own_tokens() -> Column:
        found = tokenizer(F.col(text))
        return F.when(F.col(text).isNotNull() & ~is_blank(F.col(text)), found).otherwise(F.expr("cast(array() as array<string>)"))

    in_place = ordered_windows(docs, order, own_tokens, length, step, max_sequences if capped else None)
    if in_place is not None:
        return in_place
    # Texts travel once, as text, to the bucket their position is computed in; counting and
    # cutting both start from that exchange.
    bucket = F.expr(f"_order div {TREE_FANOUT}")
    key = F.col(order).cast("bigint")
    low, high = docs.agg(F.min(key), F.max(key)).first()
    null = F.raise_error(F.lit(f"{order} must not be null")).cast("bigint")
    place = F.when(key.isNull(), null).otherwise(key - (low or 0))
    tokens = (
        usable_texts(docs, text)
        .select(place.alias("_order"), F.col(text).alias("_text"))
        .repartition(bucket)
        .withColumn("_tokens", tokenizer(F.col("_text")))
        .select("_order", "_tokens", F.size("_tokens").alias("_n"))
    )
    placed = prefix_sum(tokens, "_order", "_n", "_start", limits=(0, (high or 0) - (low or 0)))
    if capped:
        placed = placed.where(F.col("_start") < (max_sequences - 1) * step + length)

    end = F.col("_start") + F.col("_n")
    first = F.greatest(F.lit(0), F.ceil((F.col("_start") - length + 1) / step)).cast("bigint")
    last = F.expr(f"(_start + _n - 1) div {step}")
    if capped:
        last = F.least(last, F.lit(max_sequences - 1))

    def cut(k: Column) -> Column:
        begin = F.greatest(k * step, F.col("_start"))
        stop = F.least(k * step + length, end)
        piece = F.slice("_tokens", (begin - F.col("_start") + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))
        return F.struct(k.alias("seq_id"), begin.alias("at"), piece.alias("piece"))

    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    pieces = placed.select(F.inline(F.transform(numbers, cut))).where(F.size("piece") > 0)
    whole = pieces.where(F.size("piece") == length).select("seq_id", F.col("piece").alias("tokens"))
    joined = (
        pieces.where(F.size("piece") < length)
        .groupBy("seq_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
        .select("seq_id", F.flatten("parts.piece").alias("tokens"))
        .where(F.size("tokens") == length)
    )
    return whole.unionByName(joined)


def with_row_index(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Dense row number from 0 in the corpus order, without a global sort.

    Rows of a corpus that is stored in order are numbered where they lie.
    """
    runs = layout(docs, order)
    if runs is not None:
        return with_row_numbers(docs, runs, order, "row_index")
    numbered = docs.withColumn("_one", F.lit(1))
    return prefix_sum(numbered, order, "_one", "row_index").drop("_one")


class RowRange(NamedTuple):
    name: str
    start: int
    end: int | None


def parse_range(spec: str, total: int | None = None) -> RowRange | None:
    """Read "name[start:end]"; None for plain names.

    Percent ranges become row counts of a corpus of ``total`` rows, rounded to the nearest row.
    """
    match = re.fullmatch(r"([^\[]*)\[([^:\]]*):?([^\]]*)\]", spec)
    if match is None:
        return None
    name, start, end = (part.strip() for part in match.groups())
    percent = [part.endswith("%") for part in (start, end) if part]
    if any(percent):
        if not all(percent):
            raise ValueError(f"a range must not mix percent and counts: {spec}")
        if total is None:
            return None
        start, end = (str(round(float(part[:-1]) * total / 100)) if part else "" for part in (start, end))
    return RowRange(name, int(float(start)) if start else 0, int(float(end)) if end else None)


def spec_slice(docs: DataFrame, spec: str, order: str = "doc_id") -> DataFrame:
    """The rows that "name[start:end]" stands for, in counts or percent; all rows for a plain name."""
    wanted = parse_range(spec, docs.count() if "%" in spec else None)
    return with_row_index(docs, order) if wanted is None else row_slice(docs, wanted.start, wanted.end, order)


def row_slice(docs: DataFrame, start: int = 0, end: int | None = None, order: str = "doc_id") -> DataFrame:
    """Rows [start, end) of the corpus order; both ends are clamped, an empty range is empty."""
    if docs.isStreaming:
        raise ValueError("row ranges need a bounded corpus; this one is a stream")
    runs = layout(docs, order)
    if runs is None:
        indexed = with_row_index(docs, order)
    else:  # Runs outside the range are not read.
        indexed = with_row_numbers(*covering(docs, runs, order, max(start, 0), end), order, "row_index")
    inside = F.col("row_index") >= max(start, 0)
    if end is not None:
        inside = inside & (F.col("row_index") < max(end, 0))
    return indexed.where(inside)


def shard_ranges(total: int, shards: int, start: int = 0) -> list[tuple[int, int]]:
    """Equal row ranges; the remainder goes to the first shards."""
    if shards <= 0 or total < shards:
        raise ValueError(f"cannot cut {total} rows into {shards} shards")
    base, extra = divmod(total, shards)
    ends = [start + (i + 1) * base + min(i + 1, extra) for i in range(shards)]
    return list(zip([start, *ends[:-1]], ends))


def percent_ranges(shards: int, low: float = 0.0, high: float = 100.0) -> list[tuple[float, float]]:
    """Equal percent ranges."""
    width = (high - low) / shards
    return [(low + i * width, min(low + (i + 1) * width, high)) for i in range(shards)]


def with_shard(docs: DataFrame, shards: int, order: str = "doc_id") -> DataFrame:
    """Add ``shard_id`` so that shards are consecutive row ranges of equal size."""
    runs = layout(docs, order)
    indexed = with_row_index(docs, order) if runs is None else with_row_numbers(docs, runs, order, "row_index")
    total = docs.count() if runs is None else sum(r.rows for r in runs)
    base, extra = divmod(total, shards)
    if base == 0:
        raise ValueError(f"cannot cut {total} rows into {shards} shards")
    wide = extra * (base + 1)
    row = F.col("row_index")
    shard = F.when(row < wide, F.expr(f"row_index div {base + 1}")).otherwise(F.expr(f"{extra} + (row_index - {wide}) div {base}"))
    return indexed.withColumn("shard_id", shard.cast("int"))


def chain_splits(parts: Sequence[DataFrame], order: str = "row_no") -> DataFrame:
    """Texts of several splits in list order: keys (split_no, row_no)."""
    chained = None
    for number, part in enumerate(parts):
        tagged = part.withColumn("split_no", F.lit(number))
        chained = tagged if chained is None else chained.unionByName(tagged)
    if chained is None:
        raise ValueError("at least one split is needed")
    return chained


def with_corpus_order(chained: DataFrame, split: str = "split_no", row: str = "row_no", out: str = "corpus_no") -> DataFrame:
    """One integer key for the order (split, row): the rows of later splits follow those of earlier ones.

    Only one row per split is gathered.  Negative row numbers keep their place.
    """
    sizes = chained.groupBy(split).agg(F.min(row).alias("_low"), (F.max(row) - F.min(row) + 1).alias("_rows"))
    before = Window.orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(split, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_offset"))
    return chained.join(F.broadcast(offsets), split).withColumn(out, F.col(row) + F.col("_offset")).drop("_offset")
