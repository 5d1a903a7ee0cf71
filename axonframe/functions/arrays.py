"""Column expressions over activation arrays.  All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompts show activations as integers from 0 to this value.
TOP_LEVEL = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def record_score(activations: Column) -> Column:
    """Figure of merit of a record: its largest activation, -inf when it has none."""
    return F.coalesce(F.array_max(activations), F.lit(float("-inf")))


def relu_max(activations: Column) -> Column:
    """Aggregate: largest activation over all records, never below 0."""
    return F.greatest(F.lit(0.0), F.max(F.array_max(activations)))


def to_levels(activations: Column, top: Column) -> Column:
    """Integers 0..10 relative to ``top``; all 0 when ``top`` is not positive."""
    def level(x: Column) -> Column:
        return F.least(F.lit(TOP_LEVEL), F.floor(F.lit(float(TOP_LEVEL)) * relu(x) / top)).cast("int")

    zeros = F.transform(activations, lambda _: F.lit(0))
    return F.when(top <= 0, zeros).otherwise(F.transform(activations, level))


def nonzero_count(levels: Column) -> Column:
    return F.size(F.filter(levels, lambda x: x != 0))


def unit_scaled(activations: Column, top: Column, at_zero: float = 0.0) -> Column:
    """Raw activations divided by ``top``, unclamped; a fixed value when ``top`` is 0."""
    return F.transform(activations, lambda x: F.when(top == 0, F.lit(at_zero)).otherwise(F.try_divide(x, top)))


def head(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def upto(array: Column, position: Column) -> Column:
    """Items 0..position."""
    return F.slice(array, F.lit(1), position + 1)


def same_tokens(left: Column, right: Column) -> Column:
    """True when both token arrays agree position by position."""
    return F.forall(F.zip_with(left, right, lambda a, b: a.eqNullSafe(b)), lambda same: same)


def has_nan(activations: Column) -> Column:
    return F.exists(activations, F.isnan)


def count_below(items: Column, value: Column, key: Callable[[Column], Column] = lambda item: item, inclusive: bool = False) -> Column:
    """How many items of a sorted array have a key below ``value`` (or equal to it), found by halving.

    The cost is the logarithm of the array's size.
    """
    steps = F.sequence(F.floor(F.log2(F.greatest(F.size(items), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(found: Column, exponent: Column) -> Column:
        reach = found + F.call_function("shiftleft", F.lit(1), exponent)
        item = key(F.get(items, reach - 1))
        below = item <= value if inclusive else item < value
        return F.when((reach <= F.size(items)) & below, reach).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)
