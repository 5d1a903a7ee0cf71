"""Fit and apply maps from simulated levels to real activations, one per explanation.

A calibrator is a pair: ``fit`` turns paired calibration records into a parameter table with
one row per explanation, ``apply`` gives an expression that maps one simulated value.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.arrays import count_below, let
from axonframe.operators import scale
from axonframe.operators.scale import BROADCAST_BYTES, TREE_FANOUT, fits, join_sized, ranked_counts, with_piece
from axonframe.operators.scoring import EXPLANATION, paired_values
from axonframe.schemas import NEURON_SCALE, check_choice
from axonframe.session import cut_lineage


class Calibrator(NamedTuple):
    fit: Callable[[DataFrame], DataFrame] | None
    apply: Callable[[Column], Column]


def fit_linear(paired: DataFrame) -> DataFrame:
    """Least squares of real on simulated; a constant simulation maps to the mean."""
    values = paired_values(paired)
    slope = F.when(F.max("p") > F.min("p"), F.regr_slope("r", "p")).otherwise(0.0)
    return values.groupBy(*EXPLANATION).agg(
        slope.alias("slope"),
        F.when(F.max("p") > F.min("p"), F.regr_intercept("r", "p")).otherwise(F.avg("r")).alias("intercept"),
    )


def apply_linear(value: Column) -> Column:
    return F.col("slope") * value + F.col("intercept")


CALIBRATORS = {
    "none": Calibrator(None, lambda value: value),
    "linear": Calibrator(fit_linear, apply_linear),
}
METHODS = (*CALIBRATORS, "percentile")


def _required(fitted: Column, mapped: Column) -> Column:
    """``mapped`` where calibration records exist; otherwise the job fails."""
    names = F.concat_ws(" ", *[F.col(c).cast("string") for c in EXPLANATION])
    return F.when(fitted, mapped).otherwise(F.raise_error(F.concat(F.lit("no calibration records for explanation "), names)))


def calibrate(sims: DataFrame, calibration: DataFrame | None, method: str | Calibrator = "linear") -> DataFrame:
    """Map ``expected`` and every distribution value to neuron units.

    ``calibration`` holds paired calibration records.  The parameters are one row per
    explanation and are joined after a size check.  The unit tag changes even when nothing
    is fitted; probabilities stay as they are; the input is kept as ``uncalibrated``.  An
    explanation without calibration records fails, whatever the method.
    """
    if method == "percentile":
        if calibration is None:
            raise ValueError("this calibrator has to be fitted on calibration records")
        return calibrate_percentiles(sims, calibration)
    if isinstance(method, str):
        check_choice("method", method, METHODS)
    chosen = CALIBRATORS[method] if isinstance(method, str) else method
    with_parameters = sims
    extra: list[str] = []
    fitted = F.lit(True)
    if chosen.fit is not None:
        if calibration is None:
            raise ValueError("this calibrator has to be fitted on calibration records")
        parameters = chosen.fit(calibration).withColumn("_fitted", F.lit(True))
        extra = [c for c in parameters.columns if c not in EXPLANATION]
        with_parameters = join_sized(sims, parameters, EXPLANATION, how="left")
        fitted = F.coalesce("_fitted", F.lit(False))
    out = with_parameters.withColumn("uncalibrated", F.col("expected")).withColumn(
        "expected", _required(fitted, F.transform("expected", chosen.apply))
    )
    if "dist_values" in sims.columns:
        out = out.withColumn("dist_values", F.transform("dist_values", lambda d: F.transform(d, chosen.apply)))
    return out.drop(*extra).withColumn("scale", F.lit(NEURON_SCALE))


SIDE = [*EXPLANATION, "side"]


def _ranked_values(values: DataFrame) -> DataFrame:
    """Distinct values per (explanation, side) with the positions [first, last] they take when sorted.

    Duplicates are counted before the shuffle.
    """
    both = [F.struct(F.lit(side).alias("side"), F.col(column).alias("v")) for side, column in (("x", "p"), ("y", "r"))]
    sides = values.select(*EXPLANATION, F.inline(F.array(*both)))
    counts = cut_lineage(sides.where(F.col("v").isNotNull()).groupBy(*SIDE, "v").agg(F.count("*").alias("n")))
    return ranked_counts(counts, SIDE, "v")


def _value_at(sorted_values: DataFrame, positions: DataFrame, at: str, out: str) -> DataFrame:
    """Look up the value at a sorted position.

    A value that covers many positions appears once, at its first one.  Blocks hold the values
    that begin in them; a block also knows the last value that began before it.  So a position
    meets at most the values of its own block, however often one value occurs.
    """
    block = lambda c: F.expr(f"`{c}` div {TREE_FANOUT}")
    begun = sorted_values.select(*EXPLANATION, F.col("v").alias(out), F.col("first").alias("_from"), F.col("last").alias("_to"), block("first").alias("_block"))
    # A value that covers whole blocks after its own: one row per run of blocks, met by the blocks that are asked for.
    asked = positions.select(*EXPLANATION, block(at).alias("_block")).distinct()
    marks = begun.groupBy(*EXPLANATION, "_block").agg(F.max_by(F.struct(out, "_from", "_to"), "_from").alias("_mark"))
    before = Window.partitionBy(*EXPLANATION).orderBy("_block", F.col("_mark").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast(marks.schema["_mark"].dataType)
    carried = marks.unionByName(asked.withColumn("_mark", none)).withColumn("_mark", F.when(F.col("_mark").isNull(), F.last("_mark", ignorenulls=True).over(before)))
    reached = asked.join(carried, [*EXPLANATION, "_block"]).where(f"_mark._to >= _block * {TREE_FANOUT} and _mark._from < _block * {TREE_FANOUT}").select(
        *EXPLANATION, "_block", F.col(f"_mark.{out}").alias(out), F.col("_mark._from").alias("_from"), F.col("_mark._to").alias("_to")
    )
    covering = begun.unionByName(reached.select(*begun.columns))
    return (
        positions.withColumn("_block", block(at)).join(covering, [*EXPLANATION, "_block"])
        .where(F.col(at).between(F.col("_from"), F.col("_to"))).drop("_block", "_from", "_to")
    )


def _fitted_in_place(ranked: DataFrame) -> DataFrame:
    """Knots of explanations whose distinct values fit an array."""
    def side(name: str, *columns: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct(*columns))))

    both = ranked.groupBy(*EXPLANATION).agg(side("y", "first", "v").alias("ys"), side("x", "v", "first", "last").alias("xs"))

    def at(position: Column) -> Column:
        return F.get("ys", count_below(F.col("ys"), position, lambda y: y["first"], inclusive=True) - 1)["v"]

    knots = F.transform("xs", lambda x: F.struct(x["v"].alias("x"), at(x["first"]).alias("y_first"), at(x["last"]).alias("y_last")))
    return both.select(*EXPLANATION, F.inline(knots))


def fit_percentiles(paired: DataFrame) -> DataFrame:
    """Pair the sorted simulated values with the sorted real values.

    One row per distinct simulated value ``x``: the real values at its first and at its last
    sorted position.  Where no explanation has more than ``PIECE_ROWS`` distinct values, its
    values become sorted arrays and each position is found by halving; otherwise positions
    are joined in blocks.
    """
    ranked = cut_lineage(_ranked_values(paired_values(paired)))
    most = ranked.groupBy(*EXPLANATION).agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0
    if most <= scale.PIECE_ROWS:
        return _fitted_in_place(ranked)
    ys = ranked.where(F.col("side") == "y").drop("side")
    knots = ranked.where(F.col("side") == "x").select(*EXPLANATION, F.col("v").alias("x"), "first", "last")
    return _value_at(ys, _value_at(ys, knots, "first", "y_first"), "last", "y_last").select(
        *EXPLANATION, "x", "y_first", "y_last"
    )


def apply_percentiles(values: DataFrame, knots: DataFrame, value: str = "value", out: str = "calibrated") -> DataFrame:
    """Interpolate each value between its neighbouring knots (an as-of join in both directions).

    Values outside the knots take the end values; a value equal to a knot takes the real value
    at the knot's last position.  Each distinct value is looked up once per explanation.  A
    sorted pass per (explanation, piece) finds the neighbours; neighbours in other pieces come
    from a table with one row per piece.
    """
    wanted = values.select(*EXPLANATION, F.col(value).alias("x")).distinct()
    none = F.lit(None).cast("double")
    knot = F.struct(F.col("x").alias("x"), F.col("y_first").alias("y_first"), F.col("y_last").alias("y_last"))
    both = knots.select(*EXPLANATION, "x", knot.alias("knot")).unionByName(
        wanted.select(
            *EXPLANATION,
            "x",
            F.when(F.lit(False), F.struct(none.alias("x"), none.alias("y_first"), none.alias("y_last"))).alias("knot"),
        )
    )
    pieces = cut_lineage(with_piece(both, knots, EXPLANATION, "x"))
    ends = pieces.where(F.col("knot").isNotNull()).groupBy(*EXPLANATION, "piece").agg(
        F.min_by("knot", "x").alias("low_end"), F.max_by("knot", "x").alias("high_end")
    )
    present = pieces.select(*EXPLANATION, "piece").distinct()
    ahead = Window.partitionBy(*EXPLANATION).orderBy("piece")
    around = present.join(ends, [*EXPLANATION, "piece"], "left").select(
        *EXPLANATION,
        "piece",
        F.last("high_end", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("under"),
        F.first("low_end", ignorenulls=True).over(ahead.rowsBetween(1, Window.unboundedFollowing)).alias("over"),
    )
    # Knots sort before values of the same x, so a value sees its own knot below it.
    inside = Window.partitionBy(*EXPLANATION, "piece").orderBy(F.col("x"), F.col("knot").isNull())
    located = (
        pieces.withColumn("_under", F.last("knot", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_over", F.first("knot", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)))
        .where(F.col("knot").isNull())
        .join(around, [*EXPLANATION, "piece"])
        .select(
            *EXPLANATION,
            "x",
            F.coalesce("_under", "under").alias("u"),
            F.coalesce("_over", "over").alias("o"),
        )
    )
    slope = F.try_divide(F.col("o.y_first") - F.col("u.y_last"), F.col("o.x") - F.col("u.x"))
    mapped = located.select(
        *EXPLANATION,
        F.col("x").alias(value),
        F.when(F.col("u").isNull(), F.col("o.y_first"))
        .when(F.col("o").isNull() | (F.col("u.x") == F.col("x")), F.col("u.y_last"))
        .otherwise(F.col("u.y_last") + slope * (F.col("x") - F.col("u.x")))
        .alias(out),
    )
    return values.join(mapped, [*EXPLANATION, value], "left")


def interpolated(knots: Column, value: Column) -> Column:
    """One value between sorted knots (x, y_first, y_last), clamped at both ends; found by halving."""

    def place(below: Column) -> Column:
        u, o = F.get(knots, below - 1), F.get(knots, below)
        slope = F.try_divide(o["y_first"] - u["y_last"], o["x"] - u["x"])
        return (
            F.when(below == 0, o["y_first"])
            .when((below == F.size(knots)) | (u["x"] == value), u["y_last"])
            .otherwise(u["y_last"] + slope * (value - u["x"]))
        )

    return let(count_below(knots, value, lambda k: k["x"], inclusive=True), place)


def calibrate_percentiles(sims: DataFrame, calibration: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Percentile matching applied to ``expected`` and, if present, to every distribution value.

    Calibration splits are small, so their knots normally fit: they become one array per
    explanation, are broadcast, and arrays are mapped in place.  Larger knot tables are
    matched by a distributed as-of join; then each sequence gets a map from its own distinct
    values to calibrated ones.  Empty arrays stay empty.  An explanation without calibration
    records fails, whichever way is taken.
    """
    has_distribution = "dist_values" in sims.columns
    knots = cut_lineage(fit_percentiles(calibration))
    if fits(knots, limit):
        lists = knots.groupBy(*EXPLANATION).agg(
            F.array_sort(F.collect_list(F.struct("x", "y_first", "y_last"))).alias("_fit")
        )
        joined = sims.join(F.broadcast(lists), EXPLANATION, "left").withColumn("_fitted", F.col("_fit").isNotNull())
        mapped = lambda x: interpolated(F.col("_fit"), x)
    else:
        present = F.concat("expected", F.flatten("dist_values")) if has_distribution else F.col("expected")
        values = sims.select(*EXPLANATION, "seq_id", F.explode(F.array_distinct(present)).alias("value"))
        lookup = (
            apply_percentiles(values, knots)
            .groupBy(*EXPLANATION, "seq_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("value", "calibrated"))).alias("_fit"))
        )
        present = knots.select(*EXPLANATION, F.lit(True).alias("_fitted")).distinct()
        joined = sims.join(lookup, [*EXPLANATION, "seq_id"], "left").join(present, EXPLANATION, "left").withColumn("_fitted", F.coalesce("_fitted", F.lit(False)))
        mapped = lambda x: F.element_at("_fit", x)
    out = joined.withColumn("uncalibrated", F.col("expected")).withColumn("expected", _required(F.col("_fitted"), F.transform("expected", mapped)))
    if has_distribution:
        out = out.withColumn("dist_values", F.transform("dist_values", lambda d: F.transform(d, mapped)))
    return out.drop("_fit", "_fitted").withColumn("scale", F.lit(NEURON_SCALE))
