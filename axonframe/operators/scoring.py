"""Score simulated against real activations, per sequence and pooled."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.arrays import same_tokens
from axonframe.functions.scores import NAN, SCORES, explained
from axonframe.operators.scale import BROADCAST_BYTES, fits, join_sized
from axonframe.schemas import NEURON
from axonframe.session import cut_lineage

EXPLANATION = [*NEURON, "explanation_id"]

ScoreFunctions = Mapping[str, Callable[[Column, Column], Column]]


def matching_sequences(acts: DataFrame, keys: DataFrame) -> DataFrame:
    """The activation rows whose (neuron, sequence) may occur in the written table ``keys``.

    Filtered where they are scanned, by what fits in memory: the keys themselves, else the range of
    sequences of each neuron.  If neither fits, all rows stay and the join that follows decides.
    """
    by = [*NEURON, "seq_id"]
    if fits(keys, BROADCAST_BYTES):
        return acts.join(F.broadcast(keys), by, "leftsemi")
    ranges = cut_lineage(keys.groupBy(*NEURON).agg(F.min("seq_id").alias("_from"), F.max("seq_id").alias("_to")))
    if not fits(ranges, BROADCAST_BYTES):
        return acts
    return acts.join(F.broadcast(ranges), NEURON).where(F.col("seq_id").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def pair_sequences(acts: DataFrame, sims: DataFrame, check_tokens: bool = True) -> DataFrame:
    """Match each simulated sequence with the real one.

    The simulations are written once and measured.  Small ones are broadcast, so the activations
    stay where they are.  Otherwise the activations are filtered in their scan by the simulated keys
    and only matching ones are exchanged, by (neuron, sequence), so a heavy neuron spreads over all
    tasks.  With ``check_tokens`` a differing token fails the job.
    """
    by = [*NEURON, "seq_id"]
    stored = cut_lineage(sims)
    real = acts.select(*by, F.col("tokens").alias("_tokens"), "activations")
    if fits(stored, BROADCAST_BYTES):
        paired = real.join(F.broadcast(stored), by)
    else:
        paired = stored.join(matching_sequences(real, cut_lineage(stored.select(*by).distinct())), by)
    if check_tokens:
        message = F.concat(F.lit("tokens differ in sequence "), F.col("seq_id").cast("string"))
        ok = same_tokens(F.col("tokens"), F.col("_tokens"))
        paired = paired.withColumn(
            "activations", F.when(ok, F.col("activations")).otherwise(F.raise_error(message))
        )
    rest = [c for c in sims.columns if c not in by]
    return paired.select(*by, *rest, "activations")


def paired_values(paired: DataFrame) -> DataFrame:
    """One row per value: real r and predicted p.  Stays inside the stage that pairs the rows."""
    pairs = F.arrays_zip(F.col("activations").alias("r"), F.col("expected").alias("p"))
    return paired.select(*EXPLANATION, "seq_id", F.explode_outer(pairs).alias("v")).select(
        *EXPLANATION, "seq_id", F.col("v.r").alias("r"), F.col("v.p").alias("p")
    )


def score_sequences(paired: DataFrame, scores: ScoreFunctions = SCORES) -> DataFrame:
    aggregates = [f(F.col("r"), F.col("p")).alias(name) for name, f in scores.items()]
    return paired_values(paired).groupBy(*EXPLANATION, "seq_id").agg(*aggregates)


ArrayScores = Mapping[str, Callable[[np.ndarray, np.ndarray], float]]


def score_arrays(paired: DataFrame, scores: ArrayScores) -> DataFrame:
    """Scores of each sequence by functions of numpy arrays (real, predicted), for scores that no aggregate expresses.

    A row's arrays are handed over as they are, in Arrow batches, in the stage that pairs them.  Values that
    are missing are NaN in the arrays; a row without arrays has no score.
    """
    def column(function: Callable[[np.ndarray, np.ndarray], float]) -> Column:
        @F.arrow_udf("double")
        def run(real: pa.Array, predicted: pa.Array) -> pa.Array:
            found = []
            for r, p in zip(real, predicted):
                both = [side.values for side in (r, p)]
                arrays = [None if v is None else v.to_numpy(zero_copy_only=False).astype(np.float64) for v in both]
                found.append(None if None in both else float(function(*arrays)))
            return pa.array(found, pa.float64())  # NaN stays NaN.

        return run("activations", "expected")

    return paired.select(*EXPLANATION, "seq_id", *[column(f).alias(name) for name, f in scores.items()])


def score_explanations(paired: DataFrame, scores: ScoreFunctions = SCORES) -> DataFrame:
    """Scores over the values of all sequences at once (not a mean of sequence scores).

    The values are pre-aggregated in the stage that pairs them, so a neuron with a third of
    the data still sends one row per task.
    """
    aggregates = [f(F.col("r"), F.col("p")).alias(name) for name, f in scores.items()]
    return paired_values(paired).groupBy(*EXPLANATION).agg(*aggregates)


def score_both(paired: DataFrame, scores: ScoreFunctions = SCORES) -> DataFrame:
    """Sequence scores and pooled scores together; pooled rows have a NULL seq_id.

    The built-in scores come from mergeable sums, so values are read once.  Other scores are
    evaluated on the values of both groupings.
    """
    if scores is SCORES:
        sums = cut_lineage(score_sums(paired))
        own = scores_of_sums(sums).withColumn("pooled", F.lit(False))
        pooled = scores_of_sums(merge_score_sums(sums)).withColumns({"seq_id": F.lit(None).cast("bigint"), "pooled": F.lit(True)})
        return own.unionByName(pooled)
    aggregates = [f(F.col("r"), F.col("p")).alias(name) for name, f in scores.items()]
    keys = [F.col(c) for c in EXPLANATION]
    return (
        paired_values(paired)
        .groupingSets([[*keys, F.col("seq_id")], keys], *keys, "seq_id")
        .agg(*aggregates, (F.grouping("seq_id") == 1).alias("pooled"))
    )


#: Parts of ``score_sums`` that are plain totals, and extremes by the aggregate that merges them.
_TOTALS = ("n", "square", "square_error", "size", "size_error")
_EXTREMES = {"r_min": F.min, "r_max": F.max, "p_min": F.min, "p_max": F.max}


def score_sums(paired: DataFrame) -> DataFrame:
    """One narrow row per sequence from which the built-in scores follow, alone or merged.

    Means with the sums of squares and products around them, totals of squares and sizes of values
    and errors, and extremes.  Only places with both values count.
    """
    r, p, n = F.col("r"), F.col("p"), F.count("r")
    both = paired_values(paired).select(
        *EXPLANATION, "seq_id", F.when(p.isNotNull(), r).alias("r"), F.when(r.isNotNull(), p).alias("p")
    )
    error = r - p
    return both.groupBy(*EXPLANATION, "seq_id").agg(
        n.alias("n"), F.avg(r).alias("r_mean"), F.avg(p).alias("p_mean"),
        (F.var_pop(r) * n).alias("rr"), (F.var_pop(p) * n).alias("pp"), (F.covar_pop(r, p) * n).alias("rp"),
        F.sum(r * r).alias("square"), F.sum(error * error).alias("square_error"),
        F.sum(F.abs(r)).alias("size"), F.sum(F.abs(error)).alias("size_error"),
        F.min(r).alias("r_min"), F.max(r).alias("r_max"), F.min(p).alias("p_min"), F.max(p).alias("p_max"),
    )


def merge_score_sums(sums: DataFrame, keys: Sequence[str] = EXPLANATION) -> DataFrame:
    """Combine the sums of several sequences, or of several runs, per key.

    The common means come first; deviations are then taken from them, so nothing cancels.  Both
    rounds pre-aggregate in the tasks that read ``sums`` (a written table), so a key that holds a
    third of the rows is not gathered anywhere.
    """
    n = F.col("n")
    share = lambda c: F.try_divide(F.sum(n * F.col(c)), F.sum(n))
    means = sums.groupBy(*keys).agg(share("r_mean").alias("_r"), share("p_mean").alias("_p"))
    centred = join_sized(sums, means, keys)
    r_gap, p_gap = F.col("r_mean") - F.col("_r"), F.col("p_mean") - F.col("_p")
    return centred.groupBy(*keys).agg(
        F.first("_r").alias("r_mean"), F.first("_p").alias("p_mean"),
        F.sum(F.col("rr") + n * r_gap * r_gap).alias("rr"),
        F.sum(F.col("pp") + n * p_gap * p_gap).alias("pp"),
        F.sum(F.col("rp") + n * r_gap * p_gap).alias("rp"),
        *[F.sum(c).alias(c) for c in _TOTALS], *[merge(c).alias(c) for c, merge in _EXTREMES.items()],
    )


def scores_of_sums(sums: DataFrame) -> DataFrame:
    """The built-in scores of rows of ``score_sums`` or ``merge_score_sums``."""
    n, nan = F.col("n"), F.lit(NAN)
    varies = (F.col("r_max") > F.col("r_min")) & (F.col("p_max") > F.col("p_min"))
    ratio = F.try_divide(F.col("rp"), F.sqrt("rr") * F.sqrt("pp"))
    correlation = F.when(n == 0, F.lit(None).cast("double")).when(varies, F.coalesce(ratio, nan)).otherwise(nan)
    mean = lambda c: F.try_divide(F.col(c), n)
    return sums.select(
        *[c for c in [*EXPLANATION, "seq_id"] if c in sums.columns],
        correlation.alias("ev_correlation_score"),
        explained(mean("square_error"), mean("square")).alias("rsquared_score"),
        explained(mean("size_error"), mean("size")).alias("absolute_dev_explained_score"),
    )


def best_explanations(scored: DataFrame, score: str = "ev_correlation_score") -> DataFrame:
    """The explanation with the highest score per neuron; undefined scores lose.

    Equal scores are settled by the lowest explanation_id.
    """
    defined = F.when(F.isnan(score), F.lit(None)).otherwise(F.col(score))
    order = F.struct(F.coalesce(defined, F.lit(float("-inf"))), -F.col("explanation_id"))
    return scored.groupBy(*NEURON).agg(
        F.max_by("explanation_id", order).alias("explanation_id"), F.max(defined).alias(score)
    )


def scored_simulations(paired: DataFrame, explanations: DataFrame) -> DataFrame:
    """Nest sequence scores below pooled scores, one row per (neuron, explanation).

    Only for export: ``paired`` holds an evaluation split, a few sequences per explanation.
    """
    sequences = score_sequences(paired).join(paired, [*EXPLANATION, "seq_id"])
    nested = sequences.groupBy(*EXPLANATION).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                "seq_id", "tokens", "expected", "activations", *SCORES,
            ))),
            lambda s: F.struct(
                F.struct(
                    s["tokens"].alias("tokens"),
                    s["expected"].alias("expected_activations"),
                ).alias("simulation"),
                s["activations"].alias("true_activations"),
                *[s[name].alias(name) for name in SCORES],
            ),
        ).alias("scored_sequence_simulations")
    )
    pooled = score_explanations(paired)
    return join_sized(nested.join(pooled, EXPLANATION), explanations, EXPLANATION, "left")


def run_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Absolute difference per value between two activation runs."""
    other = right.select(*NEURON, "seq_id", F.col("activations").alias("_other"))
    gaps = F.zip_with("activations", "_other", lambda a, b: F.abs(a - b))
    return left.join(other, [*NEURON, "seq_id"]).select(F.explode(gaps).alias("gap"))
