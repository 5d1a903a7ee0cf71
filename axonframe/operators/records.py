"""Per-neuron summaries of an activation table: top records, samples, quantiles, moments.

An activation table has the columns layer, neuron, seq_id, tokens, activations: one row per
(neuron, sequence).  Selections work on a narrow index (no arrays); the arrays of the few
selected records are fetched afterwards through one small row of bounds per neuron.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.arrays import has_nan, nonzero_count, record_score, relu_max, to_levels, unit_scaled
from axonframe.functions.draws import draw
from axonframe.operators.scale import BROADCAST_BYTES, fits, join_sized, ranked_counts, top_rows
from axonframe.schemas import NEURON
from axonframe.session import cut_lineage

TOP_K = 100
SAMPLE_SIZE = 50
SEED = 1234
QUANTILES = (0.5, 0.9, 0.99, 0.999)


def reject_nan(acts: DataFrame) -> DataFrame:
    """Fail the job on a NaN activation: ordering is undefined with NaN."""
    message = F.concat(F.lit("NaN activation in sequence "), F.col("seq_id").cast("string"))
    checked = F.when(has_nan(F.col("activations")), F.raise_error(message)).otherwise(F.col("activations"))
    return acts.withColumn("activations", checked)


def record_index(acts: DataFrame, seed: int = SEED) -> DataFrame:
    """Narrow row per record: its score, its size and its sampling order."""
    return acts.select(
        *NEURON,
        "seq_id",
        F.size("activations").alias("n_values"),
        record_score(F.col("activations")).alias("score"),
        draw(seed, *NEURON, "seq_id").alias("draw"),
    )


def heap_order(
    index: DataFrame, k: int, arrival: str = "seq_id", score: str = "score", keys: Sequence[str] = NEURON
) -> DataFrame:
    """The ``k`` records a bounded heap keeps when fed in arrival order, ranked.

    The heap takes a new record only on a strictly greater score and then evicts, among the
    smallest, the earliest.  So with t the k-th largest score: everything above t stays, and
    of the records equal to t that are among the first k arrivals at or above t, the latest.
    The 2k best by (score, earliest arrival) hold all of these: at most k - 1 lie above t.
    """
    best = [F.col(score).desc(), F.col(arrival).asc()]
    short = top_rows(index, keys, best, 2 * k, rank_col="_best")
    whole = Window.partitionBy(*keys)
    early = whole.orderBy(F.col(arrival).asc())
    late = whole.orderBy(F.col(score).desc(), F.col(arrival).desc())
    cut = short.withColumn("_t", F.min(F.when(F.col("_best") <= k, F.col(score))).over(whole))
    held = (
        cut.where(F.col(score) >= F.col("_t"))
        .withColumn("_early", F.row_number().over(early))
        .where((F.col(score) > F.col("_t")) | (F.col("_early") <= k))
        .withColumn("_late", F.row_number().over(late))
        .where(F.col("_late") <= k)
    )
    return held.withColumn("rank", F.row_number().over(whole.orderBy(*best))).drop("_best", "_t", "_early", "_late")


def top_picks(index: DataFrame, k: int = TOP_K) -> DataFrame:
    """Strongest records of each neuron; records without values never enter."""
    return heap_order(index.where(F.col("n_values") > 0), k).select(*NEURON, "seq_id", "score", "draw", "rank")


def sample_picks(index: DataFrame, n: int = SAMPLE_SIZE, keys: Sequence[str] = NEURON) -> DataFrame:
    """A uniform sample of ``n`` records per key: the smallest seeded hashes.

    Repeatable, mergeable across shards and batches, and independent between neurons.
    """
    return top_rows(index, keys, [F.col("draw"), F.col("seq_id")], n).select(
        *keys, "seq_id", "score", "draw", "rank"
    )


def quantile_boundaries(index: DataFrame, probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact score quantiles per neuron: the smallest score that at least that share of records does not exceed.

    Each boundary is a score that occurs.  Equal scores are counted before the shuffle, and a
    heavy neuron is sorted in pieces.  Records without a score are left out.
    """
    scored = index.where(F.col("score").isNotNull())
    counts = cut_lineage(scored.groupBy(*NEURON, "score").agg(F.count("*").alias("n")))
    ranked = ranked_counts(counts, NEURON, "score")
    totals = counts.groupBy(*NEURON).agg(F.sum("n").alias("_records"))

    def boundary(p: float) -> Column:
        # The number of records up to the boundary, at least one.
        place = F.greatest(F.lit(1), F.col("_records") - F.floor(F.col("_records") - F.lit(p) * F.col("_records")))
        return F.max(F.when((F.col("first") < place) & (place <= F.col("last") + 1), F.col("score")))

    return join_sized(ranked, totals, NEURON).groupBy(*NEURON).agg(
        F.array(*[boundary(float(p)) for p in probabilities]).alias("quantile_boundaries")
    )


def quantile_bucket(score: Column, boundaries: Column) -> Column:
    """0 for the lowest bucket; a score equal to a boundary belongs to the bucket above."""
    return F.size(F.filter(boundaries, lambda b: score >= b))


def bucketed(index: DataFrame, boundaries: DataFrame, written: bool = False) -> DataFrame:
    joined = join_sized(index, boundaries, NEURON, written=written)
    return joined.withColumn("bucket", quantile_bucket(F.col("score"), F.col("quantile_boundaries")))


def with_bounds(picks: DataFrame) -> DataFrame:
    """One row per neuron: the ranges of score, arrival and draw in which its picks lie."""
    top = F.col("kind") == "top"
    sampled = F.col("kind") == "random"
    inside = F.collect_list(
        F.when(F.col("kind") == "quantile", F.struct("low", "high", F.col("drawn").alias("drawn")))
    )
    per_list = picks.groupBy(*NEURON, "kind", "bucket").agg(
        F.min(F.struct("score", "seq_id")).alias("weakest"),
        F.max_by("seq_id", F.struct(-F.col("score"), F.col("seq_id"))).alias("last"),
        F.max("draw").alias("drawn"),
        F.first("low").alias("low"),
        F.first("high").alias("high"),
    )
    return per_list.groupBy(*NEURON).agg(
        F.max(F.when(top, F.col("weakest"))).alias("weakest"),
        F.max(F.when(top, F.col("last"))).alias("last"),
        F.max(F.when(sampled, F.col("drawn"))).alias("drawn"),
        inside.alias("buckets"),
    )


def fetch_records(acts: DataFrame, picks: DataFrame, seed: int = SEED, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Attach tokens and activations to picks (layer, neuron, kind, bucket, rank, seq_id, score,
    draw, low, high; a written table).

    The big table is not shuffled.  If the picks fit, they are broadcast.  Otherwise one row
    of bounds per neuron lets through exactly the score range of the top picks and the draw
    ranges of the samples, and only the survivors, about as many as the picks, are matched by
    key.
    """
    named = picks.drop("low", "high", "draw")
    rows = acts.select(*NEURON, "seq_id", "tokens", "activations")
    if fits(named, limit):
        return rows.join(F.broadcast(named), [*NEURON, "seq_id"])
    score, drawn = F.col("_score"), F.col("_draw")
    keyed = (
        join_sized(rows, with_bounds(picks), NEURON, limit=limit)
        .withColumn("_score", record_score(F.col("activations")))
        .withColumn("_draw", draw(seed, *NEURON, "seq_id"))
    )
    weakest = F.col("weakest.score")
    in_top = (score > weakest) | (
        (score == weakest) & F.col("seq_id").between(F.col("weakest.seq_id"), F.col("last"))
    )
    in_bucket = F.exists(
        "buckets",
        lambda b: (drawn <= b["drawn"])
        & (b["low"].isNull() | (score >= b["low"]))
        & (b["high"].isNull() | (score < b["high"])),
    )
    no = F.lit(False)
    wanted = F.coalesce(in_top, no) | F.coalesce(drawn <= F.col("drawn"), no) | F.coalesce(in_bucket, no)
    survivors = keyed.where(wanted).select(*NEURON, "seq_id", "tokens", "activations")
    return survivors.join(named, [*NEURON, "seq_id"])


def neuron_records(
    acts: DataFrame,
    k: int = TOP_K,
    sample_size: int = SAMPLE_SIZE,
    quantiles: Sequence[float] | None = QUANTILES,
    per_quantile: int = 10,
    seed: int = SEED,
    index: DataFrame | None = None,
    boundaries: DataFrame | None = None,
) -> DataFrame:
    """All retained records, long: layer, neuron, kind, bucket, rank, seq_id, score, tokens, activations.

    Two passes over the arrays: one builds the index, one fetches the retained records.  A caller
    that has the index of ``acts``, or its ``boundaries`` for ``quantiles``, as written tables passes them on.
    """
    index = cut_lineage(record_index(acts, seed)) if index is None else index
    edges = {"bucket": F.lit(None).cast("int"), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}
    lists = []
    if k > 0:
        lists.append(top_picks(index, k).withColumn("kind", F.lit("top")).withColumns(edges))
    if sample_size > 0:
        lists.append(sample_picks(index, sample_size).withColumn("kind", F.lit("random")).withColumns(edges))
    if quantiles:
        boundaries = cut_lineage(quantile_boundaries(index, quantiles)) if boundaries is None else boundaries
        drawn = sample_picks(bucketed(index, boundaries, written=True), per_quantile, [*NEURON, "bucket"])
        lists.append(
            join_sized(drawn, boundaries, NEURON, written=True)
            .withColumns(
                {
                    "kind": F.lit("quantile"),
                    "low": F.get("quantile_boundaries", F.col("bucket") - 1),
                    "high": F.get("quantile_boundaries", F.col("bucket")),
                }
            )
            .drop("quantile_boundaries")
        )
    if not lists:
        raise ValueError("nothing to retain: k, sample_size and quantiles are all empty")
    chosen = reduce(DataFrame.unionByName, lists)
    return fetch_records(acts, cut_lineage(chosen), seed).select(
        *NEURON, "kind", "bucket", "rank", "seq_id", "score", "tokens", "activations"
    )


def moments(acts: DataFrame, keys: Sequence[str] = NEURON) -> DataFrame:
    """Count, mean, sample variance, skewness and kurtosis over every value of each key.

    Values are exploded inside the scan stage and pre-aggregated there: one row per key and
    input partition is shuffled.  ``m2`` is the sum of squared deviations, for exact merging.
    """
    nan = F.lit(float("nan"))
    n = F.count("v")
    spread = F.max("v") > F.min("v")
    return (
        acts.select(*keys, F.explode_outer("activations").alias("v"))
        .groupBy(*keys)
        .agg(
            n.alias("n_values"),
            F.coalesce(F.avg("v"), nan).alias("mean"),
            F.coalesce(F.var_pop("v") * n, F.lit(0.0)).alias("m2"),
            F.coalesce(F.when(n >= 2, F.var_samp("v")), nan).alias("variance"),
            F.coalesce(F.when(spread, F.skewness("v")), nan).alias("skewness"),
            F.coalesce(F.when(spread, F.kurtosis("v")), nan).alias("kurtosis"),
        )
    )


def merge_moments(stats: DataFrame, keys: Sequence[str] = NEURON) -> DataFrame:
    """Combine (n_values, mean, m2) of several parts of each key, exactly.

    Deviations are taken from the common mean, so nothing cancels.  The input has one row per
    key and part, so a key holds as many rows as there are parts; they are shuffled once.  A key
    without values has 0 values and no mean, as ``moments`` has it.
    """
    n, nan = F.col("n_values"), F.lit(float("nan"))
    parts = Window.partitionBy(*keys)
    weighed = F.sum(F.when(n > 0, n * F.col("mean"))).over(parts)
    centred = stats.withColumn("_mean", F.try_divide(weighed, F.sum(n).over(parts)))
    total = F.sum(n)
    gap = F.col("mean") - F.col("_mean")
    m2 = F.coalesce(F.sum(F.when(n > 0, F.col("m2") + n * gap * gap)), F.lit(0.0))
    return centred.groupBy(*keys).agg(
        total.alias("n_values"),
        F.coalesce(F.first("_mean"), nan).alias("mean"),
        m2.alias("m2"),
        F.when(total >= 2, F.try_divide(m2, total - 1)).otherwise(nan).alias("variance"),
    )


def max_activations(acts: DataFrame) -> DataFrame:
    """Largest activation per neuron, plain and clamped at 0.  A neuron without any activation fails."""
    largest = F.max(F.array_max("activations"))
    none = F.raise_error(F.concat_ws(" ", F.lit("no activations of neuron"), *[F.first(k).cast("string") for k in NEURON])).cast("double")
    return acts.groupBy(*NEURON).agg(
        F.when(largest.isNull(), none).otherwise(largest).alias("max_activation"),
        relu_max(F.col("activations")).alias("relu_max"),
    )


def with_levels(acts: DataFrame) -> DataFrame:
    """Add integer levels 0..10 relative to the neuron's own maximum."""
    top = max_activations(acts).select(*NEURON, "relu_max")
    return join_sized(acts, top, NEURON).withColumn("levels", to_levels(F.col("activations"), F.col("relu_max")))


def nonzero_share(acts: DataFrame) -> DataFrame:
    """Share of values whose level is not 0."""
    return (
        with_levels(acts)
        .groupBy(*NEURON)
        .agg(F.try_divide(F.sum(nonzero_count(F.col("levels"))), F.sum(F.size("activations"))).alias("nonzero_share"))
    )


def with_unit_scale(acts: DataFrame, at_zero: float = 0.0) -> DataFrame:
    """Add activations scaled by the neuron's clamped maximum (negatives stay negative)."""
    top = max_activations(acts).select(*NEURON, "relu_max")
    return join_sized(acts, top, NEURON).withColumn(
        "unit_activations", unit_scaled(F.col("activations"), F.col("relu_max"), at_zero)
    )


def run_summary(acts: DataFrame) -> DataFrame:
    """One row: neurons, layers, sequences and records seen.

    Neurons and sequences are deduplicated separately, each before its own shuffle.
    """
    neurons = acts.groupBy(*NEURON).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("neurons"), F.countDistinct("layer").alias("layers"), F.sum("n").alias("records")
    )
    sequences = acts.select("seq_id").distinct().agg(F.count("*").alias("sequences"))
    parts = neurons.unionByName(sequences, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in ("neurons", "layers", "records", "sequences")])


def check_layers(spark_layers: int, wanted: Sequence[int] | None) -> list[int]:
    """Layers to keep: all, or the sorted distinct wanted ones, each within [0, layers)."""
    return _within("layer", spark_layers, wanted)


def check_neurons(width: int, wanted: Sequence[int] | None) -> list[int]:
    return _within("neuron", width, wanted)


def _within(name: str, size: int, wanted: Sequence[int] | None) -> list[int]:
    if wanted is None:
        return list(range(size))
    outside = [i for i in wanted if not 0 <= i < size]
    if outside:
        raise ValueError(f"{name} {outside[0]} is outside 0..{size - 1}")
    return sorted(set(wanted))


def select_neurons(
    acts: DataFrame, layers: Sequence[int] | None = None, neurons: Sequence[int] | None = None
) -> DataFrame:
    """Keep some layers and neurons; the filters reach the scan (partition pruning on layer)."""
    for column, wanted in (("layer", layers), ("neuron", neurons)):
        if wanted is not None:
            acts = acts.where(F.col(column).isin(sorted(set(wanted))))
    return acts


def neuron_keys(df: DataFrame, layer: str = "layer", neuron: str = "neuron") -> DataFrame:
    """Distinct numeric layer and neuron names as integers, in numeric order."""
    text = [F.col(c).cast("string").alias(c) for c in (layer, neuron)]
    numeric = df.select(*text).distinct().where(F.col(layer).rlike(r"^[0-9]+$") & F.col(neuron).rlike(r"^[0-9]+$"))
    keys = [F.col(layer).cast("int").alias("layer"), F.col(neuron).cast("int").alias("neuron")]
    return numeric.select(*keys).distinct().orderBy("layer", "neuron")
