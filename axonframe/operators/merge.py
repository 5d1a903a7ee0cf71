"""Combine the outputs of independent shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.arrays import record_score
from axonframe.functions.draws import draw
from axonframe.operators.records import (
    SAMPLE_SIZE,
    SEED,
    TOP_K,
    heap_order,
    merge_moments,
    moments,
    sample_picks,
)
from axonframe.operators.scale import top_rows
from axonframe.schemas import NEURON
from axonframe.sources.neurons import record_rows, to_neuron_records

# The order in which a shard's retained lists are fed to the merger.
_KIND_ORDER = {"top": 0, "random": 1, "quantile": 2}


_KEPT = [*NEURON, "seq_id", "score", "tokens", "activations", "kind", "rank"]


def merge_lists(top: DataFrame, drawn: DataFrame, k: int, sample_size: int, seed: int = SEED) -> DataFrame:
    """Bounded lists from candidates (layer, neuron, seq_id, score, tokens, activations).

    Trimming starts before the shuffle, so a candidate table of any size is reduced to at
    most 2k (or sample_size) rows per neuron and task.
    """
    strongest = heap_order(top.where(F.size("activations") > 0), k).withColumn("kind", F.lit("top"))
    sampled = top_rows(
        drawn.withColumn("draw", draw(seed, *NEURON, "seq_id")), NEURON, [F.col("draw"), F.col("seq_id")], sample_size
    ).withColumn("kind", F.lit("random"))
    return strongest.select(*_KEPT).unionByName(sampled.select(*_KEPT))


def merge_exact(
    records: DataFrame, stats: DataFrame, k: int = TOP_K, sample_size: int = SAMPLE_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Merge as if there had been one shard.

    ``records`` is the union of the shards' retained records, ``stats`` the union of their
    moments.  A record retained twice counts once.  Hash samples of shards merge into the
    hash sample of the whole.  Returns (records, moments).
    """
    def distinct(kind: str) -> DataFrame:
        rows = records.where(F.col("kind") == kind).drop("rank", "kind")
        return rows.dropDuplicates([*NEURON, "seq_id"])

    return merge_lists(distinct("top"), distinct("random"), k, sample_size, seed), merge_moments(stats)


def merge_retained(
    records: DataFrame, k: int = TOP_K, sample_size: int = SAMPLE_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Feed every retained record again, as often as it was retained.

    ``records`` has a ``shard`` column.  Records arrive shard by shard: top list, random
    list, then quantile samples.  A record in two lists counts twice, and the moments
    describe the retained records only.  Records read from files have no seq_id; then the
    result has none.  Returns (records, moments).
    """
    columns = [c for c in _KEPT if c != "seq_id" or c in records.columns]
    kind = F.create_map(*[F.lit(x) for pair in _KIND_ORDER.items() for x in pair])
    fed = records.withColumns(
        {
            "score": record_score(F.col("activations")),
            "n_values": F.size("activations"),
            "arrival": F.struct(
                "shard", F.element_at(kind, F.col("kind")).alias("kind"), F.coalesce("bucket", F.lit(0)).alias("bucket"), "rank"
            ),
        }
    ).drop("rank")
    fed = fed.withColumn("draw", draw(seed, *NEURON, *[f"arrival.{part}" for part in ("shard", "kind", "bucket", "rank")]))
    top = heap_order(fed.where(F.col("n_values") > 0), k, arrival="arrival").withColumn("kind", F.lit("top"))
    drawn = top_rows(fed, NEURON, [F.col("draw"), F.col("arrival")], sample_size).withColumn("kind", F.lit("random"))
    return top.select(*columns).unionByName(drawn.select(*columns)), moments(fed)


def merge_neuron_trees(trees: list[DataFrame], k: int = TOP_K, sample_size: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    """One tree from the trees of several shards, given as rows per neuron in shard order.

    Every retained record is fed again (``merge_retained``).  A neuron that some shards lack is
    merged from the others; one without any record stays with 0 values.  Returns rows per neuron,
    ready to be written.
    """
    records = None
    for number, tree in enumerate(trees):
        own = record_rows(tree).withColumn("shard", F.lit(number))
        records = own if records is None else records.unionByName(own)
    if records is None:
        raise ValueError("at least one tree is needed")
    kept, stats = merge_retained(records, k, sample_size, seed)
    names = reduce(DataFrame.unionByName, [tree.select(*NEURON) for tree in trees]).distinct()
    stats = names.join(stats, NEURON, "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    return to_neuron_records(kept.withColumn("bucket", F.lit(None).cast("int")), stats)
