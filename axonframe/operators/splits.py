"""Interleaved train / calibration / valid / test splits of the retained records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.schemas import NEURON, check_choice

# Split names in the order in which list positions are dealt out.
TOP_SPLITS = ("train", "calibration", "valid", "test")
RANDOM_SPLITS = ("calibration", "valid", "test")


def split_records(records: DataFrame, per_split: int | None = None) -> DataFrame:
    """Deal the ranked lists of every neuron to splits, position by position.

    ``records`` has kind 'top' or 'random' and a rank from 1, at most top-k and sample-size
    rows per neuron.  Each list gives ``per_split`` records to each split (default: as many as
    it can give equally); a shorter list fails the job, the remainder stays unused.  The new
    column ``position`` orders a split: its top records first, then its random ones.
    """
    parts = []
    for kind, splits in (("top", TOP_SPLITS), ("random", RANDOM_SPLITS)):
        stride = len(splits)
        rows = records.where(F.col("kind") == kind)
        size = F.count("*").over(Window.partitionBy(*NEURON))
        each = F.floor(size / stride) if per_split is None else F.lit(per_split)
        position = F.col("rank") - 1
        short = F.concat(F.lit(f"too few {kind} records for {per_split} per split: "), F.col("_size").cast("string"))
        dealt = rows.withColumn("_size", size).withColumn("_each", each)
        if per_split is not None:
            enough = F.col("_size") >= per_split * stride
            dealt = dealt.withColumn("_each", F.when(enough, F.col("_each")).otherwise(F.raise_error(short).cast("int")))
        parts.append(
            dealt.where(position < F.col("_each") * stride)
            .withColumn("split", F.get(F.array(*[F.lit(s) for s in splits]), (position % stride).cast("int")))
            .drop("_size", "_each")
        )
    both = parts[0].unionByName(parts[1])
    order = Window.partitionBy(*NEURON, "split").orderBy(F.col("kind") != "top", "rank")
    return both.withColumn("position", F.row_number().over(order) - 1)


def one_split(records: DataFrame, split: str, per_split: int | None = None) -> DataFrame:
    check_choice("split", split, TOP_SPLITS)
    return split_records(records, per_split).where(F.col("split") == split)
