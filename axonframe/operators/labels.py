"""Zero/one labels of texts: unpivot, prevalence, roll-up through a taxonomy, joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.operators.scale import join_sized


def unpivot_labels(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide zero/one columns to rows (keys, label, value)."""
    names = [c for c in labels.columns if c not in keys]
    return labels.unpivot(list(keys), names, "label", "value")


def label_prevalence(long: DataFrame) -> DataFrame:
    return long.groupBy("label").agg(
        F.sum("value").cast("bigint").alias("positives"), F.count("value").alias("n"), F.avg("value").alias("share")
    )


def labels_per_text(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(F.sum("value").cast("bigint").alias("n_labels"))


def roll_up(long: DataFrame, taxonomy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level-2 value of a text: the largest of its level-1 values (level1, level2 in taxonomy)."""
    groups = taxonomy.select(F.col("level1").alias("label"), "level2").distinct()
    return join_sized(long, groups, ["label"]).groupBy(*keys, "level2").agg(F.max("value").alias("value"))


def rolled_totals(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Sums per (outer, inner), per outer, and overall; NULL marks a rolled-up level."""
    return rows.rollup(outer, inner).agg(F.sum(value).cast("bigint").alias(value), F.count("*").alias("n"))


def join_arguments(arguments: DataFrame, labels: DataFrame, metadata: DataFrame | None = None, key: str = "argument_id") -> DataFrame:
    """Texts with their labels (both must exist) and, if given, their metadata (may be missing)."""
    joined = arguments.join(labels, key)
    return joined if metadata is None else joined.join(metadata, key, "left")
