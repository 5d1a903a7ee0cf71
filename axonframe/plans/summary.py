"""The flagship job: activation table to one summary row per neuron."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators import records
from axonframe.plans.fixtures import acts
from axonframe.schemas import NEURON


def neuron_summary(spark: SparkSession, sf_dir: str, k: int = 10, sample_size: int = 5) -> DataFrame:
    """Moments of each neuron with the score range of its top records and its sample size."""
    table = acts(spark, sf_dir)
    kept = records.neuron_records(table, k, sample_size, None)
    top = F.col("kind") == "top"
    lists = kept.groupBy(*NEURON).agg(
        F.count(F.when(top, 1)).alias("n_top"),
        F.max(F.when(top, F.col("score"))).alias("best_score"),
        F.min(F.when(top, F.col("score"))).alias("weakest_score"),
        F.count(F.when(~top, 1)).alias("n_sampled"),
    )
    return records.moments(table).select(*NEURON, "n_values", "mean", "variance").join(lists, NEURON)
