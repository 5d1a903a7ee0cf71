"""Activation tables derived from the driver's tables.  Everything stays a Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.arrays import to_levels
from axonframe.operators.records import max_activations
from axonframe.operators.scale import join_sized

#: Neurons per layer, and sequence length, of the derived activation table.
WIDTH = 32
LENGTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding dimensions as neurons, runs of 16 vectors as sequences, labels as tokens."""
    values = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("t"), F.col("label").cast("string")).alias("token"),
        F.posexplode("embedding").alias("dim", "value"),
    )
    item = F.struct("vec_id", "token", F.col("value").cast("double").alias("value"))
    grouped = values.groupBy("dim", F.expr(f"vec_id div {LENGTH}").alias("seq_id")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return grouped.select(
        F.expr(f"cast(dim div {WIDTH} as int)").alias("layer"),
        F.expr(f"cast(dim % {WIDTH} as int)").alias("neuron"),
        "seq_id",
        F.col("items.token").alias("tokens"),
        F.col("items.value").alias("activations"),
    )


def coarse(df: DataFrame, digits: int = 1) -> DataFrame:
    """Activations rounded so that scores tie often."""
    scale = float(10**digits)
    return df.withColumn(
        "activations", F.transform("activations", lambda x: F.floor(x * scale + 0.5) / scale)
    )


def sims(df: DataFrame) -> DataFrame:
    """Two simulated explanations per neuron: its own levels, and its right neighbour's."""
    top = max_activations(df).select("layer", "neuron", "relu_max")
    own = join_sized(df, top, ["layer", "neuron"]).select(
        "layer",
        "neuron",
        "seq_id",
        "tokens",
        F.transform(to_levels(F.col("activations"), F.col("relu_max")), lambda v: v.cast("double")).alias("expected"),
    )
    other = own.withColumn("neuron", F.expr(f"cast((neuron + {WIDTH - 1}) % {WIDTH} as int)"))
    return own.withColumn("explanation_id", F.lit(0)).unionByName(other.withColumn("explanation_id", F.lit(1)))
