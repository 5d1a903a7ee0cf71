"""Token tables: which tokens activate a neuron most on average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.draws import draw
from axonframe.operators.scale import top_rows
from axonframe.schemas import NEURON

LISTED = 100
SHOWN = 50


def token_values(acts: DataFrame) -> DataFrame:
    """One row per token and activation."""
    return acts.select(*NEURON, F.inline(F.arrays_zip("tokens", "activations"))).select(
        *NEURON, F.col("tokens").alias("token"), F.col("activations").alias("activation")
    )


def token_means(acts: DataFrame) -> DataFrame:
    """Mean activation of every token.  Values are averaged map-side first; a frequent token sends one row per task."""
    return token_values(acts).groupBy(*NEURON, "token").agg(
        F.avg("activation").alias("avg_activation"), F.count("activation").alias("n")
    )


def token_averages(acts: DataFrame, listed: int = LISTED) -> DataFrame:
    """The ``listed`` tokens of each neuron with the highest mean activation, highest first."""
    return top_rows(token_means(acts), NEURON, [F.col("avg_activation").desc(), F.col("token")], listed)


def shown_tokens(table: DataFrame, shown: int = SHOWN, seed: int = 0) -> DataFrame:
    """A repeatable sample of the listed tokens, in list order."""
    drawn = table.withColumn("_draw", draw(seed, *NEURON, "token"))
    return top_rows(drawn, NEURON, [F.col("_draw"), F.col("token")], shown, rank_col="_pick").drop("_draw", "_pick")


def token_lists(table: DataFrame, shown: int | None = None) -> DataFrame:
    """One row per neuron with its ranked tokens as arrays (at most the listed ones)."""
    rows = table if shown is None else table.where(F.col("rank") <= shown)
    items = F.array_sort(F.collect_list(F.struct("rank", "token", "avg_activation")))
    return rows.groupBy(*NEURON).agg(items.alias("_items")).select(
        *NEURON,
        F.col("_items.token").alias("tokens"),
        F.col("_items.avg_activation").alias("average_activations"),
    )
