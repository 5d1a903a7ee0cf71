"""Everything known about a neuron, joined: explanations, records, tokens, related neurons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.schemas import NEURON

# How many items a page shows.
RELATED_LISTED = 10
RELATED_SHOWN = 3
TOKENS_SHOWN = 20
TOP_SCORED = 5
GROUPS_SHOWN = {"top": 4, "quantile": 1, "random": 2}


def parse_neuron_name(name: Column) -> Column:
    """"layer_neuron" as a struct of integers."""
    parts = F.split(name, "_")
    return F.struct(
        F.get(parts, F.lit(0)).cast("int").alias("to_layer"), F.get(parts, F.lit(1)).cast("int").alias("to_neuron")
    )


def listed_related(connections: DataFrame, listed: int = RELATED_LISTED) -> DataFrame:
    """The strongest positive connections per direction."""
    return connections.where((F.col("sign") == "positive") & (F.col("rank") <= listed))


def related_explanations(related: DataFrame, explanations: DataFrame, shown: int = RELATED_SHOWN) -> DataFrame:
    """The first related neurons of each direction with their own explanation and score.

    Filtering by rank comes first, so the join sees at most ``shown`` rows per neuron and
    direction.
    """
    named = explanations.select(
        F.col("layer").alias("to_layer"),
        F.col("neuron").alias("to_neuron"),
        F.col("explanation").alias("to_explanation"),
        F.col("score").alias("to_score"),
    )
    return related.where(F.col("rank") <= shown).join(named, ["to_layer", "to_neuron"], "left")


def neuron_page(
    neurons: DataFrame,
    explanations: DataFrame | None = None,
    stats: DataFrame | None = None,
    tokens: DataFrame | None = None,
    related: DataFrame | None = None,
) -> DataFrame:
    """One row per wanted neuron; a missing part is NULL.  Every part has one row per neuron."""
    page = neurons
    for part in (explanations, stats, tokens, related):
        if part is not None:
            page = page.join(part, NEURON, "left")
    return page


def shown_records(records: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The first records of each list that a page shows before "show more"."""
    wanted = GROUPS_SHOWN if limits is None else limits
    limit = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    return records.where(F.col("rank") <= F.coalesce(F.try_element_at(limit, F.col("kind")), F.lit(0)))


def scored_heads(scored: Column, top: int = TOP_SCORED) -> Column:
    """Scored sequences by position: the first ones count as top, the others as random."""
    return F.struct(
        F.slice(scored, 1, top).alias("top"),
        F.slice(scored, F.lit(top + 1), F.greatest(F.size(scored) - top, F.lit(0))).alias("random"),
    )
