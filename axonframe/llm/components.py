"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``links`` (a, b) to (node, root): root is the smallest node reachable by links.

    Large stars and small stars alternate until the links no longer change: every node is
    linked to the smallest node it sees, first from its larger neighbours, then from its
    smaller ones.  The number of rounds grows with the logarithm of the longest chain.  Sizes
    of neighbourhoods do not matter: the smallest neighbour is an aggregate, and the joins can
    be split.  Each round is a written table.  Links from a node to itself are ignored, nulls
    too; nodes without links are not returned.
    """
    def oriented(edges: DataFrame) -> DataFrame:
        return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def smallest(pairs: DataFrame) -> DataFrame:
        """For (u, v): each u with the smallest of itself and its neighbours."""
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = scratch.write(oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna()), f"{name}-0")
    before, step = state(edges), 0
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges_large = oriented(large)
        low = smallest(edges_large)
        joined = edges_large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        step += 1
        edges = scratch.write(oriented(small), f"{name}-{step}")
        scratch.clear(f"{name}-{step - 1}")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
