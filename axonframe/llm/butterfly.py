"""Merkle manifest of a dataset, with proofs found by butterfly exchange.

Every row is a leaf.  Rows are numbered within their group (a language, say) and cut into aligned
blocks of ``fanout ** levels`` consecutive leaves; a block is one row, and hashes its own subtree.
Then blocks exchange the roots of subtrees round by round: in each round the blocks whose numbers
differ in one digit (base ``fanout``) swap the roots of the subtrees they lie in.  Every block
hashes the parent itself, so all blocks of a subtree know its root and the siblings on the way up,
and no pass leads down again.  Where the last subtree has fewer blocks than its siblings, its
blocks answer in turn for the missing ones.  Further rounds of the same kind join the groups.

Only ids and digests are shuffled.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.tables import Scratch, map_batches

PROOF = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A field as it enters a digest: ``-`` if null, else its length in UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "")


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def subtree(leaves: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """Levels of nodes from the leaves up: as many as said, or until one node remains if the block is ``alone``."""
    found = [leaves]
    while len(found[-1]) > 1 if alone else len(found) <= levels:
        nodes = found[-1]
        found.append([_hash(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)])
    return found


def _hex(digests: bytes) -> list[str]:
    text = digests.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _blocks(fanout: int, levels: int):
    """Rows in order (place, block, blocks, id, leaf, claimed) to one row per block with its subtree's root."""
    def run(batches):
        place, held = None, []

        def done():
            ids, leaves, claimed = (sum((list(part[i]) for part in held), []) for i in range(3))
            leaves = b"".join(leaves)
            node = subtree(_hex(leaves), fanout, levels, place[2] == 1)[-1][0]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in place]
                + [pa.array([ids], pa.list_(pa.int64())), pa.array([leaves], pa.binary()), pa.array([b"".join(claimed)], pa.binary()), pa.array([node])],
                ["place", "block", "blocks", "ids", "leaves", "claimed", "node"],
            )

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.append(0, np.flatnonzero((keys[:2, 1:] != keys[:2, :-1]).any(axis=0)) + 1) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                now = tuple(keys[:, a].tolist())
                if place is not None and now != place:
                    yield done()
                    held = []
                place = now
                held.append([batch.column(i).slice(a, b - a).to_pylist() for i in (3, 4, 5)])
        if held:
            yield done()

    return run


def _leaves(fanout: int, levels: int):
    """Blocks with what they heard to one row per leaf with its whole proof."""
    def run(batches):
        for batch in batches:
            for blocks, ids, leaves, claimed, upper, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                leaves = _hex(leaves)
                nodes = subtree(leaves, fanout, levels, blocks == 1)
                lefts, rights = [], []
                for at in range(len(leaves)):
                    for level in nodes[:-1]:
                        first = at - at % fanout
                        lefts.append("".join(level[first:at]))
                        rights.append("".join(level[at + 1 : first + fanout]))
                        at //= fanout
                    lefts += [level["left"] for level in upper]
                    rights += [level["right"] for level in upper]
                deep = len(nodes) - 1 + len(upper)
                proof = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(ids) + 1, dtype=np.int32) * deep),
                    pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"]),
                )
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(leaves), pa.array(_hex(claimed)), proof, pa.array([subroot] * n), pa.array([root] * n)],
                    ["row_id", "leaf", "claimed", "proof", "subroot", "root"],
                )

    return run


def _exchanged(state: DataFrame, fanout: int) -> DataFrame:
    """One round: (group, turn) say who swaps, ``digit`` is the own subtree, ``lo`` the own number in it.

    A subtree of ``members`` blocks also answers for the numbers up to ``width`` that it lacks.
    """
    slots = F.sequence("lo", F.col("width") - 1, F.col("members"))
    sent = state.select("group", "turn", "digit", "node", F.explode(slots).alias("lo"))
    # At most ``fanout`` rows per (group, turn, lo).
    heard = sent.groupBy("group", "turn", "lo").agg(F.array_sort(F.collect_list(F.struct("digit", "node"))).alias("run"))
    both = state.join(heard, ["group", "turn", "lo"])

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("run", keep), lambda n: n["node"]), "")

    level = F.struct(joined(lambda n: n["digit"] < F.col("digit")).alias("left"), joined(lambda n: n["digit"] > F.col("digit")).alias("right"))
    return both.withColumn("proof", F.concat("proof", F.array(level))).withColumn("node", F.sha2(joined(lambda n: F.lit(True)), 256))


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}L")


def _numbered(table: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``number``: position of each row in the order, from 0, by ranges and the totals of partitions."""
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    written = scratch.write(ranged.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND((1 << 33) - 1)), name)
    # One row per partition.
    totals = written.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    return written.join(totals, "part").withColumn("number", F.col("before") + F.col("at")).drop("part", "at", "before")


def dataset_manifest(
    rows: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", claimed: list[Column] | None = None,
    fanout: int = 8, levels: int = 4,
) -> DataFrame:
    """One row per input row: row_id, leaf, claimed, proof, subroot, root.

    A leaf is the SHA-256 of the row's ``fields``.  The leaves of a group ascend by id (null
    first); every ``fanout`` consecutive nodes (the last run may be shorter) become one, until one
    remains: the subroot.  Subroots, ordered by group (null first, bytewise), become the root in
    the same way.  ``proof`` has an entry per hash from the leaf to the root with the siblings to
    the left and right; ``folded`` recomputes the root from it.  ``claimed`` is the leaf of other
    values for the same row (a replica's, say), or the own leaf.

    Null values have a digest of their own; rows that repeat an id follow each other by digest,
    equal rows are leaves each.  An empty table gives no rows.  Other columns are ignored.  One row
    per partition and per group passes a single task; no broadcast is asked for.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "manifest")
    own = [F.col(f"`{name}`") for name in fields]
    leaf = leaf_digest(own)
    source = rows.select(
        F.col(group_col).cast("string").alias("group"), F.col(id_col).cast("bigint").alias("id"), F.unhex(leaf).alias("leaf"),
        F.unhex(leaf_digest(claimed) if claimed else leaf).alias("claimed"), F.monotonically_increasing_id().alias("uid"),
    )
    source = scratch.write(source, "digests")
    # The row number at the end only splits rows that are equal leaves, which may be any number.
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("uid").asc()]
    placed = _numbered(source, order, scratch, "numbered")
    span = fanout**levels
    groups = placed.groupBy("group").agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    groups = groups.withColumn("blocks", F.expr(f"(rows + {span - 1}) div {span}L"))
    up = Window.orderBy("first")
    groups = scratch.write(groups.select(
        "group", "first", "blocks", (F.row_number().over(up) - 1).cast("bigint").alias("place"),
        F.coalesce(F.sum("blocks").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    ), "groups")
    totals = groups.agg(F.max("blocks").alias("blocks"), F.count("*").alias("groups")).first()
    own_group = groups.withColumnRenamed("group", "named")
    placed = placed.join(own_group, F.col("group").eqNullSafe(F.col("named"))).withColumn("at", F.col("number") - F.col("first"))
    placed = placed.withColumn("block", _div("at", span)).select("place", "block", "blocks", "id", "leaf", "claimed", "at")
    ordered = placed.repartition("place", "block").sortWithinPartitions("place", "block", "at").drop("at")
    blocks = scratch.write(map_batches(
        ordered, _blocks(fanout, levels), "place BIGINT, block BIGINT, blocks BIGINT, ids ARRAY<BIGINT>, leaves BINARY, claimed BINARY, node STRING"
    ), "blocks")
    columns = ["place", "block", "blocks", "node", "proof"]
    state = blocks.select("place", "block", "blocks", "node", F.expr(f"cast(array() as {PROOF})").alias("proof"))
    size = 1
    while size < (totals["blocks"] or 0):  # Rounds inside groups; a group takes part until one node remains.
        here = state.withColumn("turn", _div("block", size * fanout)).withColumn("digit", _div("block", size) % fanout)
        active = here.where(F.col("blocks") > size).select(
            *columns, F.col("place").alias("group"), "turn", "digit", (F.col("block") % size).alias("lo"),
            F.least(F.lit(size), F.col("blocks") - _div("block", size) * size).alias("members"),
            F.least(F.lit(size), F.col("blocks") - F.col("turn") * (size * fanout)).alias("width"),
        )
        state = scratch.write(_exchanged(active, fanout).select(columns).unionByName(state.where(F.col("blocks") <= size)), f"round-{size}")
        size *= fanout
    columns.append("subroot")
    state = state.withColumn("subroot", F.col("node"))
    size = 1
    while size < (totals["groups"] or 0):  # Rounds between groups.
        trees = groups.groupBy(_div("place", size).alias("tree")).agg(F.min("ahead").alias("base"), F.sum("blocks").alias("members"))
        widths = trees.groupBy(_div("tree", fanout).alias("turn")).agg(F.max("members").alias("width"))
        trees = trees.withColumn("turn", _div("tree", fanout)).join(widths, "turn")
        here = state.withColumn("tree", _div("place", size)).join(trees, "tree").join(groups.select("place", "ahead"), "place")
        here = here.select(
            *columns, F.lit(0).alias("group"), "turn", (F.col("tree") % fanout).alias("digit"), (F.col("ahead") + F.col("block") - F.col("base")).alias("lo"), "members", "width"
        )
        # Every block of a subtree sends its root once; slots that several groups' trees share are filled by turns.
        state = scratch.write(_exchanged(here, fanout).select(columns), f"groups-{size}")
        size *= fanout
    heard = state.select("place", "block", "proof", "subroot", F.col("node").alias("root"))
    told = blocks.select("place", "block", "blocks", "ids", "leaves", "claimed").join(heard, ["place", "block"])
    return map_batches(
        told.select("blocks", "ids", "leaves", "claimed", "proof", "subroot", "root"), _leaves(fanout, levels),
        f"row_id BIGINT, leaf STRING, claimed STRING, proof {PROOF}, subroot STRING, root STRING",
    )
