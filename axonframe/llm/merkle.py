"""Fixity audit of archive replicas with Merkle trees.

Every record of an archive has a digest of its payload.  Records are ordered by id; files hold
``FILE`` ids each, so a record has an offset inside its file.  The tree's lowest nodes cover
ordered ranges of ``FAN`` ids with their byte range; each higher level joins ``FAN`` nodes.  A
node's hash covers its children's hashes in order.  Two replicas are compared from their roots
down: only the children of nodes that differ are looked at, until the records are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.tables import Scratch

#: Children per node, and ids per file (two levels above the records).
FAN = 64
FILE = FAN * FAN

#: Stands for the id of a record without id.
NO_ID = -(1 << 62)


def _div(number: str, by: int) -> Column:
    """Whole division, downwards also for negative numbers."""
    return F.expr(f"({number} - pmod({number}, {by})) div {by}")


def warc_record(url: Column, payload: Column) -> Column:
    """The block of a response record: named fields, a blank line, the payload."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n"),
    )


def manifest(records: DataFrame, id_col: str, block: Column) -> DataFrame:
    """One row per id: id, copies, length, digest, file, start (offset in the file).

    Payloads are digested where they lie; only numbers are shuffled.  Rows that repeat an id are
    one entry whose digest does not depend on their order: copies, total length and a sum over
    their digests.
    """
    own = records.select(F.col(id_col).cast("bigint").alias("id"), block.alias("block"))
    own = own.select("id", F.octet_length("block").cast("bigint").alias("length"), F.sha2(F.coalesce("block", F.lit("")), 256).alias("digest"))
    pieces = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"d{i}") for i in range(8)]
    summed = own.select("id", F.coalesce("length", F.lit(0)).alias("length"), "digest", *pieces).groupBy("id").agg(
        F.count("*").alias("copies"), F.sum("length").alias("length"), F.min("digest").alias("one"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(8)]
    )
    digest = F.when(F.col("copies") == 1, F.col("one")).otherwise(F.sha2(F.concat_ws("|", "copies", *[f"d{i}" for i in range(8)]), 256))
    entries = summed.select("id", "copies", "length", digest.alias("digest"), _div("id", FILE).alias("file"))
    # At most FILE rows per window.
    before = Window.partitionBy("file").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))


def _joined(level: DataFrame) -> DataFrame:
    """The next level: nodes of FAN children, at most, with their hash in order."""
    parent = _div("node", FAN)
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return level.groupBy(parent.alias("node")).agg(
        F.sha2(F.concat_ws(",", F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"]))), 256).alias("hash")
    )


def tree(entries: DataFrame, scratch: Scratch, name: str, top: int) -> list[DataFrame]:
    """Levels (node, hash) from the ranges of records up to the level ``top``, each a written table."""
    leaf = F.sha2(F.concat_ws("|", "id", "copies", "length", "digest"), 256)
    records = entries.select(F.coalesce("id", F.lit(NO_ID)).alias("node"), leaf.alias("hash"), "start", "length")
    parent = _div("node", FAN)
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    ranges = records.groupBy(parent.alias("node")).agg(
        F.sha2(F.concat_ws(",", F.min("start").cast("string"), F.max(F.col("start") + F.col("length")).cast("string"),
                           F.concat_ws(",", F.transform(children, lambda c: c["hash"]))), 256).alias("hash")
    )
    levels = [scratch.write(ranges, f"{name}-1")]
    for number in range(2, top + 1):
        levels.append(scratch.write(_joined(levels[-1]), f"{name}-{number}"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), "node", "full")
    return both.where("not (a <=> b)").select("node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two manifests differ, found by descending from differing roots.

    Returns id, file, start, stop (byte range by the primary, or by the replica if the primary
    lacks the record), kind, expected and found digest.  Kinds: missing, extra, changed (another
    digest), copies (equal digests but another number of rows), moved (only the offset differs,
    as an earlier record of the file has another length).  An entry without id is one record.
    Empty manifests are equal.  Equal replicas give no rows after one comparison of roots.
    """
    spark = primary.sparkSession
    scratch = Scratch(spark, "merkle")
    sides = [scratch.write(side, name) for side, name in ((primary, "a"), (replica, "b"))]
    limits = sides[0].unionByName(sides[1]).agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    low, high = limits["low"] or 0, limits["high"] or 0
    top = 1
    while low // FAN**top != high // FAN**top and top < 11:
        top += 1
    trees = [tree(side, scratch, name, top) for side, name in zip(sides, "ab")]
    # From the top level down: children of differing nodes only.
    suspects = _differing(trees[0][-1], trees[1][-1])
    for number in range(top - 1, 0, -1):
        chosen = scratch.write(suspects.withColumnRenamed("node", "parent"), f"suspects-{number}")
        below = [t[number - 1].withColumn("parent", _div("node", FAN)).join(chosen, "parent", "left_semi").drop("parent") for t in trees]
        suspects = _differing(*below)
    chosen = scratch.write(suspects.withColumnRenamed("node", "parent"), "suspects-0")
    parent = _div(f"coalesce(id, {NO_ID}L)", FAN)
    found = [side.withColumn("parent", parent).join(chosen, "parent", "left_semi").select(
        F.struct("id", "copies", "length", "digest", "file", "start").alias(name), F.coalesce("id", F.lit(NO_ID)).alias("key")
    ) for side, name in zip(sides, "ab")]
    both = found[0].join(found[1], "key", "full")
    kind = (
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra")
        .when(F.col("a.copies") != F.col("b.copies"), "copies").when(F.col("a.digest") != F.col("b.digest"), "changed")
        .when(F.col("a.start") != F.col("b.start"), "moved")
    )
    place = F.coalesce("a", "b")
    return both.withColumn("kind", kind).where("kind is not null").select(
        place["id"].alias("id"), place["file"].alias("file"), place["start"].alias("start"), (place["start"] + place["length"]).alias("stop"),
        "kind", F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"),
    )
