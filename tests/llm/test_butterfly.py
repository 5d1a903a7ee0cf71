import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from axonframe.llm.butterfly import dataset_manifest, folded, siblings_text

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


def digest(row):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()


def climb(nodes, fanout):
    """Root of a list of nodes and the siblings (left, right) of each on its way up."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place - place % fanout
            proofs[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fanout])))
            at[i] = place // fanout
        nodes = [sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, subroots = [], []
    for name in names:
        leaves = sorted(((r[0] is not None, r[0] or 0, digest(r), r) for r in groups[name]), key=lambda x: x[:3])
        subroot, proofs = climb([leaf[2] for leaf in leaves], fanout)
        subroots.append(subroot)
        found.append([(leaf[3][0], leaf[2], proof, subroot) for leaf, proof in zip(leaves, proofs)])
    root, tops = climb(subroots, fanout)
    return sorted(((i, leaf, [*proof, *top], subroot, root) for own, top in zip(found, tops) for i, leaf, proof, subroot in own), key=str)


def collected(frame):
    return sorted(((r.row_id, r.leaf, [tuple(p) for p in r.proof], r.subroot, r.root) for r in frame.collect()), key=str)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 1), (8, 4), (4, 2)])
def test_equals_brute_force(spark, fanout, levels):
    rng = random.Random(fanout)
    langs = [None, "", "de", "zz", "Ünï", "en", "en", "en", "en", "a", "b", "c", "d"]
    rows = [(rng.randrange(-300, 900), rng.choice("xy"), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", f"Text {i} é\n"])) for i in range(230)]
    rows += [(7, "x", "alone", 1, "one leaf")] + [(5, "x", "en", 4, "Same row")] * 40 + [(None, None, None, None, None)] * 3 + [(None, "x", "en", 1, "no id")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(dataset_manifest(frame, FIELDS, fanout=fanout, levels=levels)) == brute(rows, fanout)


def test_many_blocks_that_are_no_power(spark):
    rows = [(i, "s", lang, None, f"{lang}{i}") for lang, n in (("a", 1), ("b", 45), ("c", 7), ("d", 28), ("e", 2), ("f", 3), ("g", 19)) for i in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert collected(dataset_manifest(frame, FIELDS, fanout=3, levels=1)) == brute(rows, 3)


def test_proofs_find_changed_rows(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, f"Row {i}" if i % 2 else f"row {i}") for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("group", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("place", F.lit(2))
    claimed = [F.lower("text") if name == "text" else F.col(name) for name in FIELDS]
    found = dataset_manifest(frame, FIELDS, claimed=claimed, fanout=4, levels=1).withColumn("again", folded(F.col("claimed"), F.col("proof")))
    assert {r.row_id for r in found.where("again = root").collect()} == {i for i in range(100) if i % 2 == 0}
    assert found.where(folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert found.select(siblings_text(F.col("proof")).alias("s")).where("s = ''").count() == 0


def test_small_tables(spark):
    assert dataset_manifest(spark.createDataFrame([], SCHEMA), FIELDS).count() == 0
    one = dataset_manifest(spark.createDataFrame([(1, "s", "en", 1, "t")], SCHEMA), FIELDS).first()
    assert one.leaf == one.subroot == one.root == digest((1, "s", "en", 1, "t")) and one.proof == []
