"""Jaccard join of documents on word n-grams by signature trees.

1. Each document becomes the set of its distinct n-gram hashes, with a bitmap, in one scan.
2. Documents with equal sets are one class; only classes are compared.
3. Two sets that are similar enough share an n-gram among the first ones of each in any common
   order (prefix filter).  The order puts n-grams that many documents share last: the most
   frequent ones, a list of bounded length, by their counts.  So common passages make no
   candidates unless they fill most of a document.
4. Classes that share such an n-gram form a block.  Equal blocks are kept once.  Within a block
   a signature tree is traversed against itself; pairs that pass its bound are candidates.
   Blocks beyond ``BLOCK`` classes are not gathered: their classes are linked to one of them,
   which can only add candidates.
5. Connected candidates form a group.  Only then are exact sets gathered, once per class, and
   each group is traversed again, now deciding pairs exactly.  Groups beyond a bound are cut
   into cells, and pairs of cells are visited only where the group is not yet one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.components import components
from axonframe.llm.signature_tree import Forest, bitmap, united
from axonframe.llm.tables import Scratch, map_batches, text_pieces, utf8_rows
from axonframe.llm.words import WordHashes, Words, set_key, shingle_sets

#: Classes gathered for one tree, and hashes gathered for one cell of exact sets (40 MB).
BLOCK = 2048
CELL_HASHES = 5_000_000

#: N-grams ordered by their frequency; all others come before them.  A bound of 2 MB.
FREQUENT = 131_072

#: An n-gram is counted where so many documents of an Arrow batch share it.
SHARED = 3

_PROFILE = "doc_id BIGINT, n BIGINT, k BIGINT, map BINARY, shingle BIGINT, seen BIGINT"
_BLOCKS = "kind STRING, block BIGINT, k BIGINT, other BIGINT"


def _sets(batch: pa.RecordBatch, hashes: WordHashes, length: int) -> list[np.ndarray]:
    sets = []
    for texts in text_pieces(batch.column(1)):
        sets += shingle_sets(Words([text.lower() for text in utf8_rows(texts)], hashes), length)
    return sets


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _profile(length: int):
    def run(batches):
        hashes = WordHashes()
        names = ["doc_id", "n", "k", "map", "shingle", "seen"]
        for batch in batches:
            sets = _sets(batch, hashes, length)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                none, none,
            ], names)
            shingles, seen = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            often = seen >= SHARED
            count = int(often.sum())
            none = pa.nulls(count, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.nulls(count, pa.binary()), pa.array(_signed(shingles[often])), pa.array(seen[often].astype(np.int64))], names
            )

    return run


def _prefixes(length: int, percent: int, shingles: np.ndarray, counts: np.ndarray):
    """First n-grams of each set.  A frequent one is salted, so that a task gets about BLOCK classes."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            parts = []
            for values in _sets(batch, hashes, length):
                n = len(values)
                if not n:
                    continue
                first = n - (percent * n + 99) // 100 + 1
                at = np.minimum(np.searchsorted(shingles, values), max(len(shingles) - 1, 0))
                frequent = shingles[at] == values if len(shingles) else np.zeros(n, bool)
                rare = values[~frequent][:first]
                later = at[frequent]
                later = later[np.argsort(counts[later], kind="stable")][: first - len(rare)]
                k = set_key(values)
                cells = -(-counts[later] // BLOCK)
                salts = np.concatenate([np.full(len(rare), -1), np.where(cells > 1, k % np.maximum(cells, 1), -1)])
                parts.append((np.concatenate([rare, shingles[later]]), salts, k, n))
            rows = [len(p[0]) for p in parts]
            yield pa.RecordBatch.from_arrays([
                pa.array(_signed(np.concatenate([p[0] for p in parts] + [np.zeros(0, np.uint64)]))),
                pa.array(np.concatenate([p[1] for p in parts] + [np.zeros(0, np.int64)]).astype(np.int32)),
                pa.array(np.repeat(np.array([p[2] for p in parts], np.int64), rows)),
                pa.array(np.repeat(np.array([p[3] for p in parts], np.int64), rows)),
            ], ["shingle", "salt", "k", "n"])

    return run


def _blocks(batches):
    """Runs of equal (shingle, salt), sorted, to blocks of different classes.

    A run of up to BLOCK classes is named after its members, so that equal blocks meet again.
    Longer or salted runs, and those that come in parts, link each class to the run's first class
    instead, row by row.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    names = ["kind", "block", "k", "other"]

    def table(kind, block, k, other):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(k), pa.string()), pa.array(block, pa.int64()), pa.array(k, pa.int64()), pa.array(other, pa.int64())], names)

    def rows(shingle, salt, k, in_parts):
        """``in_parts``: the first run is a part of a longer one."""
        edge = np.flatnonzero((shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])) + 1
        starts, stops = np.append(0, edge), np.append(edge, len(k))
        wanted = (stops - starts > 1) | (salt[starts] >= 0)
        block_of, block_k, star, star_k, hot, hot_k = [], [], [], [], [], []
        for a, b in zip(starts[wanted].tolist(), stops[wanted].tolist()):
            own = np.unique(k[a:b])
            if salt[a] >= 0 or len(own) > BLOCK or in_parts and a == 0:
                hot.append(shingle[a])
                hot_k.append(own[0])
                star.append(np.full(len(own) - 1, own[0]))
                star_k.append(own[1:])
            elif len(own) > 1:
                block_of.append(np.full(len(own), set_key(own.view(np.uint64))))
                block_k.append(own)
        if block_k:
            block = np.concatenate(block_of)
            yield table("block", block, np.concatenate(block_k), block)
        if hot:
            yield table("hot", np.array(hot), np.array(hot_k), np.array(hot_k))
        if star_k:
            yield table("star", np.concatenate(star), np.concatenate(star_k), np.concatenate(star))

    def whole():
        return [np.concatenate([h[i] for h in held]) for i in range(3)]

    in_parts = False
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        shingle, salt, k = whole()
        last = np.flatnonzero((shingle != shingle[-1]) | (salt != salt[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from rows(shingle[:cut], salt[:cut], k[:cut], in_parts)
            in_parts = False
        elif len(k) > 8 * BLOCK:
            # A long run: link what has come, go on with its first class.
            in_parts = True
            yield from rows(shingle, salt, k, in_parts)
            cut = len(k) - 1
            k[-1] = k.min()
        held = [(shingle[cut:], salt[cut:], k[cut:])]
    if held:
        yield from rows(*whole(), in_parts)


def _candidates(percent: int):
    """Sorted (block, n, k, map) to links of candidates, each to the first of its kind in the block."""
    def links(n, k, maps):
        order = np.lexsort((k, n))
        forest = Forest(len(k))
        united(n[order], [maps[i] for i in order], percent, forest)
        roots = forest.roots(0, len(k))
        own = k[order]
        moved = roots != np.arange(len(k))
        return own[moved], own[roots[moved]]

    def run(batches):
        for _, (_, n, k, maps) in _runs(batches):
            a, b = links(n, k, maps)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def _runs(batches):
    """Consecutive rows with an equal first column: (value, columns).  Runs are bounded by the caller."""
    held: list[pa.RecordBatch] = []

    def columns(table):
        return [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns]

    def split(table):
        parts = columns(table)
        edge = np.flatnonzero(parts[0][1:] != parts[0][:-1]) + 1
        for a, b in zip(np.append(0, edge).tolist(), np.append(edge, table.num_rows).tolist()):
            if b > a:
                yield parts[0][a], [p[a:b] for p in parts]

    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        if held and first[0] != first[-1]:
            cut = int(np.flatnonzero(first != first[0])[0]) if first[0] == held[-1].column(0)[-1].as_py() else 0
            yield from split(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
            held, batch = [], batch.slice(cut)
            first = first[cut:]
        elif held and first[0] != held[-1].column(0)[-1].as_py():
            yield from split(pa.Table.from_batches(held).combine_chunks())
            held = []
        last = np.flatnonzero(first != first[-1])
        if len(last):
            cut = int(last[-1]) + 1
            yield from split(pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks())
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield from split(pa.Table.from_batches(held).combine_chunks())


def _keyed(length: int):
    """(doc_id, text) with the key of the text's set, where it has one."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys = [set_key(s) if len(s) else None for s in _sets(batch, hashes, length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["doc_id", "text", "k"])

    return run


def _exact_sets(length: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = _sets(batch, hashes, length)
            wanted = batch.column(2).to_pylist()
            keep = [i for i, s in enumerate(sets) if len(s) and set_key(s) == wanted[i]]
            yield pa.RecordBatch.from_arrays([
                pa.array([wanted[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()),
                pa.array([sets[i].tobytes() for i in keep], pa.binary()),
            ], ["k", "n", "items"])

    return run


def _verified(percent: int):
    """Sorted (cell, n, k, label, items) to exact links inside each cell.

    Classes with an equal label are united from the start.
    """
    def links(n, k, label, items):
        order = np.lexsort((k, n))
        sets = [np.frombuffer(items[i], np.uint64) for i in order]
        own, label = k[order], label[order]
        forest = Forest(len(k))
        firsts: dict[int, int] = {}
        for i, name in enumerate(label.tolist()):
            if name != -1:
                forest.unite(firsts.setdefault(name, i), i)

        def accept(i: int, j: int) -> bool:
            common = len(sets[i]) - int(np.count_nonzero(_absent(sets[i], sets[j])))
            return (100 + percent) * common >= percent * (len(sets[i]) + len(sets[j]))

        united(n[order], [bitmap(s) for s in sets], percent, forest, accept)
        roots = forest.roots(0, len(k))
        moved = roots != np.arange(len(k))
        return own[moved], own[roots[moved]]

    def run(batches):
        for _, (_, n, k, label, items) in _runs(batches):
            a, b = links(n, k, label, items)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def _absent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of sorted ``a`` are not in sorted ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] != a


def _in_cells(rows: DataFrame, percent: int) -> DataFrame:
    ordered = rows.select("cell", "n", "k", "label", "items").repartition("cell").sortWithinPartitions("cell", "n", "k")
    return map_batches(ordered, _verified(percent), "a BIGINT, b BIGINT").distinct()


def _group_links(sets: DataFrame, groups: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Exact links (a, b) that connect each group's classes: (k, n, items) and (k, g)."""
    sizes = sets.select("k", "n").join(groups, "k")
    cells = sizes.groupBy("g").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / CELL_HASHES)).alias("cells")
    )
    member = groups.join(cells, "g").withColumn("part", F.pmod(F.xxhash64("k"), F.col("cells")))
    member = scratch.write(member, "members")
    placed = sets.join(member, "k")
    own = placed.select("k", "n", "items", F.xxhash64("g", "part").alias("cell"), F.lit(-1).cast("bigint").alias("label"))
    links = scratch.write(_in_cells(own, percent), "links-own")
    large = member.where("cells > 1")
    if large.isEmpty():
        return links
    # One class of each component of each cell: the groups' cells meet through these first.
    for step in ("reps", "pairs"):
        label = components(links, scratch, f"label-{step}").withColumnRenamed("node", "k").withColumnRenamed("root", "label")
        named = large.join(label, "k", "left").withColumn("label", F.coalesce("label", "k"))
        open_groups = named.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("g")
        named = scratch.write(named.join(open_groups, "g"), f"named-{step}")
        if step == "reps":
            reps = named.where("k = label").withColumn("many", F.lit(1))
            count = reps.groupBy("g").agg(F.ceil(F.sum("many") / BLOCK).alias("meet"))
            met = reps.join(count, "g").select("k", "label", F.xxhash64("g", F.pmod(F.xxhash64("k", F.lit(1)), "meet"), F.lit("reps")).alias("cell"))
        else:
            # Every pair of cells of a group that is still open.  Labels spare united classes.
            i, j = F.least("part", "to"), F.greatest("part", "to")
            tiles = named.withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1))).where("to <> part")
            met = tiles.select("k", "label", F.xxhash64("g", i, j, F.lit("pair")).alias("cell"))
        found = _in_cells(sets.join(met, "k"), percent)
        links = scratch.write(links.unionByName(found), f"links-{step}")
    return links


def ngram_join(docs: DataFrame, length: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose n-gram sets have 100 * common >= percent * united.

    Returns one row per input row: doc_id, n_shingles (size of its set), component_id (smallest
    id reachable by links, itself included), set_key (equal sets have equal keys; null without
    n-grams).  Words are runs of non-white-space (ASCII) characters; A-Z count as a-z.  A text
    with fewer words than ``length`` is one n-gram; a null, empty or blank text has none and is
    linked with nothing.  Other columns are ignored.  Rows that repeat an id are
    rows of their own, each with its own size and component.  A row without id gets its component's smallest id, or null.
    Hashes have 64 bits.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = scratch.write(map_batches(source, _profile(length), _PROFILE), "profile")
    owners = profile.where("n is not null").select("doc_id", "n", "k", "map")
    frequent = (
        profile.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toArrow()
    )
    shingles, counts = _signed(frequent["shingle"].to_numpy()).view(np.uint64), frequent["seen"].to_numpy()
    order = np.argsort(shingles)
    heads = map_batches(source, _prefixes(length, percent, shingles[order], counts[order]), "shingle BIGINT, salt INT, k BIGINT, n BIGINT")
    found = map_batches(
        heads.select("shingle", "salt", "k").repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "k"), _blocks, _BLOCKS
    )
    found = scratch.write(found, "blocks")
    classes = owners.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("map").alias("map"))
    blocks = found.where("kind = 'block'").select("block", "k").distinct().join(classes.select("k", "n", "map"), "k")
    ordered = blocks.select("block", "n", "k", "map").repartition("block").sortWithinPartitions("block", "n", "k")
    tree_links = map_batches(ordered, _candidates(percent), "a BIGINT, b BIGINT")
    hot = found.where("kind = 'hot'").select(F.col("block").alias("shingle"), "k")
    stars = hot.join(hot.groupBy("shingle").agg(F.min("k").alias("to")), "shingle").select(F.col("k").alias("a"), F.col("to").alias("b"))
    stars = stars.unionByName(found.where("kind = 'star'").select(F.col("k").alias("a"), F.col("other").alias("b")))
    groups = components(tree_links.unionByName(stars), scratch, "groups").withColumnRenamed("node", "k").withColumnRenamed("root", "g")
    wanted = groups.join(classes.select("k", "first_id"), "k").select("first_id", "k")
    texts = source.join(wanted, source["doc_id"] == wanted["first_id"]).select("doc_id", "text", "k")
    # Classes of which no row has an id: one text each, by the key of its set.
    nameless = map_batches(source.where("doc_id is null and text is not null"), _keyed(length), "doc_id BIGINT, text STRING, k BIGINT")
    nameless = nameless.where("k is not null").groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    nameless = nameless.join(wanted.where("first_id is null").select("k"), "k", "left_semi")
    texts = texts.unionByName(nameless)
    sets = scratch.write(map_batches(texts, _exact_sets(length), "k BIGINT, n BIGINT, items BINARY").dropDuplicates(["k"]), "sets")
    links = _group_links(sets, groups, percent, scratch)
    final = components(links, scratch, "final").withColumnRenamed("node", "k")
    smallest = (
        classes.select("k", "first_id").join(final, "k", "left").withColumn("root", F.coalesce("root", "k"))
    )
    smallest = smallest.join(smallest.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("k", "component_id")
    scratch.clear("sets", "blocks")
    return owners.join(smallest, "k", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("k").alias("set_key")
    )
