"""Document fingerprints by spot signatures.

A spot is a very common word (article, preposition, form of "to be"); its signature is the chain
of the next three content words.  A document's fingerprint is the set of its signatures, so it
follows the running text and ignores lists, numbers and markup, which hold few common words.
Fingerprints are compared by Jaccard similarity.  Two sets can only reach a threshold if their
sizes are close, so joins partition them by size, and look only at the rarest signatures.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.tables import map_batches
from axonframe.llm.words import REMEMBERED, mix

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der die ein eine einen es für ich im ist mit nicht sich sie und von zu "
    "al como con del el esta la las lo los no o para por se su una y"
).split()

CHAIN = 3
DIGITS = 8

#: Bytes of text in one range of ids.
RANGE_BYTES = 16 << 20


class _Kinds(dict):
    """Words to slots: the hash of the bare word, and whether it is common, content or neither."""

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.anchors = frozenset(ANCHORS)

    def __missing__(self, word: str) -> int:
        bare = "".join(filter(str.isalnum, word.lower()))
        self[word] = slot = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")))
        self.kinds.append(2 if bare in self.anchors else int(bare.isalpha()))
        return slot


class Spots:
    """Fingerprints of texts; words are looked at once per task."""

    def __init__(self) -> None:
        self.slots = _Kinds()

    def of(self, text: str) -> np.ndarray:
        """The sorted different signatures; a text without any has one of its own, an empty text none."""
        if len(self.slots) > REMEMBERED:
            self.slots = _Kinds()
        words = text.split()
        slots = self.slots
        at = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
        different, at = np.unique(at, return_inverse=True)
        kinds = np.array([slots.kinds[i] for i in different.tolist()], np.int8)[at] if len(at) else np.zeros(0, np.int8)
        hashes = np.array([slots.hashes[i] for i in different.tolist()], np.uint64)[at] if len(at) else np.zeros(0, np.uint64)
        content = np.flatnonzero(kinds == 1)
        anchors = np.flatnonzero(kinds == 2)
        first = np.searchsorted(content, anchors)
        whole = first + CHAIN <= len(content)
        anchors, first = anchors[whole], first[whole]
        if not len(anchors):
            return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 32], np.uint64) if text else np.zeros(0, np.uint64)
        out = hashes[anchors]
        for i in range(CHAIN):
            out = mix(out) + hashes[content[first + i]]
        return np.unique(mix(out) >> np.uint64(64 - 4 * DIGITS))


def _text(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two fingerprints; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _prints(batches):
    spots = Spots()
    for batch in batches:
        found = [spots.of(text or "") for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_text(f) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int32())], ["row_id", "fingerprint", "n_spots"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, fingerprint (eight hexadecimal digits per signature, sorted), n_spots, one row per input row.

    A null or empty text has the empty fingerprint; a text without spots has one signature of the
    whole text.  Equal texts have equal fingerprints.  Other columns are ignored; an empty table
    gives no rows.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, _prints, "row_id BIGINT, fingerprint STRING, n_spots INT")


def signatures(fingerprint: Column) -> Column:
    return F.regexp_extract_all(fingerprint, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def similar_prints(prints: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints with 100 * common >= percent * united.

    Equal fingerprints are compared once.  Sets are partitioned by size: bands are so wide that
    two sizes that may reach the threshold lie in the same or the next band.  Within a band only
    sets that share one of their rarest signatures meet, and only with close sizes.
    """
    sets = prints.where("n_spots > 0").groupBy("fingerprint").agg(F.first("n_spots").alias("n"))
    sets = sets.withColumn("sigs", signatures(F.col("fingerprint"))).withColumn("name", F.xxhash64("fingerprint"))
    rare = sets.select("name", "n", F.explode("sigs").alias("sig"))
    counts = rare.groupBy("sig").agg(F.count("*").alias("many"))
    order = F.array_sort(F.collect_list(F.struct("many", "sig")))
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    heads = rare.join(counts, "sig").groupBy("name", "n").agg(order.alias("ordered")).select(
        "name", "n", F.explode(F.slice("ordered", F.lit(1), head.cast("int"))).alias("item"),
    ).where("item.many > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    heads = heads.select("name", "n", F.col("item.sig").alias("sig"), band.alias("band"))
    near = heads.select(F.col("name").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") - 1)).alias("band"))
    met = heads.join(near, ["sig", "band"]).where(f"name < b and 100 * least(n, nb) >= {percent} * greatest(n, nb)")
    met = met.select(F.col("name").alias("a"), "b").distinct()
    own = sets.select("name", "fingerprint", "sigs")
    pairs = met.join(own.toDF("a", "print_a", "sigs_a"), "a").join(own.toDF("b", "print_b", "sigs_b"), "b")
    common = F.size(F.array_intersect("sigs_a", "sigs_b"))
    likeness = common / (F.size("sigs_a") + F.size("sigs_b") - common)
    return pairs.select(F.col("print_a").alias("a"), F.col("print_b").alias("b"), likeness.alias("likeness"), common.alias("c"), (F.size("sigs_a") + F.size("sigs_b")).alias("t")).where(
        f"{100 + percent} * c >= {percent} * t").drop("c", "t")


def _edited(batches):
    """Sorted texts of a range, closed by the first text of the next: each text with its successor's head."""
    spots, before = Spots(), None
    for batch in batches:
        out: list[tuple] = []
        for name, text, extra in zip(*(batch.column(i).to_pylist() for i in range(3))):
            now = spots.of(text)
            if before is not None:
                old_name, old, old_print = before
                cut = len(old) // 4
                new = old[: len(old) - cut] + text[:cut]
                new_print = spots.of(new)
                out.append((
                    old_name, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), _text(old_print), _text(new_print),
                    jaccard(old_print, new_print), jaccard(old_print, now),
                ))
            before = None if extra else (name, text, now)
        names = ["row_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        columns = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with likeness to it and to the next text.

    The edited text ends with the head of the next document's text instead of its own last
    quarter; next means by ascending id (equal ids by text, rows without id first); the first
    follows the last.  Returns row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is empty.  An only row is its own next; an empty table
    gives no rows.

    Texts move once, to ranges of ids of about ``RANGE_BYTES``.  The first text of each range is
    also sent to the end of the range before it, so that no range needs another.
    """
    lowest = -(1 << 63)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    edges = sorted(set(map(int, source.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))) if ranges > 1 else []
    bounds = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    placed = source.withColumn("range", place("id"))
    # One row per range that holds ids.
    firsts = source.select("id", place("id").alias("range")).groupBy("range").agg(F.min("id").alias("id")).orderBy("range").collect()
    if not firsts:
        return source.sparkSession.createDataFrame([], _EDITED)
    pairs = [(firsts[i]["id"], firsts[i - 1]["range"]) for i in range(len(firsts))]
    heads = source.sparkSession.createDataFrame(pairs, "id BIGINT, range INT")
    extra = source.join(F.broadcast(heads), "id").groupBy("id", "range").agg(F.min("text").alias("text"))
    rows = placed.select("range", "id", "text", F.lit(0).alias("extra")).unionByName(extra.select("range", "id", "text", F.lit(1).alias("extra")))
    ordered = rows.repartitionById(len(edges) + 1, F.col("range")).sortWithinPartitions("extra", "id", "text")
    result = map_batches(ordered.select("id", "text", "extra"), _edited, _EDITED)
    return result.withColumn("row_id", F.when(F.col("row_id") != lowest, F.col("row_id")))


_EDITED = """row_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING,
    near_edited DOUBLE, near_next DOUBLE"""
