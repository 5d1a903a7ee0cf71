"""Removal of repeated word windows, with a count-min prefilter.

1. Every window of 20 words chooses the smallest hash among its runs of 10 words.  Equal windows
   choose equal runs, at different places, so a window that occurs twice has a run counted at
   least twice.  About one run in six is chosen by any window; only these are counted.
2. Each partition counts its runs in a count-min sketch (two rows, counters up to "two or
   more").  The sketches travel as sorted lists of their counters, are merged chunk by chunk,
   and the merged sketch shrinks to one bit per counter: seen twice or more.  Its size follows
   the words of the corpus up to ``MAX_BITS`` per row, 128 MB for both rows.
3. A second pass groups exactly the windows whose run is estimated repeated, and finds the
   smallest document of each.  Collisions add windows to this pass and never lose one.
4. Each document gets the list of the windows it owns, and removes the words of all other
   estimated windows; further occurrences inside the document are not owned.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.llm.tables import map_batches, text_pieces, utf8_rows
from axonframe.llm.words import WordHashes, Words, mix

#: Counters of a sketch row are kept and merged in chunks of 2^16.
CHUNK_BITS = 16
MIN_BITS, MAX_BITS = 20, 29
ROWS = 2

#: Stands for the id of a row without id: later than all others.
NO_ID = (1 << 63) - 1


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while 2 * size <= width:
        out, size = pick(out[: len(out) - size], out[size:]), 2 * size
    gap = width - size
    return pick(out[: len(out) - gap], out[gap:]) if gap else out


class Windows:
    """All windows of several texts: where they start, their hashes, and the run each has chosen."""

    def __init__(self, words: Words, length: int):
        half = max(1, length // 2)
        width = length - half + 1
        runs = mix(words.runs(half))
        hashes = words.runs(length)
        chosen = sliding(runs, width, np.minimum)
        inside = np.zeros(len(words.hashes) + 1, np.int32)
        long = words.counts >= length
        np.add.at(inside, words.begins[long], 1)
        np.add.at(inside, words.stops[long] - length + 1, -1)
        valid = np.cumsum(inside[:-1])[: len(hashes)] > 0
        self.starts = np.flatnonzero(valid)
        self.hashes, self.chosen = hashes[self.starts], chosen[self.starts]
        if not len(self.starts):
            self.counted = runs[:0]
            return
        # A run is counted if a window that holds it has chosen its hash.
        ends = np.zeros(width - 1, np.uint64)
        reach = sliding(np.concatenate([ends, np.where(valid, chosen, np.uint64(0)), ends]), width, np.maximum)
        self.counted = runs[reach == runs]


def _counters(runs: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(runs + np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(length: int, bits: int):
    """Partition sketch: (row, chunk) with sorted counters seen once and seen more often."""
    flush = 1 << 21

    def rows(found):
        runs = np.concatenate(found)
        for row in range(ROWS):
            at, seen = np.unique(_counters(runs, row, bits), return_counts=True)
            chunk = at >> CHUNK_BITS
            edge = np.append(0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1)
            low = (at & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
            stops = np.append(edge[1:], len(at))
            once, more = [], []
            for a, b in zip(edge.tolist(), stops.tolist()):
                many = seen[a:b] > 1
                once.append(low[a:b][~many].tobytes())
                more.append(low[a:b][many].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(edge), row, np.int32)), pa.array(chunk[edge].astype(np.int32)), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                ["row", "chunk", "once", "more"],
            )

    def run(batches):
        hashes, found, size = WordHashes(), [], 0
        for batch in batches:
            for texts in text_pieces(batch.column(0)):
                counted = Windows(Words(utf8_rows(texts), hashes), length).counted
                found.append(counted)
                size += len(counted)
                if size > flush:
                    yield from rows(found)
                    found, size = [], 0
        if size:
            yield from rows(found)

    return run


def _merged(batches):
    """Sorted partition sketches to one bit per counter of each chunk: seen twice or more."""
    width, place, counts = 1 << CHUNK_BITS, None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())],
            ["row", "chunk", "repeated"],
        )

    for batch in batches:
        for row, chunk, once, more in zip(*(c.to_pylist() for c in batch.columns)):
            if place != (row, chunk):
                if place is not None:
                    yield done()
                place, counts = (row, chunk), np.zeros(width, np.uint8)
            at = np.frombuffer(once, np.uint16)
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[np.frombuffer(more, np.uint16)] = 2
    if place is not None:
        yield done()


def _repeated(windows: Windows, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    """Which windows are estimated to occur twice or more."""
    out = np.ones(len(windows.chosen), bool)
    for row, flags in enumerate(sketch):
        at = _counters(windows.chosen, row, bits)
        out &= (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _estimated(texts: pa.Array, hashes: WordHashes, length: int, bits: int, sketch):
    """The words of texts, their windows, and those estimated repeated as (text, their places among the windows)."""
    words = Words(utf8_rows(texts), hashes)
    windows = Windows(words, length)
    at = np.flatnonzero(_repeated(windows, sketch.value, bits))
    text = words.text_of(windows.starts[at])
    edge = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1) if len(text) else np.zeros(0, np.int64)
    return words, windows, list(zip(text[edge].tolist(), np.split(at, edge[1:])))


def _occurrences(length: int, bits: int, sketch):
    """(window, id) of estimated windows, once per document."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, row = batch.column(1).to_numpy(), 0
            for texts in text_pieces(batch.column(0)):
                _, windows, repeated = _estimated(texts, hashes, length, bits, sketch)
                parts = [np.unique(windows.hashes[places]) for _, places in repeated]
                owner = np.repeat(ids[[row + i for i, _ in repeated]], [len(p) for p in parts]) if parts else ids[:0]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(owner)], ["window", "id"])

    return run


def _removed(length: int, bits: int, sketch):
    """(text, id, owned windows, rest) to the kept words and how many went."""
    def piece(texts, owned, hashes):
        words, windows, repeated = _estimated(texts, hashes, length, bits, sketch)
        cover = np.zeros(len(words.hashes) + 1, np.int32)
        for i, places in repeated:
            found = windows.hashes[places]
            kept = np.zeros(len(found), bool)
            kept[np.unique(found, return_index=True)[1]] = True
            own = owned[i].values
            if own is None or not len(own):
                kept[:] = False
            else:
                own = np.sort(own.to_numpy().view(np.uint64))
                kept &= own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
            starts = windows.starts[places[~kept]]
            cover[starts] += 1
            cover[starts + length] -= 1
        keep = np.cumsum(cover[:-1]) == 0
        gone = np.diff(np.append(0, np.append(0, np.cumsum(~keep))[words.stops]))
        flags = keep.tolist()
        new = []
        for a, b, n in zip(words.begins.tolist(), words.stops.tolist(), gone.tolist()):
            own = words.words[a:b]
            new.append(b" ".join(compress(own, flags[a:b]) if n else own))
        return words.counts, gone, pa.array(new, pa.binary()).cast(pa.string())

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            row = 0
            for texts in text_pieces(batch.column(0)):
                part = batch.slice(row, len(texts))
                row += len(texts)
                counts, gone, kept = piece(texts, part.column(2), hashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(counts), pa.array(gone), kept, texts, part.column(3)], ["row_id", "n_words", "n_removed", "kept_text", "text", "rest"]
                )

    return run


def sketch_bits(docs: DataFrame, text_col: str) -> int:
    """Counters per row (as a power of two): three per chosen run, within MIN_BITS and MAX_BITS."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, (size // 12).bit_length()))


def merged_sketch(texts: DataFrame, length: int, bits: int):
    """Broadcast bit maps, one per sketch row, of the counters that reached two."""
    partial = map_batches(texts, _sketch(length, bits), "row INT, chunk INT, once BINARY, more BINARY")
    merged = map_batches(
        partial.repartition("row", "chunk").sortWithinPartitions("row", "chunk"), _merged, "row INT, chunk INT, repeated BINARY"
    )
    flags = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    chunk_bytes = 1 << (CHUNK_BITS - 3)
    for found in merged.toLocalIterator():
        at = found["chunk"] * chunk_bytes
        flags[found["row"]][at : at + chunk_bytes] = np.frombuffer(bytes(found["repeated"]), np.uint8)
    return texts.sparkSession.sparkContext.broadcast(flags)


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove words covered by a window of ``length`` words that also starts earlier in the corpus.

    Earlier means a smaller id, or the same document and an earlier start.  Windows are judged
    on the input.  Words are runs of non-white-space (ASCII) characters, unchanged.  Returns one
    row per input row: row_id, n_words, n_removed, kept_text (kept words joined by one space),
    text (as it was) and rest, a struct of the row's other columns.  A null text has no words; texts
    shorter than a window lose nothing.  Rows that share an id keep what only they share; rows
    without id come after all others and count as one document.  An empty table gives no rows.
    Hashes have 64 bits.
    """
    others = [F.col(c) for c in docs.columns if c != text_col]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    source = docs.select(
        F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), rest.alias("rest")
    )
    bits = sketch_bits(source, "text")
    sketch = merged_sketch(source.select("text"), length, bits)
    seen = map_batches(source.select("text", "id"), _occurrences(length, bits, sketch), "window BIGINT, id BIGINT")
    owners = seen.groupBy("window").agg(F.min("id").alias("id"))
    owned = owners.groupBy("id").agg(F.collect_list("window").alias("owned"))
    joined = source.join(owned.hint("shuffle_hash"), "id", "left").select("text", "id", "owned", "rest")
    schema = T.StructType([
        T.StructField("row_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()), T.StructField("text", T.StringType()), joined.schema["rest"],
    ])
    result = map_batches(joined, _removed(length, bits, sketch), schema)
    return result.withColumn("row_id", F.when(F.col("row_id") != NO_ID, F.col("row_id")))
