"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram of three letters is bound from them: the
first letter's vector permuted twice, the second's once, multiplied with the third's.  A text's
profile bundles (sums) the vectors of its n-grams; a language's prototype bundles the profiles of
its texts, each at unit length.  A text has the language whose prototype has the largest cosine
with its profile.

Letters are Unicode letters in lower case; what stands between two words is one more letter, which
never is the middle of an n-gram.  Vectors are kept as bits (1 for -1), so that binding is an
exclusive or.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.tables import map_batches, text_rows
from axonframe.llm.words import mix

#: Components of a vector (a multiple of 64), and the seed of the letters' vectors.
DIMS, SEED = 1024, 11

#: Languages a model may have.  More distinct values are refused: they would be no language column.
MAX_LANGUAGES = 4096

#: Characters and texts bundled at once, and n-grams per product.
PIECE, TEXTS, GRAMS = 1 << 20, 1024, 4096

#: Unit profiles are summed as whole numbers of this size, so that sums do not depend on their order.
UNIT = 1 << 20

#: Partial sums of a language are added by this many tasks first.
SALTS = 64

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Each code point itself if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


@cache
def _letter_bits(letter: int, dims: int, seed: int) -> tuple[bytes, bytes, bytes]:
    """The letter's vector permuted (rotated) by 2, 1 and 0 places, as packed bits."""
    at = np.arange(dims // 64, dtype=np.uint64) + np.uint64((letter << 16 | seed) + 1) * np.uint64(dims)
    bits = np.unpackbits(mix(mix(at)).view(np.uint8))
    return tuple(np.packbits(np.roll(bits, shift)).tobytes() for shift in (2, 1, 0))


def gram_bits(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Packed vectors of n-grams, given as three letters of 21 bits each."""
    out = None
    for place, shift in enumerate((42, 21, 0)):
        letters, at = np.unique((grams >> np.uint64(shift)) & np.uint64(0x1FFFFF), return_inverse=True)
        own = np.frombuffer(b"".join(_letter_bits(int(c), dims, seed)[place] for c in letters), np.uint64).reshape(len(letters), -1)[at]
        out = own if out is None else out ^ own
    return out


def _segments(text: str) -> Iterator[str]:
    """Pieces of a text with one character of context on either side."""
    text = text.lower()
    for start in range(0, len(text), PIECE):
        stop = start + PIECE
        yield (text[start - 1] if start else "\0") + text[start:stop] + (text[stop : stop + 1] or "\0")


def _add(out: np.ndarray, grams_of: np.ndarray, segments: list[tuple[int, str]], dims: int, seed: int) -> None:
    """Add the n-gram vectors of the segments to the rows of ``out`` they belong to."""
    sizes = np.array([len(s) for _, s in segments])
    letters = _letters()[np.frombuffer("".join(s for _, s in segments).encode("utf-32-le"), np.uint32)].astype(np.uint64)
    middle = letters != 0
    ends = np.cumsum(sizes)
    middle[ends - sizes] = False
    middle[ends - 1] = False
    at = np.flatnonzero(middle)
    if not len(at):
        return
    owner = np.repeat([row for row, _ in segments], sizes)[at]
    grams, which = np.unique(letters[at - 1] << np.uint64(42) | letters[at] << np.uint64(21) | letters[at + 1], return_inverse=True)
    pairs, counts = np.unique(owner * len(grams) + which, return_counts=True)
    owner, which = np.divmod(pairs, len(grams))
    np.add.at(grams_of, owner, counts)
    # N-grams of many texts first, then those of neighbouring texts: a product's rows are the texts that hold any of them.
    texts = np.bincount(which)
    first = np.full(len(grams), len(out))
    np.minimum.at(first, which, owner)
    order = np.lexsort((first, -np.log2(texts).astype(np.int64)))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    which = place[which]
    by_block = np.argsort(which // GRAMS, kind="stable")
    owner, which, counts = owner[by_block], which[by_block], counts[by_block]
    edges = np.searchsorted(which // GRAMS, np.arange(-(-len(grams) // GRAMS) + 1))
    for block, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        own = order[block * GRAMS : (block + 1) * GRAMS]
        bits = np.unpackbits(gram_bits(grams[own], dims, seed).view(np.uint8), axis=1).astype(np.float32)
        rows, row = np.unique(owner[a:b], return_inverse=True)
        table = np.zeros((len(rows), len(own)), np.float32)
        table[row, which[a:b] - block * GRAMS] = counts[a:b]
        # Counts of a piece are below 2^24, so the products are exact.
        out[rows] += table.sum(axis=1, dtype=np.float64)[:, None] - 2.0 * (table @ bits)


def bundles(texts: list[str], dims: int = DIMS, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Profiles (sums of n-gram vectors) and numbers of n-grams of texts, some texts at a time, in order."""
    def done():
        out, grams = np.zeros((len(held), dims)), np.zeros(len(held), np.int64)
        pending, size = [], 0
        for row, text in enumerate(held):
            for segment in _segments(text):
                pending.append((row, segment))
                size += len(segment)
                if size >= PIECE:
                    _add(out, grams, pending, dims, seed)
                    pending, size = [], 0
        if pending:
            _add(out, grams, pending, dims, seed)
        return out, grams

    held: list[str] = []
    chars = 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= PIECE or len(held) == TEXTS:
            yield done()
            held, chars = [], 0
    if held:
        yield done()


def unit(profiles: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((profiles * profiles).sum(axis=1))
    return profiles / np.where(lengths > 0, lengths, 1.0)[:, None]


_SUMS = "lang STRING, salt INT, sums BINARY"


def _sums(found: dict) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k].tobytes() for k in keys], pa.binary())],
        ["lang", "salt", "sums"],
    )


def _learn(dims: int, seed: int):
    """(lang, text) to partial sums of unit profiles per language."""
    def run(batches):
        salt = TaskContext.get().partitionId() % SALTS
        found: dict = {}
        for batch in batches:
            langs, row = batch.column(0).to_pylist(), 0
            for profiles, grams in bundles(text_rows(batch.column(1)), dims, seed):
                whole = np.rint(UNIT * unit(profiles)).astype(np.int64)
                names = langs[row : row + len(whole)]
                row += len(whole)
                for name in set(n for n, some in zip(names, grams) if some):
                    own = whole[[n == name for n in names]].sum(axis=0)
                    found[name, salt] = found[name, salt] + own if (name, salt) in found else own
                if len(found) > 256:
                    yield _sums(found)
                    found = {}
        if found:
            yield _sums(found)

    return run


def _added(batches):
    """Sums of partial sums, sorted by (lang, salt)."""
    key, total = None, None
    for batch in batches:
        for lang, salt, sums in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(sums, np.int64)
            if (lang, salt) != key:
                if key is not None:
                    yield _sums({key: total})
                key, total = (lang, salt), np.zeros(len(own), np.int64)
            total += own
    if key is not None:
        yield _sums({key: total})


def prototypes(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = DIMS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language: the exact sum of its texts' unit profiles, over all rows.

    Rows without language or text teach nothing, nor do texts without letters.  More than
    ``MAX_LANGUAGES`` languages are refused, so the model has at most 32 MB.  An empty table gives
    no language.
    """
    source = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = map_batches(source, _learn(dims, seed), _SUMS)
    for salt in (F.col("salt"), F.lit(0)):
        sums = sums.withColumn("salt", salt).repartition("lang", "salt").sortWithinPartitions("lang", "salt")
        sums = map_batches(sums, _added, _SUMS)
    found = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang_col}")
    return {r["lang"]: np.frombuffer(bytes(r["sums"]), np.int64) for r in sorted(found, key=lambda r: r["lang"].encode())}


def _predict(names: list[str], model, dims: int, seed: int):
    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for profiles, grams in bundles(text_rows(batch.column(1)), dims, seed):
                if not names:
                    langs += [UNKNOWN] * len(grams)
                    scores += [0.0] * len(grams)
                    continue
                near = unit(profiles) @ model.value.T
                best = near.argmax(axis=1)
                langs += [names[b] if some else UNKNOWN for b, some in zip(best.tolist(), grams.tolist())]
                scores += np.where(grams > 0, near.max(axis=1).clip(0.0, 1.0), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row_id", "lang_pred", "score"])

    return run


def identify(
    docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, seed: int = SEED
) -> DataFrame:
    """Language of every whole text: row_id, lang_pred, score (the cosine, 0 to 1), one row per input row, no shuffle.

    ``model`` comes from ``prototypes`` with equal ``dims`` and ``seed``.  A null or empty text, one
    without letters, and any text if the model is empty, get ``und`` and 0.  Equal cosines go to
    the smaller name.  Repeated rows and null ids are kept; only the two columns are read; an
    empty table gives no rows.
    """
    names = list(model)
    vectors = unit(np.array([model[n] for n in names], np.float64)) if names else None
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    source = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, _predict(names, shared, dims, seed), "row_id BIGINT, lang_pred STRING, score DOUBLE")


def held_out(id_value: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the checksum of an id (as text) falls into the part kept for testing; false without id."""
    return F.coalesce(F.crc32(id_value.cast("string")) % parts == part, F.lit(False))
