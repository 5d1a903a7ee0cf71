"""Byte-level BPE by replaying the merges over a corpus of different words, and decoding.

Each partition collects its documents' different words (matches of the pre-tokenisation
pattern) and lays their bytes out in one array.  An inverted index leads from the rank of a
token pair to the positions where such a pair starts.  Ranks are applied in order: all
positions of a rank merge at once, and only the pairs with their neighbours change, which are
looked up and put into the index again.  Documents are then put together from their words.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.chunks import ChunkTokens
from axonframe.llm.tables import map_batches, text_rows

#: Characters of text gathered for one replay.
CORPUS_CHARS = 12_000_000

_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line per token with its bytes (base64) and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes words by the ranks of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_ranks = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [
            (ranks[token[:i]] << 32 | ranks[token[i:]], rank)
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        ]
        pairs.sort()
        self.keys = np.array([key for key, _ in pairs], np.int64)
        self.merged = np.array([rank for _, rank in pairs], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def one(self, word: bytes) -> list[int]:
        """A single word, merging its lowest rank first, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers.  Words must be different and not empty."""
        ranks = self.ranks
        rest = [word for word in words if word not in ranks]
        replayed = iter(self._replay(rest)) if rest else iter(())
        return [ranks[word].to_bytes(4, "little") if word in ranks else next(replayed) for word in words]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        token = self.bytes_ranks[np.frombuffer(b"".join(words), np.uint8)]
        size = len(token)
        after = np.arange(1, size + 1, dtype=np.int32)
        after[starts + lengths - 1] = -1
        before = np.arange(-1, size - 1, dtype=np.int32)
        before[starts] = -1
        rank_at = np.full(size, _NONE, np.int32)
        alive = np.ones(size, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: set[int] = set()

        def enter(places: np.ndarray, floor: int) -> None:
            """Look up the pairs that start at ``places`` and put them into the index."""
            places = places[after[places] >= 0]
            if not len(places):
                return
            found = self.pair_ranks(token[places], token[after[places]])
            rank_at[places] = found
            real = found != _NONE
            places, found = places[real], found[real]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            edge = np.append(0, np.flatnonzero(found[1:] != found[:-1]) + 1)
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(found)).tolist()):
                rank = int(found[a])
                if rank < floor:  # Must come before further merges of this rank: settle these words alone.
                    odd.update(np.searchsorted(starts, places[a:b], "right").tolist())
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(heap, rank)

        enter(np.arange(size, dtype=np.int32), -1)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = _sorted(np.concatenate(lists))
            at = at[rank_at[at] == rank]
            if len(at) > 1 and (after[at[:-1]] == at[1:]).any():
                chosen, taken = [], -1  # Overlapping pairs: the leftmost first.
                for place, end in zip(at.tolist(), after[at].tolist()):
                    if place != taken:
                        chosen.append(place)
                        taken = end
                at = np.array(chosen, np.int32)
            if not len(at):
                continue
            gone = after[at]
            # Leftmost first: between two neighbouring merges a pair of a lower rank may show up.
            near = np.flatnonzero(after[gone[:-1]] == at[1:])
            if len(near):
                low = near[self.pair_ranks(np.full(len(near), rank, np.int32), token[at[near + 1]]) < rank]
                odd.update(np.searchsorted(starts, at[low], "right").tolist())
            token[at] = rank
            alive[gone] = False
            rank_at[gone] = _NONE
            rank_at[at] = _NONE
            follow = after[gone]
            after[at] = follow
            linked = follow >= 0
            before[follow[linked]] = at[linked]
            left = before[at]
            left = left[left >= 0]
            rank_at[left] = _NONE
            enter(_sorted(np.concatenate([at, left])), rank)
        raw = token[alive].astype("<i4").tobytes()
        stops = np.cumsum(4 * np.add.reduceat(alive.astype(np.int64), starts)).tolist()
        out = [raw[a:b] for a, b in zip([0, *stops], stops)]
        for i in odd:
            out[i - 1] = np.array(self.one(words[i - 1]), "<i4").tobytes()
        return out


def _sorted(places: np.ndarray) -> np.ndarray:
    """Different places, ascending."""
    places.sort()
    fresh = np.empty(len(places), bool)
    fresh[:1] = True
    np.not_equal(places[1:], places[:-1], out=fresh[1:])
    return places[fresh]


class ChunkEncoder:
    """Chunks of text to packed ids, through their different words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.find = MergeReplay(ranks), regex.compile(pattern).findall

    def __call__(self, chunks: list[str]) -> Iterator[bytes]:
        words = [self.find(chunk) for chunk in chunks]
        different = list({word for found in words for word in found})
        packed = dict(zip(different, self.replay.words([word.encode() for word in different])))
        del different
        return (packed[found[0]] if len(found) == 1 else b"".join([packed[word] for word in found]) for found in words)


def _lists(packed: list[bytes]) -> pa.Array:
    stops = np.cumsum([0, *(len(p) // 4 for p in packed)])
    if stops[-1] >= 1 << 31:
        raise ValueError("too many tokens in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _encoder(path: str, pattern: str):
    def run(batches):
        tokens = ChunkTokens(ChunkEncoder(read_ranks(path), pattern))
        held, size = [], 0

        def done():
            texts = [text for _, own in held for text in own]
            packed = iter(tokens.of(texts))
            for ids, own in held:
                yield pa.RecordBatch.from_arrays([ids, _lists([next(packed) for _ in own])], ["row_id", "ids"])

        for batch in batches:
            held.append((batch.column(0), text_rows(batch.column(1))))
            size += sum(map(len, held[-1][1]))
            if size > CORPUS_CHARS:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    return run


class Vocabulary:
    """The bytes of all tokens in one buffer; ids are decoded by copying ranges of it."""

    def __init__(self, ranks: dict[bytes, int]):
        ordered = sorted(ranks.items(), key=lambda item: item[1])
        self.buffer = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8)
        lengths = np.array([len(token) for token, _ in ordered], np.int64)
        names = np.array([rank for _, rank in ordered], np.int64)
        self.lengths = np.full(names[-1] + 1, -1, np.int64)
        self.starts = np.zeros(names[-1] + 1, np.int64)
        self.lengths[names] = lengths
        self.starts[names] = np.cumsum(lengths) - lengths

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joined bytes of the ids, and the number of bytes of each."""
        known = (ids >= 0) & (ids < len(self.lengths))
        lengths = self.lengths[np.where(known, ids, 0)]
        if not known.all() or (lengths < 0).any():
            raise KeyError(f"id {ids[~known | (lengths < 0)][0]} is not in the rank file")
        ends = np.cumsum(lengths)
        # The place of each output byte in the buffer: its token's start plus its number in the token.
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.buffer[at].tobytes(), lengths


#: Ids decoded at once.
DECODED = 1 << 18


def _decoder(path: str):
    def run(batches):
        vocabulary = Vocabulary(read_ranks(path))
        for batch in batches:
            ids = batch.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            parts, sizes = [], [np.zeros(1, np.int64)]
            for a in range(0, len(flat), DECODED):
                raw, lengths = vocabulary.decode(flat[a : a + DECODED])
                parts.append(raw)
                sizes.append(lengths)
            ends = np.cumsum(np.concatenate(sizes))  # Bytes before each id.
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            stops = ends[np.append(0, np.cumsum(counts))].tolist()
            raw, present = b"".join(parts), ids.is_valid().to_pylist()
            texts = [raw[a:b] if some else None for a, b, some in zip(stops, stops[1:], present)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.binary())], ["row_id", "ids", "decoded"])

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts: row_id, ids, one row per input row, without a shuffle.

    ``path`` is a rank file that executors can read, with all 256 single bytes; ``pattern``
    splits texts into words, and must not join a non-white-space character with white space
    after it.  A null or empty text has no ids.  Repeated rows and null ids are kept; other
    columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, _encoder(path, pattern), "row_id BIGINT, ids ARRAY<INT>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(row_id, ids) to row_id, ids, decoded (bytes).  Null ids decode to null; an id that is not in the file fails."""
    return map_batches(encoded.select("row_id", "ids"), _decoder(path), "row_id BIGINT, ids ARRAY<INT>, decoded BINARY")
