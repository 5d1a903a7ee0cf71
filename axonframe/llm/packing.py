"""Packing of token streams into sequences of equal length: concatenate and cut.

Pass one tokenises every document once and writes its ids with the running position inside its
partition.  The partitions' totals, one number each, are summed up to global offsets.  Pass two
cuts every document at multiples of the sequence length, where it lies; nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from axonframe.llm.chunks import ChunkTokens
from axonframe.llm.tables import Scratch, map_batches, text_rows

#: Chunks joined to one text for the tokeniser.
JOINED = 2_000

#: Fixed value: the pattern that byte-level files of this kind split texts with.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level files write bytes with: printable bytes as they are, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FileTokenizer:
    """Packs the ids that a tokenizer file gives to each chunk, as little-endian 32-bit numbers.

    Byte-level BPE files whose ids ascend in the order of their merges are read into a faster
    encoder with the same result; other files, and chunks that hold an added token's name, go
    through the tokenizers library.  Chunks that start with a space and end without white space
    tokenise alike alone and in a row, so many are encoded as one text and cut by their bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.library, self.fast = path, None, None
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, split = content["model"], content.get("pre_tokenizer") or {}
        self.added = [token["content"] for token in content.get("added_tokens", [])]
        vocabulary, merges = model.get("vocab", {}), model.get("merges", [])
        made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in merges]
        plain = not content.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if (
            model.get("type") == "BPE" and plain and made == sorted(set(made)) and -1 not in made
            and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        ):
            letters = _byte_letters()
            ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items() if token not in self.added}
            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.sizes[list(ranks.values())] = list(map(len, ranks))

    def _library(self, chunks: list[str]) -> list[bytes]:
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._library(chunks)
        found: list[bytes | None] = [None] * len(chunks)
        for at in range(0, len(chunks), JOINED):
            group = chunks[at : at + JOINED]
            text = "".join(group)
            if any(name in text for name in self.added):
                special = [i for i, chunk in enumerate(group) if any(name in chunk for name in self.added)]
                for i, ids in zip(special, self._library([group[i] for i in special])):
                    found[at + i] = ids
            row = [i for i, chunk in enumerate(group) if found[at + i] is None and chunk[:1] == " " and not chunk[-1].isspace()]
            parts = [group[i] for i in row]
            sizes = list(map(len, parts)) if text.isascii() else [len(part.encode()) for part in parts]
            ids = np.array(self.fast.encode_ordinary("".join(parts)), "<u4")
            raw, a = ids.tobytes(), 0
            for i, b in zip(row, (4 * np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 4).tolist()):
                found[at + i] = raw[a:b]
                a = b
            for i, chunk in enumerate(group):
                if found[at + i] is None:
                    found[at + i] = np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()
        return found


def _tokens(path: str, end_id: int):
    def run(batches):
        tokens = ChunkTokens(FileTokenizer(path))
        part, position = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            # Packed to 16 bits where the ids allow it.
            ids = [np.frombuffer(found + end, "<u4") for found in tokens.of(text_rows(batch.column(1)))]
            lengths = np.array([len(i) for i in ids], np.int64)
            starts = position + np.cumsum(lengths) - lengths
            position += int(lengths.sum())
            small = [i.astype("<u2").tobytes() if len(i) and i.max() < 65536 else b"" for i in ids]
            wide = [b"" if s else i.tobytes() for i, s in zip(ids, small)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(lengths),
                pa.array(small, pa.binary()), pa.array(wide, pa.binary()),
            ], ["doc_id", "part", "first", "n", "ids16", "ids32"])

    return run


def _pieces(length: int):
    def run(batches):
        for batch in batches:
            n, begin = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            small, wide = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            rows, starts, stops, crcs = [], [], [], []
            for i in range(len(n)):
                ids = np.frombuffer(small[i], "<u2").astype("<u4") if small[i] else np.frombuffer(wide[i], "<u4")
                raw = memoryview(ids.tobytes())
                a = 0
                while a < n[i]:
                    b = min(int(n[i]), a + length - int(begin[i] + a) % length)
                    rows.append(i)
                    starts.append(a)
                    stops.append(b)
                    crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
                    a = b
            rows, starts, stops = np.array(rows, np.int64), np.array(starts, np.int64), np.array(stops, np.int64)
            place = begin[rows] + starts if len(rows) else starts
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(starts), pa.array(stops - starts), pa.array(np.array(crcs, np.int64)),
                pa.array(n[rows] if len(rows) else starts), pa.array(place // length), pa.array(place % length), pa.array(starts > 0),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continued"])

    return run


def pack(
    docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens; only the last sequence may be shorter.

    ``path``: a tokenizer file that executors can read, whose words never join a non-white-space
    character with white space after it.  Every document is its ids and ``end_id``, so an empty
    or null text is one token.  Returns per piece: doc_id, start (ids of the document before it),
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id, offset (in the sequence), continued (the document began in an earlier sequence).
    Documents follow one another as their partitions are read.  Repeated rows and null ids are
    packed like others; other columns are ignored; an empty table gives no pieces.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = scratch.write(
        map_batches(source, _tokens(path, end_id), "doc_id BIGINT, part INT, first BIGINT, n BIGINT, ids16 BINARY, ids32 BINARY"), "tokens"
    )
    # One row per partition of pass one.
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", "n", (F.col("base") + F.col("first")).alias("begin"), "ids16", "ids32")
    return map_batches(
        placed, _pieces(length),
        "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, continued BOOLEAN",
    )
