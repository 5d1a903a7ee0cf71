import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from axonframe.llm.bpe import MergeReplay, bpe_decode, bpe_encode, read_ranks
from axonframe.llm.packing import pack

RANKS, FILE = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(2)
    odd = ["  two", "a  b", "a \n b", "a\n b", "tab\t x", " ", "   ", "x   ", "　 wide  nbsp  x", "it's we'll I'd", "1234 567", "<|endoftext|> end", "aaaaaaaaaaaaaaaaa", "\x85 a", "\x1c b"]
    odd += ["".join(rng.choice(" \n\tab'1é!") for _ in range(60)) for _ in range(300)]
    return [*corpus, *odd]


def test_ids_equal_the_library(make_docs, texts):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    found = {r.row_id: r for r in bpe_decode(bpe_encode(make_docs(texts), RANKS, PATTERN), RANKS).collect()}
    for i, text in enumerate(texts):
        assert found[i].ids == library.encode_ordinary(text or ""), repr(text)
        assert bytes(found[i].decoded) == (text or "").encode()


def test_replay_equals_word_by_word():
    """Also for vocabularies in which a merge can make a pair of a lower rank."""
    rng = random.Random(4)
    for _ in range(20):
        ranks = {bytes([i]): i for i in range(256)}
        for rank in range(256, 330):
            ranks.setdefault("".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode(), rank)
        words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25))).encode() for _ in range(200)})
        replay = MergeReplay(ranks)
        for word, ids in zip(words, replay.words(words)):
            assert np.frombuffer(ids, "<i4").tolist() == ([ranks[word]] if word in ranks else replay.one(word)), word


def test_odd_rows(make_docs):
    docs = make_docs([(None, "a b"), (1, None), (1, None)]).withColumn("ids", F.lit(1)).withColumn("row_id", F.lit("x"))
    rows = bpe_encode(docs, RANKS, PATTERN).collect()
    assert sorted((str(r.row_id), len(r.ids)) for r in rows) == [("1", 0), ("1", 0), ("None", 2)]
    assert bpe_encode(make_docs([]), RANKS, PATTERN).count() == 0
    assert pack(make_docs([]), FILE).count() == 0
    assert sorted((str(r.doc_id), r.length) for r in pack(docs.withColumn("part", F.lit(3)), FILE).collect()) == [("1", 1), ("1", 1), ("None", 3)]


@pytest.mark.parametrize("length", [1024, 16])
def test_packing(make_docs, texts, length):
    tokenizer = Tokenizer.from_file(FILE)
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(make_docs(texts), FILE, length).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for name, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.continued) == (at, len(want[name]), at > 0)
            assert r.ids_crc32 == zlib.crc32(want[name][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[name])
    for number, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))

