"""The registered queries on the smallest tables, against brute force or their SQL, and the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from axonframe.llm.bpe import read_ranks
from axonframe.llm.queries import OP6_EDITED_SQL, QUERIES, SQL

from test_ngram_join import brute as components
from test_pii import brute as spans
from test_substring_dedup import brute as windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def sql(text):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = connection.execute(text)
    return [d[0] for d in found.description], sorted(found.fetchall())


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and {*QUERIES, "pipeline"} <= set(entry.queries())


def test_op1(spark, documents):
    found = {tuple(r) for r in QUERIES["op1_ngram_join"](spark, FOLDER).collect()}
    assert found == components(*zip(*documents))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    columns, rows = sql(SQL[name])
    assert sorted(tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect()) == rows and rows


def test_op3(spark, documents):
    found = {r.doc_id: r.base_sha256 for r in QUERIES["op3_pii"](spark, FOLDER).collect()}
    assert found == {i: hashlib.sha256(spans(t).encode()).hexdigest() for i, t in documents}


def test_op6(spark):
    columns, rows = sql(OP6_EDITED_SQL)
    assert sorted(tuple(r) for r in QUERIES["op6_spot_signatures"](spark, FOLDER).select(*columns).collect()) == rows


def test_op7(spark, documents):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_substring_dedup"](spark, FOLDER).collect()}
    assert found == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in windows(documents).items()}


@pytest.mark.parametrize("name", ["op4_license_scan", "op8_toxicity"])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_op5(spark, documents):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = {}
    for r in QUERIES["op5_packing"](spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_op9(spark, documents):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(vocabulary("byte_bpe_50k.tiktoken")), special_tokens={})
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_byte_bpe"](spark, FOLDER).collect()}
    for i, text in documents:
        ids = library.encode_ordinary(text or "")
        assert found[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


TEXT_A = "alpha beta gamma delta epsilon zeta eta theta"
TEXT_B = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_near_copies_keeps_a_row_of_each_group(spark, make_docs):
    def kept(rows):
        docs = corpus_pipeline.drop_near_copies(spark, make_docs(rows).withColumn("key", F.lit("extra")), FOLDER)
        assert docs.columns[-1] == "key"
        return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)

    found = kept([(3, TEXT_A), (7, TEXT_A), (7, TEXT_B), (8, TEXT_B + " x")])
    assert found == [(3, TEXT_A), (7, TEXT_B)]
    assert kept([(5, TEXT_A)] * 40 + [(None, TEXT_A), (None, TEXT_B), (None, TEXT_B), (9, TEXT_B + " x")]) == [(5, TEXT_A), (9, TEXT_B + " x")]
    assert kept([(None, TEXT_A)] * 3) == [(None, TEXT_A)]
    odd = [(1, None), (1, None), (2, ""), (2, ""), (None, " \n")]
    assert kept(odd) == sorted(odd, key=str) and kept([]) == []


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, make_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, None), (1, TEXT_A), (1, TEXT_A), (None, TEXT_B), (None, None), (4, ""), (5, "mail a.b@c.org now"), (6, "word " * 3000)]
    docs = stage(spark, make_docs(rows).withColumn("id", F.lit("clash")), FOLDER)
    found = sorted((str(r.doc_id) for r in docs.collect()))
    if name == "packing":
        assert set(found) == {"1", "None", "4", "5", "6"} and docs.agg(F.sum("length")).first()[0] > 3000
    else:
        # Only the repeated row is a copy.
        assert found == sorted(["1"] * (2 if name == "near_copies" else 3) + ["None", "None", "4", "5", "6"])
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage(spark, make_docs([]), FOLDER).count() == 0


def test_stages(spark, tmp_path, documents):
    docs, columns = spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    texts = dict(documents)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == before.where("n_chars <> length(text)").count()
        if name == "near_copies":
            rows = before.select("doc_id", "text").collect()
            kept = {i for i, _, c in components(*zip(*[tuple(r) for r in rows])) if i == c}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
        if name == "repeated_passages":
            found = windows([tuple(r) for r in before.select("doc_id", "text").collect()])
            assert {r.doc_id: r.text for r in docs.collect()} == {i: kept if gone else texts[i] for i, (_, gone, kept) in found.items()}
        if name == "personal_data":
            assert all(spans(r.text) == "" for r in docs.select("text").collect())
    assert docs.count() == corpus_pipeline.run(spark, FOLDER).count() > 0
