import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import axonframe.llm.langid as langid
from axonframe.llm.langid import bundles, held_out, identify, prototypes
from axonframe.llm.queries import QUERIES
from axonframe.llm.words import mix

TEXTS = ["The cat, the HAT.", "a", "", "1 2 3 --", "Straße über Öl", "東京 都\n東", "x" * 50, "İstanbul ǅ 😀 end", "one two " * 40, "'s  s'"]


def letter(code, dims=128, seed=11):
    at = np.arange(dims // 64, dtype=np.uint64) + np.uint64((code << 16 | seed) + 1) * np.uint64(dims)
    return 1 - 2 * np.unpackbits(mix(mix(at)).view(np.uint8)).astype(int)


def profile(text, dims=128):
    codes = [0] + [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0]
    total, n = np.zeros(dims, int), 0
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
            n += 1
    return total, n


@pytest.mark.parametrize("piece,texts,grams", [(1 << 20, 1024, 4096), (7, 2, 5), (1, 3, 1)])
def test_profiles_are_sums_of_bound_letters(monkeypatch, piece, texts, grams):
    for name, value in (("PIECE", piece), ("TEXTS", texts), ("GRAMS", grams)):
        monkeypatch.setattr(langid, name, value)
    found = list(bundles(TEXTS, 128))
    sums, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    for text, own, n in zip(TEXTS, sums, counts):
        want = profile(text)
        assert (own == want[0]).all() and n == want[1]


def test_model_and_predictions(spark, make_docs, corpus):
    rng = random.Random(5)
    words = {"aa": "aba abba baba", "bb": "xyz zyx yxz", "": "mno onm"}
    rows = [(i, " ".join(rng.choice(words[n].split()) for _ in range(rng.randrange(1, 30))), n) for i, n in enumerate(["aa", "bb", ""] * 30)]
    rows += [(900, None, "aa"), (901, "12 3", "bb"), (902, "aba", None), (None, "zyx", None), (5, "xyz", "aa"), (5, "xyz", "aa")]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").repartition(6)
    frame = frame.withColumn("row_id", F.lit("x")).withColumn("score", F.lit(2)).withColumn("salt", F.lit(1))
    model = prototypes(frame, dims=128)
    assert list(model) == ["", "aa", "bb"]
    want = {}
    for _, text, name in rows:
        if name is not None and text is not None:
            total, n = profile(text)
            if n:
                want[name] = want.get(name, 0) + np.rint((1 << 20) * total / np.sqrt((total * total).sum()))
    assert all((model[n] == want[n]).all() for n in want)
    asked = [*rows, *((2000 + i, t, None) for i, t in enumerate([*TEXTS, None]))]
    found = identify(spark.createDataFrame(asked, "doc_id BIGINT, text STRING, lang STRING").repartition(3), model, dims=128).collect()
    expected = []
    for i, text, _ in asked:
        total, n = profile(text or "")
        if not n:
            expected.append((i, "und", 0.0))
            continue
        near = [(total @ model[k] / np.sqrt((total * total).sum() * (model[k].astype(float) ** 2).sum()), k) for k in model]
        best = max(s for s, _ in near)
        expected.append((i, next(k for s, k in near if s == best), round(float(max(0, best)), 9)))
    assert sorted(((r.row_id, r.lang_pred, round(r.score, 9)) for r in found), key=str) == sorted(expected, key=str)


def test_small_tables(spark, make_docs):
    empty = make_docs([])
    model = prototypes(empty)
    assert model == {} and identify(empty, model).count() == 0
    assert [(r.lang_pred, r.score) for r in identify(make_docs(["some text"]), model).collect()] == [("und", 0.0)]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    frame = spark.createDataFrame([(f"l{i}", "word") for i in range(5)], "lang STRING, text STRING")
    with pytest.raises(ValueError, match="more than 3 languages"):
        prototypes(frame, dims=64)


def test_held_out(spark):
    rows = [(i,) for i in (*range(-20, 200), None)]
    found = spark.createDataFrame(rows, "doc_id BIGINT").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    found = QUERIES["op11_language_id"](spark, folder).collect()
    assert len(found) == len(langs) and all(0 <= r.score <= 1 for r in found)
    tested = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out]
    assert len(tested) > 200 and sum(tested) >= 0.98 * len(tested)
