import random

import pytest
from pyspark.sql import functions as F

from axonframe.functions.text import is_blank, strip
from axonframe.operators import corpus, ordered


def model(docs, length, stride, cap):
    stream = [t for text in docs for t in text.split()]
    starts = range(0, max(0, len(stream) - length + 1), stride)
    found = {k: stream[s : s + length] for k, s in enumerate(starts)}
    return {k: v for k, v in found.items() if cap is None or k < cap}


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of 0 to 40 tokens, one of 3000, under sparse ids in shuffled files."""
    rng = random.Random(9)
    sizes = [rng.choice([0, 1, 2, 5, 40]) for _ in range(150)] + [3000] + [rng.randrange(0, 9) for _ in range(60)]
    word = iter(range(10**6))
    texts = [" ".join(f"w{next(word)}" for _ in range(n)) or " \n " for n in sizes]
    ids = sorted(rng.sample(range(400_000), len(texts)))
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id BIGINT, text STRING").repartition(6)
    return table, texts, ids


@pytest.mark.parametrize("length,stride,cap", [(8, None, None), (8, 3, None), (5, 11, None), (1, 1, None), (8, 3, 37), (64, 64, 0), (9000, 1, None)])
def test_windows_equal_a_sequential_pass(docs, length, stride, cap):
    table, texts, _ = docs
    found = corpus.token_windows(table, length, stride, cap).collect()
    assert {r["seq_id"]: r["tokens"] for r in found} == model(texts, length, stride or length, cap or None)


@pytest.fixture(scope="module", params=["one file a partition", "packed files"])
def stored(request, spark, docs, tmp_path_factory):
    """The same texts, stored in order: files of very different sizes, one of blank texts only."""
    _, texts, ids = docs
    folder = str(tmp_path_factory.mktemp("stored") / "docs")
    edges = [0, 1, 2, 40, 43, 43 + 60, 160, len(ids)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        rows = [(i, " \n " if n == 3 else t) for i, t in zip(ids[a:b], texts[a:b])]
        spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")
    left = [" " if 40 <= i < 43 else t for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.files.openCostInBytes", "1g" if request.param != "packed files" else "1k")
    spark.conf.set("spark.sql.files.minPartitionNum", "2")
    yield spark.read.parquet(folder).drop("part"), left, ids
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.mark.parametrize("length,stride,cap", [(8, None, None), (8, 3, None), (5, 11, None), (1, 1, None), (2, 5, None), (8, 3, 37), (8, 8, 1), (4, 4, 190), (64, 64, 0), (300, 7, None)])
def test_windows_of_a_stored_corpus_are_cut_in_place(stored, length, stride, cap, monkeypatch):
    table, texts, _ = stored
    runs = ordered.layout(table, "doc_id")
    assert len(runs) == 7 and (len({r.part for r in runs}) < 4) == (table.rdd.getNumPartitions() < 4)
    monkeypatch.setattr(ordered, "TOKENS", 50)
    monkeypatch.setattr(ordered, "FIRST_ROWS", 3)
    frame = corpus.token_windows(table, length, stride, cap)
    assert {r["seq_id"]: r["tokens"] for r in frame.collect()} == model(texts, length, stride or length, cap or None)


def plan(frame, capsys):
    capsys.readouterr()
    frame.explain("formatted")
    return capsys.readouterr().out


def test_no_text_is_shuffled(stored, capsys, monkeypatch):
    table, _, ids = stored
    monkeypatch.setattr(ordered, "FIRST_ROWS", 5)
    shown = plan(corpus.row_slice(table, 10, 60), capsys)
    assert "Exchange hash" not in shown and "Exchange range" not in shown and "Exchange Round" not in shown
    assert f"LessThanOrEqual(doc_id,{ids[102]})" in shown  # Later partitions are not read.
    shown = plan(corpus.token_windows(table, 8, 8), capsys)
    assert shown.count("hashpartitioning(seq_id") == 1 and "_text" not in shown
    shown = plan(corpus.token_windows(table, 8, 8, 3), capsys)
    assert "LessThanOrEqual(doc_id" in shown


def test_blank_texts_at_the_ends(spark):
    texts = [" "] * 400 + [f"a{i} b{i}" for i in range(30)] + [""] * 300 + ["c " * 90] + [None] * 200
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    for length, stride in ((5, 3), (40, 40), (3, 1)):
        found = corpus.token_windows(table, length, stride).collect()
        assert {r["seq_id"]: r["tokens"] for r in found} == model([t or "" for t in texts], length, stride, None)


def test_changed_partitions_are_noticed(spark, stored):
    table, _, ids = stored
    parts = ordered.layout(table, "doc_id")
    moved = [r._replace(first=r.first - 1) if i == 2 else r for i, r in enumerate(parts)]
    with pytest.raises(Exception, match="changed between two passes"):
        ordered.with_row_numbers(table, moved, "doc_id", "n").collect()
    with pytest.raises(Exception, match="changed between two passes"):
        ordered.with_row_numbers(table, parts[:-1], "doc_id", "n").collect()


def test_row_numbers_of_a_stored_corpus(spark, stored):
    table, _, ids = stored
    assert [r["row_index"] for r in corpus.with_row_index(table).orderBy("doc_id").collect()] == list(range(len(ids)))
    for start, end in ((0, None), (0, 1), (1, 41), (42, 170), (100, 10**6), (len(ids), None), (7, 7)):
        found = corpus.row_slice(table, start, end).orderBy("row_index").collect()
        assert [(r["doc_id"], r["row_index"]) for r in found] == list(zip(ids, range(len(ids))))[start:end]
    shards = corpus.with_shard(table, 4).groupBy("shard_id").count().orderBy("shard_id").collect()
    assert [r["count"] for r in shards] == [b - a for a, b in corpus.shard_ranges(len(ids), 4)]
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert corpus.with_row_index(empty).count() == corpus.token_windows(empty, 4).count() == corpus.row_slice(empty, 0, 5).count() == 0


def test_row_index_slices_and_shards(docs):
    table, _, ids = docs
    assert [r["doc_id"] for r in corpus.row_slice(table, 10, 25).orderBy("row_index").collect()] == ids[10:25]
    assert corpus.row_slice(table, 5, 5).count() == 0
    assert corpus.row_slice(table, -4, 10**9).count() == len(ids)
    shards = corpus.with_shard(table, 4).groupBy("shard_id").count().orderBy("shard_id").collect()
    ranges = corpus.shard_ranges(len(ids), 4)
    assert [r["count"] for r in shards] == [b - a for a, b in ranges]


def test_range_specs():
    assert corpus.parse_range("train[100:200]") == ("train", 100, 200)
    assert corpus.parse_range("train[100:]") == ("train", 100, None)
    assert corpus.parse_range("train[:1e3]") == ("train", 0, 1000)
    assert corpus.parse_range("train") is None
    assert corpus.parse_range("train[10%:20%]") is None
    with pytest.raises(ValueError):
        corpus.parse_range("train[10:20%]")
    assert corpus.percent_ranges(4)[1] == (25.0, 50.0)


def test_window_checks():
    assert corpus.check_window(8, 0) == 8
    with pytest.raises(ValueError):
        corpus.check_window(0, None)
    with pytest.raises(ValueError):
        corpus.check_window(2048, None, 1024)


def test_stripping_follows_unicode(spark):
    texts = ["", "  ", " x　", "\x1cy\x1f", "​z", " a b ", " \n", "\x85q", "a\n"]
    table = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    rows = table.select("i", strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r["s"] == texts[r["i"]].strip()
        assert r["b"] == (not texts[r["i"]].strip())


def test_streams_refuse_row_slices(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("doc_id BIGINT, text STRING").parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        corpus.row_slice(stream, 0, 1)
