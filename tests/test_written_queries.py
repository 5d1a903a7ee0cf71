"""Queries that write and read: how many files there are, and how large, follows the rows."""

from pathlib import Path

import pytest

from axonframe.plans import score_queries, source_queries


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "new_folder", lambda spark: f"{tmp_path}/new")
    return tmp_path / "new"


def test_related_files_lie_in_one_folder_per_layer(spark, tmp_path, folder):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(64)], i % 3) for i in range(30)]
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = source_queries.related_json(spark, str(tmp_path))
    assert sorted(found.collect()) == sorted(score_queries.related_top10(spark, str(tmp_path)).select(*found.columns).collect())
    names = [p.relative_to(folder) for p in Path(folder).rglob("*.json")]
    assert sorted(map(str, names)) == sorted(f"neurons/{i % 3}/{i}.json" for i in range(30))
    assert sum(p.is_dir() for p in Path(folder).rglob("*")) == 1 + 3


def documents(spark, tmp_path):
    rows = [(i, f"text {i}\nof \"two\" lines " * 5) for i in range(40)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_streamed_files_are_as_many_as_the_parts_read(spark, tmp_path, folder):
    rows = documents(spark, tmp_path)
    assert source_queries.text_stream(spark, str(tmp_path)).count() == len(rows)
    assert len(list(Path(folder, "in").glob("part-*"))) == 5


def test_labelled_files_stay_small(spark, tmp_path, folder, monkeypatch):
    rows = documents(spark, tmp_path)
    monkeypatch.setattr(source_queries, "FILE_BYTES", 400, raising=False)
    found = {r["seq_id"]: r["tokens"] for r in source_queries.labelled_windows(spark, str(tmp_path)).collect()}
    words = [w for side in (0, 1) for i, text in rows if i % 2 == side for w in text.split()]
    assert found == {k: " ".join(words[64 * k : 64 * k + 64]) for k in range(len(words) // 64)}
    for name in ("a.tsv", "b.tsv"):
        files = list(Path(folder, name).glob("part-*"))
        assert len(files) > 3 and max(f.stat().st_size for f in files) < 3 * 400
