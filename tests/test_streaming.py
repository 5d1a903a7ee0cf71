import random

import pytest
from pyspark.sql import functions as F

from axonframe.operators import records
from axonframe.streaming import running


@pytest.fixture
def rows(make_acts):
    rng = random.Random(2)
    lists = {(0, n): [[float(rng.randrange(0, 6))] for _ in range(60)] for n in range(5)}
    return make_acts(lists)


def expected(table):
    kept = records.neuron_records(table, 4, 3, None)
    return sorted(map(tuple, kept.select("kind", "layer", "neuron", "rank", "seq_id").collect()))


def found(spark, path):
    kept = running.read_records(spark, path, 4, 3)
    return sorted(map(tuple, kept.select("kind", "layer", "neuron", "rank", "seq_id").collect()))


def test_batches_equal_one_pass_and_replays_replace_themselves(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    batches = [rows.where(F.floor(F.col("seq_id") / 20) == b) for b in range(3)]
    for number, batch in enumerate(batches):
        running.write_batch(batch.limit(5), path, number, 4, 3)  # a batch that was cut short
        running.write_batch(batch, path, number, 4, 3)
    running.write_batch(batches[0], path, 0, 4, 3)
    assert found(spark, path) == expected(rows)
    stats = {r["neuron"]: r for r in running.read_stats(spark, path).collect()}
    for row in records.moments(rows).collect():
        assert stats[row["neuron"]]["n_values"] == 60
        assert stats[row["neuron"]]["variance"] == pytest.approx(row["variance"])


def test_folded_batches_are_not_read_again(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    for number in range(6):
        running.write_batch(rows.where(F.floor(F.col("seq_id") / 10) == number), path, number, 4, 3)
        if number in (2, 4):
            running.fold(spark, path, number - 1)
    running.fold(spark, path, 1)  # done before: nothing happens
    assert found(spark, path) == expected(rows)
    # What a batch that is part of the folding wrote does not count any more.
    running.write_batch(rows.limit(0), path, 0, 4, 3)
    assert found(spark, path) == expected(rows)
    assert {r["n_values"] for r in running.read_stats(spark, path).collect()} == {60}
    read = running._parts(spark, path, "records").select(F.input_file_name().alias("file")).distinct().collect()
    assert sorted({r["file"].split("/")[-2] for r in read}) == ["batch=4", "batch=5", "upto=3"]
    # A folding without its mark is not valid.
    spark.range(1).write.parquet(f"{path}/folded/records/upto=9")
    assert found(spark, path) == expected(rows)


def test_more_than_the_batches_kept_fails(spark, rows, tmp_path):
    running.write_batch(rows, str(tmp_path), 0, 4, 3)
    for k, n in ((5, 3), (4, 4)):
        with pytest.raises(ValueError, match="kept 4 top records and 3 sampled"):
            running.read_records(spark, str(tmp_path), k, n)


def test_stream_with_many_files(spark, rows, tmp_path):
    for b in range(4):
        rows.where(F.floor(F.col("seq_id") / 15) == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.start_running_summary(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 4, 3, fold_every=2).awaitTermination()
    assert found(spark, str(tmp_path / "out")) == expected(rows)


def test_progress(spark, tmp_path):
    times = spark.range(100).select((F.timestamp_seconds(F.col("id") * 7)).alias("ts"), "id")
    for b in range(2):
        times.where(F.col("id") % 2 == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(times.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.start_progress(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = running.read_progress(spark, str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] == 100 and got.count() == 12


def test_very_late_rows_are_counted(spark, tmp_path):
    times = spark.range(50).select(F.timestamp_seconds(1_000_000 - F.col("id") * 3600).alias("ts"))
    for b in range(5):
        times.where(F.floor((F.unix_timestamp("ts") - 1_000_000) / -36000) == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(times.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.start_progress(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert running.read_progress(spark, str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 50
