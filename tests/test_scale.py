import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.functions.arrays import count_below
from axonframe.operators import scale


def test_prefix_sum_over_sparse_keys(spark):
    rng = random.Random(1)
    keys = sorted(rng.sample(range(5_000_000), 3000))
    rows = [(k, rng.randrange(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "k BIGINT, w INT").repartition(7)
    found = {r["k"]: r["start"] for r in scale.prefix_sum(df, "k", "w", fanout=16).collect()}
    total = 0
    for k, w in rows:
        assert found[k] == total
        total += w


def test_prefix_sum_of_nothing(spark):
    df = spark.createDataFrame([], "k BIGINT, w INT")
    assert scale.prefix_sum(df, "k", "w").count() == 0


def test_top_rows_with_one_heavy_key(spark):
    """One key owns two thirds of the rows and most of its values are equal."""
    df = spark.range(0, 30_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(-1).alias("key"),
        F.when(F.col("id") % 5 == 0, F.col("id") % 97).otherwise(0).alias("v"),
        "id",
    )
    found = scale.top_rows(df, ["key"], [F.col("v").desc(), F.col("id")], 10, salts=4).collect()
    expected = {}
    for row in df.collect():
        expected.setdefault(row["key"], []).append((-row["v"], row["id"]))
    got = {}
    for row in found:
        got.setdefault(row["key"], []).append((row["rank"], -row["v"], row["id"]))
    assert got.keys() == expected.keys()
    for key, rows in expected.items():
        assert [r[1:] for r in sorted(got[key])] == sorted(rows)[:10]


def test_top_rows_trims_before_each_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("key"), "id")
    plan = scale.top_rows(df, ["key"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_previous_value_across_chunks(spark):
    rng = random.Random(3)
    rows = [(k, t, f"{k}:{t}" if t % 4 else None) for k in range(3) for t in sorted(rng.sample(range(4000), 300))]
    df = spark.createDataFrame(rows, "k INT, t INT, v STRING").repartition(6)
    found = {(r["k"], r["t"]): r["before"] for r in scale.previous_value(df, ["k"], "t", "v", "before", chunk=8).collect()}
    last = {}
    for k, t, v in rows:
        assert found[k, t] == last.get(k)
        last[k] = v


@pytest.mark.parametrize("small", [1, 50, 10_000])
def test_exact_percentiles(spark, small):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(700), rng.exponential(size=900), [1e9, 5e8]])
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").repartition(4)
    wanted = [0.0, 0.3, 0.5, 0.9, 0.99, 0.999, 1.0]
    found = scale.exact_percentiles(df, "v", wanted, bins=16, small=small)
    assert np.allclose(found, np.quantile(values, wanted))


def test_exact_percentiles_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "v DOUBLE")
    assert np.isnan(scale.exact_percentiles(empty, "v", [0.5])[0])
    assert scale.exact_percentiles(spark.createDataFrame([(3.0,)], "v DOUBLE"), "v", [0.1, 0.9]) == [3.0, 3.0]


def test_join_sized_broadcasts_only_below_the_limit(spark):
    big = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(7).select(F.col("id").alias("k"), F.col("id").cast("string").alias("name"))
    near = scale.join_sized(big, small, ["k"])
    far = scale.join_sized(big, small, ["k"], limit=0)
    assert "ResolvedHint (strategy=broadcast)" in near._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in far._jdf.queryExecution().analyzed().toString()
    assert sorted(near.collect()) == sorted(far.collect())


def test_prefix_sum_of_negative_null_and_repeated_keys(spark):
    keys = list(range(-3000, 100))
    df = spark.createDataFrame([(k, 1) for k in keys], "k BIGINT, w INT").repartition(4)
    found = {r["k"]: r["start"] for r in scale.prefix_sum(df, "k", "w", fanout=16).collect()}
    assert found == {k: i for i, k in enumerate(keys)}
    with pytest.raises(Exception, match="must not be null"):
        scale.prefix_sum(df.unionByName(spark.createDataFrame([(None, 1)], "k BIGINT, w INT")), "k", "w").collect()
    with pytest.raises(Exception, match="must be unique"):
        scale.prefix_sum(df.unionByName(spark.createDataFrame([(5, 1)], "k BIGINT, w INT")), "k", "w").collect()


@pytest.mark.parametrize("size", [50, 10_000_000])
def test_ranked_counts_with_one_heavy_and_many_light_keys(spark, monkeypatch, size):
    monkeypatch.setattr(scale, "PIECE_ROWS", size)
    heavy = spark.range(20_000).select(F.lit(-1).alias("k"), (F.xxhash64("id") % 100_000 / 7.0).alias("v"), (F.col("id") % 3 + 1).alias("n")).dropDuplicates(["v"])
    light = spark.range(100_000).select(F.col("id").cast("int").alias("k"), F.lit(0.5).alias("v"), F.lit(2).cast("bigint").alias("n"))
    odd = spark.createDataFrame([(-2, float("nan"), 1), (-2, -0.5, 4), (-2, float("inf"), 2)], "k INT, v DOUBLE, n BIGINT")
    counts = scale.cut_lineage(heavy.unionByName(light).unionByName(odd))
    found = scale.cut_lineage(scale.ranked_counts(counts, ["k"], "v"))
    assert found.count() == counts.count()
    assert found.where("k >= 0 and not (first = 0 and last = 1)").count() == 0
    assert [(str(r.v), r["first"], r["last"]) for r in found.where("k = -2").orderBy("first").collect()] == [("-0.5", 0, 3), ("inf", 4, 5), ("nan", 6, 6)]
    place = 0
    got = {r.v: (r["first"], r["last"]) for r in found.where("k = -1").collect()}
    for r in counts.where("k = -1").orderBy("v").collect():
        assert got[r.v] == (place, place + r.n - 1)
        place += r.n


def test_count_below_finds_by_halving(spark):
    rng = random.Random(8)
    rows = [(sorted(rng.randrange(20) / 2 for _ in range(n)), rng.randrange(-2, 24) / 2) for n in [*range(0, 40), 100, 255, 256, 257]]
    table = spark.createDataFrame(rows, "items ARRAY<DOUBLE>, v DOUBLE")
    found = table.select("items", "v", count_below(F.col("items"), F.col("v")).alias("lower"), count_below(F.col("items"), F.col("v"), inclusive=True).alias("upper"))
    for r in found.collect():
        assert (r.lower, r.upper) == (sum(x < r.v for x in r["items"]), sum(x <= r.v for x in r["items"]))
