import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import merge, records, splits, tokens
from axonframe.operators.corpus import shard_ranges


def heap_model(scores, k):
    """Bounded heap fed in order: (score, number); replaces only on a strictly greater score."""
    heap = []
    for number, score in enumerate(scores):
        if len(heap) < k:
            heapq.heappush(heap, (score, number))
        elif score > heap[0][0]:
            heapq.heapreplace(heap, (score, number))
    return sorted(((-score, number) for score, number in heap))


@pytest.mark.parametrize("k", [1, 4, 9])
def test_top_records_equal_a_heap(make_acts, k):
    rng = random.Random(k)
    lists = {
        (0, n): [[rng.randrange(0, 4) / 2 for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 40))]
        for n in range(60)
    }
    lists[1, 0] = [[0.0]] * 300
    found = records.top_picks(records.record_index(make_acts(lists)), k).collect()
    got = {}
    for row in found:
        got.setdefault((row["layer"], row["neuron"]), []).append((row["rank"], -row["score"], row["seq_id"]))
    for key, arrays in lists.items():
        assert [r[1:] for r in sorted(got[key])] == heap_model([max(a) for a in arrays], k)


def test_empty_records_are_sampled_but_never_top(make_acts):
    table = make_acts({(0, 0): [[], [1.0], [], [-2.0]]})
    kept = records.neuron_records(table, 10, 10, None)
    assert {r["seq_id"] for r in kept.where("kind = 'top'").collect()} == {1, 3}
    assert {r["seq_id"] for r in kept.where("kind = 'random'").collect()} == {0, 1, 2, 3}
    assert {r["score"] for r in kept.where("kind = 'random' and seq_id in (0, 2)").collect()} == {-math.inf}


def skewed(make_acts):
    """One neuron holds most of the rows, with many equal scores."""
    rng = random.Random(7)
    lists = {(0, n): [[rng.gauss(0, 1) for _ in range(3)] for _ in range(20)] for n in range(6)}
    lists[0, 99] = [[max(0.0, round(rng.gauss(0, 1), 1)) for _ in range(2)] for _ in range(1500)]
    return make_acts(lists, 9)


@pytest.mark.parametrize("limit", [0, 4000, 1 << 26])
def test_fetch_paths_agree(make_acts, limit):
    """Picks broadcast, bounds broadcast, and everything shuffled give the same rows."""
    table = skewed(make_acts)
    kept = records.neuron_records(table, 12, 7, (0.5, 0.9), 5)
    keys = ["layer", "neuron", "kind", "bucket", "rank", "seq_id", "score"]
    expected = sorted(map(repr, kept.select(*keys, "activations").collect()))
    index = records.record_index(table)
    bounds = records.quantile_boundaries(index, (0.5, 0.9))
    none = {"bucket": F.lit(None).cast("int"), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}
    picks = (
        records.top_picks(index, 12).withColumn("kind", F.lit("top")).withColumns(none)
        .unionByName(records.sample_picks(index, 7).withColumn("kind", F.lit("random")).withColumns(none))
        .unionByName(
            records.sample_picks(records.bucketed(index, bounds), 5, ["layer", "neuron", "bucket"])
            .join(bounds, ["layer", "neuron"])
            .withColumns({
                "kind": F.lit("quantile"),
                "low": F.get("quantile_boundaries", F.col("bucket") - 1),
                "high": F.get("quantile_boundaries", F.col("bucket")),
            }).drop("quantile_boundaries")
        )
    )
    fetched = records.fetch_records(table, picks, limit=limit).select(*keys, "activations").collect()
    assert sorted(map(repr, fetched)) == expected


def test_sample_is_repeatable_uniform_and_complete(make_acts):
    lists = {(0, n): [[float(i)] for i in range(40)] for n in range(200)}
    table = make_acts(lists)
    first = records.sample_picks(records.record_index(table), 10)
    again = records.sample_picks(records.record_index(table.repartition(3)), 10)
    key = ["layer", "neuron", "rank", "seq_id"]
    assert sorted(first.select(*key).collect()) == sorted(again.select(*key).collect())
    counts = np.zeros(40)
    for row in first.collect():
        counts[row["seq_id"]] += 1
    assert counts.sum() == 2000
    # 50 expected per sequence, standard deviation about 6.
    assert counts.min() > 20 and counts.max() < 80
    assert records.sample_picks(records.record_index(table), 100).count() == 8000


def test_moments_of_odd_inputs(make_acts):
    values = [[1.5, -2.0, 4.0], [0.5]]
    table = make_acts({(0, 0): values, (0, 1): [[3.0]], (0, 2): [[]], (0, 3): [[2.0, 2.0]]})
    found = {r["neuron"]: r for r in records.moments(table).collect()}
    flat = np.array([1.5, -2.0, 4.0, 0.5])
    assert found[0]["mean"] == pytest.approx(flat.mean()) and found[0]["variance"] == pytest.approx(flat.var(ddof=1))
    centred = (flat - flat.mean()) / flat.std()
    assert found[0]["skewness"] == pytest.approx((centred**3).mean())
    assert found[0]["kurtosis"] == pytest.approx((centred**4).mean() - 3)
    assert found[1]["mean"] == 3.0 and math.isnan(found[1]["variance"])
    assert found[2]["n_values"] == 0 and math.isnan(found[2]["mean"])
    assert found[3]["variance"] == 0.0 and math.isnan(found[3]["skewness"])


def test_merged_moments_do_not_cancel(spark):
    rng = np.random.default_rng(2)
    parts = [1e8 + rng.normal(size=50) for _ in range(7)]
    rows = [(0, 0, i, len(p), float(p.mean()), float(((p - p.mean()) ** 2).sum())) for i, p in enumerate(parts)]
    rows.append((0, 0, 9, 0, float("nan"), 0.0))
    stats = spark.createDataFrame(rows, "layer INT, neuron INT, shard INT, n_values BIGINT, mean DOUBLE, m2 DOUBLE")
    merged = records.merge_moments(stats).first()
    whole = np.concatenate(parts)
    assert merged["n_values"] == 350
    assert merged["variance"] == pytest.approx(whole.var(ddof=1), rel=1e-6)


def test_merged_moments_keep_neurons_without_values(make_acts):
    table = make_acts({(0, 0): [[1.5, -2.0], [0.5]], (0, 1): [[], []], (0, 2): [[3.0], []]})
    parts = records.moments(table, ["layer", "neuron", "seq_id"])
    merged = {r["neuron"]: r for r in records.merge_moments(parts).collect()}
    whole = {r["neuron"]: r for r in records.moments(table).collect()}
    assert merged.keys() == whole.keys() == {0, 1, 2}
    for n in whole:
        for name in ("n_values", "mean", "m2", "variance"):
            assert merged[n][name] == pytest.approx(whole[n][name], nan_ok=True)


def test_merge_exact_ignores_grouping_and_repeats(make_acts):
    rng = random.Random(11)
    lists = {(0, n): [[rng.random() for _ in range(3)] for _ in range(30)] for n in range(4)}
    table = make_acts(lists)
    whole = records.neuron_records(table, 6, 5, None)
    parts = [table.where(F.col("seq_id") % 3 == s) for s in range(3)]
    kept = [records.neuron_records(p, 6, 5, None) for p in parts]
    stats = [records.moments(p).withColumn("shard", F.lit(i)) for i, p in enumerate(parts)]
    union = kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[1])
    merged, moments = merge.merge_exact(union, stats[0].unionByName(stats[1]).unionByName(stats[2]), 6, 5)
    key = ["kind", "layer", "neuron", "rank", "seq_id"]
    assert sorted(merged.select(*key).collect()) == sorted(whole.select(*key).collect())
    expected = {r["neuron"]: r for r in records.moments(table).collect()}
    for row in moments.collect():
        assert row["variance"] == pytest.approx(expected[row["neuron"]]["variance"])


def test_merge_retained_counts_repeated_records_twice(make_acts):
    table = make_acts({(0, 0): [[1.0], [5.0], [3.0]]})
    kept = records.neuron_records(table, 2, 3, None).withColumn("shard", F.lit(0))
    merged, stats = merge.merge_retained(kept, 4, 10)
    assert [r["seq_id"] for r in merged.where("kind = 'top'").orderBy("rank").collect()] == [1, 1, 2, 2]
    assert stats.first()["n_values"] == 5


def test_splits_follow_the_positions(make_acts):
    table = make_acts({(0, 0): [[float(100 - i)] for i in range(14)], (0, 1): [[float(i)] for i in range(5)]})
    kept = records.neuron_records(table, 14, 8, None)
    found = splits.split_records(kept)
    rows = {}
    for r in found.collect():
        rows.setdefault((r["neuron"], r["split"], r["kind"]), []).append((r["position"], r["rank"] - 1))
    assert [p for _, p in sorted(rows[0, "train", "top"])] == [0, 4, 8]
    assert [p for _, p in sorted(rows[0, "valid", "top"])] == [2, 6, 10]
    assert [p for _, p in sorted(rows[0, "valid", "random"])] == [1, 4]
    assert (0, "train", "random") not in rows
    assert [p for p, _ in sorted(rows[0, "valid", "top"]) + sorted(rows[0, "valid", "random"])] == [0, 1, 2, 3, 4]
    assert [p for _, p in sorted(rows[1, "test", "top"])] == [3]
    with pytest.raises(Exception, match="too few top records"):
        splits.split_records(kept, 3).collect()
    with pytest.raises(ValueError):
        splits.one_split(kept, "holdout")


def test_levels_scale_and_shares(make_acts):
    table = make_acts({(0, 0): [[-1.0, 0.0, 5.0], [10.0]], (0, 1): [[-1.0, -2.0]]})
    levels = {(r["neuron"], r["seq_id"]): r["levels"] for r in records.with_levels(table).collect()}
    assert levels == {(0, 0): [0, 0, 5], (0, 1): [10], (1, 0): [0, 0]}
    share = {r["neuron"]: r["nonzero_share"] for r in records.nonzero_share(table).collect()}
    assert share == {0: 0.5, 1: 0.0}
    unit = {(r["neuron"], r["seq_id"]): r["unit_activations"] for r in records.with_unit_scale(table, 0.5).collect()}
    assert unit == {(0, 0): [-0.1, 0.0, 0.5], (0, 1): [1.0], (1, 0): [0.5, 0.5]}


def test_selection_checks():
    assert records.check_layers(4, None) == [0, 1, 2, 3]
    assert records.check_neurons(4, [3, 1, 3]) == [1, 3]
    with pytest.raises(ValueError):
        records.check_layers(4, [4])
    assert shard_ranges(10, 3) == [(0, 4), (4, 7), (7, 10)]
    with pytest.raises(ValueError):
        shard_ranges(2, 3)


def test_nan_is_rejected(make_acts):
    table = make_acts({(0, 0): [[1.0, float("nan")]]})
    with pytest.raises(Exception, match="NaN activation"):
        records.reject_nan(table).collect()


def test_token_averages(make_acts):
    table = make_acts({(0, 0): [[1.0, 2.0], [3.0, 0.0, 9.0]]})
    rows = tokens.token_averages(table, 2).orderBy("rank").collect()
    assert [(r["token"], r["avg_activation"], r["n"]) for r in rows] == [("t2", 9.0, 1), ("t0", 2.0, 2)]
    lists = tokens.token_lists(tokens.token_averages(table)).first()
    assert lists["tokens"] == ["t2", "t0", "t1"]
