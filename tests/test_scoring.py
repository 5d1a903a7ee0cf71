import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import calibration, scoring

SIMS = "layer INT, neuron INT, explanation_id INT, seq_id BIGINT, tokens ARRAY<STRING>, expected ARRAY<DOUBLE>, activations ARRAY<DOUBLE>"


def pairs(spark, rows):
    """rows: (explanation, real, predicted) per sequence."""
    data = [
        (0, 0, e, i, ["t"] * len(p), [float(x) for x in p], [float(x) for x in r]) for i, (e, r, p) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SIMS)


def numpy_scores(r, p):
    r, p = np.array(r, float), np.array(p, float)
    with np.errstate(all="ignore"):
        return (
            np.corrcoef(r, p)[0, 1] if r.size else None,
            float(1 - np.mean((r - p) ** 2) / np.mean(r**2)),
            float(1 - np.mean(abs(r - p)) / np.mean(abs(r))),
        )


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b or a == pytest.approx(b)


CASES = [
    ([1, 2, 3], [1, 2, 4]), ([1, 2, 3], [2, 2, 2]), ([0, 0], [0, 0]), ([0, 0], [1, 2]), ([5], [4]), ([-1, 2, 0.5, 3], [0, 7, 2, 10]),
]


@pytest.mark.filterwarnings("ignore")
def test_scores_equal_numpy_in_every_corner(spark):
    table = pairs(spark, [(i, r, p) for i, (r, p) in enumerate(CASES)])
    for scored in (scoring.score_sequences(table), scoring.score_explanations(table)):
        for row in scored.collect():
            expected = numpy_scores(*CASES[row["explanation_id"]])
            got = tuple(row[name] for name in scoring.SCORES)
            assert all(same(a, b) for a, b in zip(got, expected)), (row, expected)


def test_pooled_score_uses_all_values_and_empty_is_null(spark):
    table = pairs(spark, [(0, [1, 2, 3], [3, 2, 1]), (0, [10, 20], [100, 210]), (1, [], [])])
    found = {r["explanation_id"]: r for r in scoring.score_explanations(table).collect()}
    assert found[0]["ev_correlation_score"] == pytest.approx(np.corrcoef([1, 2, 3, 10, 20], [3, 2, 1, 100, 210])[0, 1])
    assert found[1]["ev_correlation_score"] is None and math.isnan(found[1]["rsquared_score"])
    both = scoring.score_both(table).where("pooled").collect()
    assert {r["explanation_id"]: r["ev_correlation_score"] for r in both}[0] == pytest.approx(found[0]["ev_correlation_score"])


def test_sums_give_the_scores_of_all_values(spark):
    rng = np.random.default_rng(4)
    far = [(0, list(1e7 + rng.normal(size=n)), list(1e7 + rng.normal(size=n))) for n in (1, 7, 40)]
    table = pairs(spark, [*[(i + 1, r, p) for i, (r, p) in enumerate(CASES)], *far, (9, [], []), (9, [1, 2], [2, 5])])
    plain = {r["explanation_id"]: r for r in scoring.score_explanations(table).collect()}
    both = scoring.score_both(table).collect()
    pooled = {r["explanation_id"]: r for r in both if r["pooled"]}
    assert pooled.keys() == plain.keys() and all(r["seq_id"] is None for r in pooled.values())
    for key, row in pooled.items():
        assert all(same(row[name], plain[key][name]) for name in scoring.SCORES), (row, plain[key])
    single = {(r["explanation_id"], r["seq_id"]): r for r in scoring.score_sequences(table).collect()}
    for row in both:
        if not row["pooled"]:
            other = single.pop((row["explanation_id"], row["seq_id"]))
            assert all(same(row[name], other[name]) for name in scoring.SCORES), (row, other)
    assert not single


def test_sums_of_two_runs_merge(spark):
    table = pairs(spark, [(0, [1, 2, 3], [3, 2, 1]), (0, [10, 20], [100, 210]), (1, [4, 5], [4, 6])])
    runs = [scoring.score_sums(table.where(F.col("seq_id") % 2 == part)) for part in (0, 1)]
    each = [scoring.merge_score_sums(run) for run in runs]
    merged = scoring.scores_of_sums(scoring.merge_score_sums(each[0].unionByName(each[1])))
    found = {r["explanation_id"]: r for r in merged.collect()}
    for row in scoring.score_explanations(table).collect():
        assert all(same(found[row["explanation_id"]][name], row[name]) for name in scoring.SCORES)


@pytest.mark.parametrize("limit, strategy", [(10**8, "broadcast"), (400, "keys"), (150, "ranges"), (0, "plain")])
def test_only_simulated_sequences_are_exchanged(spark, make_acts, monkeypatch, limit, strategy):
    acts = make_acts({(0, n): [[n, s] for s in range(20)] for n in range(4)})
    sims = acts.where("neuron = 1 and seq_id in (3, 5, 7)").select(
        "layer", "neuron", F.lit(0).alias("explanation_id"), "seq_id", "tokens", F.col("activations").alias("expected")
    )
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", limit)
    found = scoring.pair_sequences(acts, sims)
    assert sorted((r["seq_id"], r["activations"]) for r in found.collect()) == [(s, [1.0, float(s)]) for s in (3, 5, 7)]
    keys = scoring.cut_lineage(sims.select("layer", "neuron", "seq_id").distinct())
    left = {"broadcast": 3, "keys": 3, "ranges": 5, "plain": 80}[strategy]
    assert scoring.matching_sequences(acts, keys).count() == left


def test_own_score_functions(spark):
    table = pairs(spark, [(0, [1, 2], [1, 4])])
    row = scoring.score_explanations(table, {"bias": lambda r, p: F.avg(p - r)}).first()
    assert row["bias"] == 1.0


@pytest.mark.filterwarnings("ignore")
def test_numpy_scores_equal_their_column_twins(spark):
    table = pairs(spark, [(i, r, p) for i, (r, p) in enumerate(CASES)])
    own = {
        "rsquared_score": lambda r, p: 1 - np.mean((r - p) ** 2) / np.mean(r**2),
        "absolute_dev_explained_score": lambda r, p: 1 - np.mean(abs(r - p)) / np.mean(abs(r)),
    }
    found = {r["explanation_id"]: r for r in scoring.score_arrays(table, own).collect()}
    for row in scoring.score_sequences(table).collect():
        assert all(same(found[row["explanation_id"]][name], row[name]) for name in own)
    none = table.limit(1).withColumn("activations", F.lit(None).cast("array<double>"))
    assert scoring.score_arrays(none, {"bias": lambda r, p: 1.0}).first()["bias"] is None


def test_best_explanation_prefers_defined_scores(spark):
    rows = [(0, 0, 0, float("nan")), (0, 0, 1, -0.5), (0, 1, 0, 0.3), (0, 1, 1, 0.3), (0, 2, 0, None)]
    scored = spark.createDataFrame(rows, "layer INT, neuron INT, explanation_id INT, ev_correlation_score DOUBLE")
    best = {r["neuron"]: (r["explanation_id"], r["ev_correlation_score"]) for r in scoring.best_explanations(scored).collect()}
    assert best == {0: (1, -0.5), 1: (0, 0.3), 2: (0, None)}


def test_token_guard(spark, make_acts):
    acts = make_acts({(0, 0): [[1.0, 2.0]]})
    good = spark.createDataFrame([(0, 0, 0, 0, ["t0", "t1"], [1.0, 2.0])], "layer INT, neuron INT, explanation_id INT, seq_id BIGINT, tokens ARRAY<STRING>, expected ARRAY<DOUBLE>")
    assert scoring.pair_sequences(acts, good).count() == 1
    with pytest.raises(Exception, match="tokens differ"):
        scoring.pair_sequences(acts, good.withColumn("tokens", F.array(F.lit("t0"), F.lit("x")))).collect()


def test_linear_calibration(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 11, 60).astype(float), rng.normal(size=60)
    table = pairs(spark, [(0, y[:30], x[:30]), (0, y[30:], x[30:]), (1, [1, 2, 6], [4, 4, 4])])
    out = calibration.calibrate(table.withColumn("dist_values", F.array("expected")), table, "linear").collect()
    slope, intercept = np.polyfit(x, y, 1)
    for row in out:
        if row["explanation_id"] == 0:
            assert np.allclose(row["expected"], slope * np.array(row["uncalibrated"]) + intercept)
            assert np.allclose(row["dist_values"][0], row["expected"])
        else:
            assert np.allclose(row["expected"], 3.0)
        assert row["scale"] == "neuron_activations"


def test_linear_calibration_keeps_the_correlation(spark):
    table = pairs(spark, [(0, [1, 2, 3, 7], [0, 3, 2, 9])])
    before = scoring.score_explanations(table).first()["ev_correlation_score"]
    after = scoring.score_explanations(calibration.calibrate(table, table, "linear")).first()["ev_correlation_score"]
    assert before == pytest.approx(after)


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_percentile_calibration_equals_interp(spark, limit):
    rng = np.random.default_rng(4)
    fit, wanted, models = [], [], {}
    for e in range(12):
        n = int(rng.integers(1, 400))
        x, y = rng.integers(0, 6, n) / 2.0, rng.normal(size=n).round(1)
        models[e] = (np.sort(x), np.sort(y))
        fit.append((e, y, x))
        wanted.append((e, np.zeros(9), np.concatenate([rng.uniform(-1, 4, 6), [0.0, 2.5, 1.0]])))
    wanted.append((0, [], []))
    # Explanation 0 is heavy: many rows, most simulated values equal.
    heavy_x = np.where(rng.random(3000) < 0.7, 0.0, rng.uniform(0, 10, 3000).round(2))
    heavy_y = rng.normal(size=3000)
    fit[0] = (0, heavy_y, heavy_x)
    models[0] = (np.sort(heavy_x), np.sort(heavy_y))
    sims = pairs(spark, wanted).withColumn("dist_values", F.array("expected", F.slice("expected", 1, 2)))
    out = calibration.calibrate_percentiles(sims, pairs(spark, fit), limit=limit).collect()
    assert len(out) == 13
    for row in out:
        expected = np.interp(row["uncalibrated"], *models[row["explanation_id"]]) if row["uncalibrated"] else []
        assert np.allclose(row["expected"], expected)
        assert np.allclose(row["dist_values"][0], expected) and np.allclose(row["dist_values"][1], expected[:2])


def test_calibration_needs_a_fit(spark):
    table = pairs(spark, [(0, [1], [1])])
    with pytest.raises(ValueError):
        calibration.calibrate(table, None, "linear")
    assert calibration.calibrate(table, None, "none").first()["expected"] == [1.0]


@pytest.mark.parametrize("method", ["linear", "percentile"])
def test_explanations_without_calibration_records_fail(spark, method):
    both = pairs(spark, [(0, [2, 4, 6], [1, 2, 3]), (1, [1, 1, 5], [1, 2, 3])])
    fitted = both.where("explanation_id = 0")
    assert len(calibration.calibrate(both, both, method).collect()) == both.count()
    with pytest.raises(Exception, match="no calibration records"):
        calibration.calibrate(both, fitted, method).collect()
    if method == "percentile":
        with pytest.raises(Exception, match="no calibration records"):
            calibration.calibrate_percentiles(both, fitted, limit=0).collect()


def test_one_value_with_most_of_the_rows(spark):
    rng = np.random.default_rng(4)
    real = np.where(rng.random(6000) < 0.9, 0.0, rng.random(6000)).tolist()
    simulated = np.where(rng.random(6000) < 0.9, 0.0, rng.integers(1, 400, 6000) / 10).tolist()
    knots = calibration.fit_percentiles(pairs(spark, [(0, real, simulated)])).collect()
    xs, ys = sorted(simulated), sorted(real)
    for row in knots:
        first, last = np.searchsorted(xs, row["x"]), np.searchsorted(xs, row["x"], "right") - 1
        assert (row["y_first"], row["y_last"]) == (ys[first], ys[last])
    assert len(knots) == len(set(xs))
