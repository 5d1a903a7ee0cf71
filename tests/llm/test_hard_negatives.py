import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import axonframe.llm.hard_negatives as module
from axonframe.llm.hard_negatives import Asked, Codes, hard_negatives, intervals, rotated, scores

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    whole = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (anchor, label, a) in enumerate(whole):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i, other) for m, (i, other, b) in enumerate(whole) if m != n and len(a) == len(b))
        for goal, i, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and low * -goal <= 100 * -s[0] <= high * -goal]
            out += [(anchor, i, r + 1, j, -goal, -s) for r, (s, j, _) in enumerate(fit[:negatives])]
    return sorted(out)


def result(spark, rows, **options):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect())


def table(rng, n=500, d=16):
    centres = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre = rng.randrange(6)
        rows.append((i, [c + rng.gauss(0, 0.15) for c in centres[centre]], centre if rng.random() < 0.8 else rng.randrange(6)))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"VECTORS": 16, "QUERIES": 2, "MET": 2, "SIDES": 3, "PAIRS": 7}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(module, name, value)
    rng = random.Random(4)
    rows = table(rng)
    # Copies with equal and other labels, repeated anchors, opposite and zero vectors, other lengths, rows that take no part.
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(40)] + [(100, rows[0][1], 1), (100, rows[0][1], rows[0][2])]
    rows += [(2000, [0.0] * 16, 1), (2100, [-x for x in rows[0][1]], 2), (2200, [1.0, 2.0], 0), (2300, [2.0, 1.0], 0), (2301, [0.5, 0.7], 1), (2302, [1.0, -0.5], 3)]
    rows += [(3000, None, 1), (3100, [], 1), (3200, [None] * 16, 1), (3300, [float("nan")] * 16, 1), (3400, [1.0] * 16, None), (None, [1.0] * 16, 1), (-100, rows[5][1], 5)]
    found = result(spark, rows)
    assert found == brute(rows) and found
    assert result(spark, rows, every=50, positives=2, negatives=3, low=-20, high=100) == brute(rows, 50, 2, 3, -20, 100)


def test_only_copies(spark):
    rows = [(i, [0.5, 0.25, -1.0], i % 4) for i in range(300)]
    assert result(spark, rows, high=100) == brute(rows, high=100)


def test_empty_and_clashing_columns(spark):
    assert result(spark, []) == [] and result(spark, [(0, [1.0], 0)]) == []
    frame = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (2, [1.0], 1)], SCHEMA)
    for name in ("uid", "id", "d", "side", "query", "goal", "score"):
        frame = frame.withColumn(name, F.lit("x"))
    assert [tuple(r) for r in hard_negatives(frame).collect()] == [(0, 1, 1, 2, 256 * 512, 256 * 256)]


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(i * 10, [rng.uniform(-1, 1) * 10**6 for _ in range(6)], rng.randrange(3)) for i in range(60)]
    found = result(spark, rows)
    assert found == brute(rows) and max(abs(r[5]) for r in found) > 2**53


def test_too_large_components():
    with pytest.raises(OverflowError):
        scores(np.full((1, 3), 1e12), np.full((1, 3), 1e12))
    a, b = np.array([[1e12, 1e12, 3.0]]), np.array([[1e12, -1e12, 5.0]])
    assert scores(a, b).tolist() == [15]


@pytest.mark.parametrize("d", [1, 3, 64, 100])
def test_intervals_hold(d):
    rng = np.random.default_rng(d)
    vectors, queries = rng.integers(-300, 300, (150, d)).astype(float), rng.integers(-300, 300, (20, d)).astype(float)
    vectors[:3] = [[0], [1], [-7]]
    queries[0], queries[1] = 0, vectors[9]
    turned = rotated(vectors)
    assert np.allclose((turned * turned).sum(axis=1), turned.shape[1] * (vectors * vectors).sum(axis=1))
    lower, upper = intervals(Asked(queries), Codes(vectors), slice(0, 150))
    product = queries @ vectors.T
    assert (lower <= product).all() and (product <= upper).all()
    # Codes do narrow the interval that the lengths alone give.
    plain = np.sqrt((queries**2).sum(axis=1)[:, None] * (vectors**2).sum(axis=1)[None, :])
    assert (upper - lower).sum() < 1.9 * plain.sum()
