import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import axonframe.llm.vafile as vafile
from axonframe.llm.vafile import bounds, cell_numbers, top_k

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(rows, k=5, every=50):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(whole) if m != n and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def result(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in top_k(frame, **options).collect())


def test_equals_brute_force(spark, monkeypatch):
    for name, value in (("VECTORS", 64), ("QUERIES", 3), ("MET", 2)):
        monkeypatch.setattr(vafile, name, value)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(12)] + [(2000, [0.0] * 16), (2050, [0.25] * 16), (50, rows[0][1])]
    rows += [(3000, None), (3050, []), (3100, [None] * 16), (3150, [float("nan")] * 16), (3200, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    rows += [(4000 + i, [rng.random() * 3 for _ in range(5)]) for i in range(3)] + [(5000, [1e9] * 16)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, k=1, every=7, cells=2) == brute(rows, 1, 7)


def test_empty_and_clashing_columns(spark):
    assert result(spark, []) == [] and result(spark, [(0, [1.0])]) == []
    frame = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA).withColumn("uid", F.lit("x")).withColumn("d", F.lit(3)).withColumn("id", F.lit(9))
    assert [tuple(r) for r in top_k(frame).collect()] == [(0, 1, 1, 256 * 512)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, queries = rng.integers(-300, 300, (200, 8)), rng.integers(-300, 300, (20, 8))
    ranges = (vectors.min(axis=0), vectors.max(axis=0))
    for cells in (1, 3, 64):
        lower, upper = bounds(queries, cell_numbers(vectors, ranges, cells), ranges, cells)
        exact = queries @ vectors.T
        assert (lower <= exact).all() and (exact <= upper).all()


def test_equal_vectors_and_large_scores(spark, monkeypatch):
    for name, value in (("VECTORS", 16), ("QUERIES", 2), ("MET", 2)):
        monkeypatch.setattr(vafile, name, value)
    rng = random.Random(4)
    few = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, few[i % 9 if i % 3 else 0]) for i in range(400)]  # A third of the rows hold one vector.
    rows += [(50, few[0]), (50, few[0]), (100, few[1])]
    assert result(spark, rows, every=10) == brute(rows, 5, 10)
    # Scores of a row with itself leave 64 bits, those with others do not.
    huge = [(1000 * (i + 1), [3e9 if i == j else 1.0 for j in range(4)]) for i in range(4)]
    assert result(spark, huge + rows[:60], k=2) == brute(huge + rows[:60], 2)


@pytest.mark.parametrize("huge", [[1e10] * 4, [1e30] * 4])
def test_refused_scores(spark, huge):
    with pytest.raises(Exception, match="does not fit"):
        result(spark, [(0, huge), (1, huge)])
