import numpy as np
import pytest

from axonframe.operators import page, weights


@pytest.mark.parametrize("block", [3, 512])
def test_strongest_connections_equal_numpy(spark, block):
    """Layer 1 holds most neurons; ids are sparse; there is nothing above the last layer."""
    rng = np.random.default_rng(1)
    sizes = {0: 5, 1: 40, 2: 7, 4: 2}
    rows = [(layer, i * 1000 + layer, rng.normal(size=6).tolist()) for layer, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "layer INT, neuron BIGINT, vector ARRAY<DOUBLE>")
    gains = {layer: rng.normal(size=6) for layer in sizes}
    gain_table = spark.createDataFrame([(k, v.tolist()) for k, v in gains.items()], "layer INT, gain ARRAY<DOUBLE>")
    found = weights.strongest_connections(table, table, gain_table, 4, block).collect()
    edges = [
        (l1, n1, l2, n2, float(np.dot(np.array(v1) * gains[l2], v2)))
        for l1, n1, v1 in rows for l2, n2, v2 in rows if l1 < l2
    ]
    ends = [("output", l1, n1, l2, n2, w) for l1, n1, l2, n2, w in edges] + [("input", l2, n2, l1, n1, w) for l1, n1, l2, n2, w in edges]
    expected = {}
    for direction, layer, neuron, *rest in ends:
        for sign, factor in (("positive", -1), ("negative", 1)):
            expected.setdefault((direction, sign, layer, neuron), []).append((factor * rest[2], *rest))
    got = {}
    for r in found:
        got.setdefault((r["direction"], r["sign"], r["layer"], r["neuron"]), []).append((r["rank"], r["to_layer"], r["to_neuron"], r["weight"]))
    assert got.keys() == expected.keys()
    for key, candidates in expected.items():
        best = sorted(candidates)[:4]
        assert [x[1:3] for x in sorted(got[key])] == [x[1:3] for x in best]
        assert np.allclose([x[3] for x in sorted(got[key])], [x[3] for x in best])


def test_related_explanations_keep_missing_ones(spark):
    related = spark.createDataFrame(
        [("output", "positive", 0, 0, r, 1, r, 1.0 / r) for r in range(1, 6)],
        "direction STRING, sign STRING, layer INT, neuron INT, rank INT, to_layer INT, to_neuron INT, weight DOUBLE",
    )
    texts = spark.createDataFrame([(1, 1, "e", 0.5)], "layer INT, neuron INT, explanation STRING, score DOUBLE")
    rows = page.related_explanations(page.listed_related(related), texts).orderBy("rank").collect()
    assert [(r["rank"], r["to_explanation"]) for r in rows] == [(1, "e"), (2, None), (3, None)]


def collected(frame):
    return {(r["direction"], r["sign"], r["layer"], r["neuron"], r["rank"]): (r["to_layer"], r["to_neuron"], round(r["weight"], 9)) for r in frame.collect()}


def test_equal_strengths_go_to_the_lower_neuron(spark):
    """More equal vectors than a block or a list holds, and zero vectors."""
    rows = [(0, i, [1.0, 2.0]) for i in range(9)] + [(1, 100 - i, [3.0, 1.0]) for i in range(30)] + [(1, 200 + i, [0.0, 0.0]) for i in range(5)]
    table = spark.createDataFrame(rows, "layer INT, neuron BIGINT, vector ARRAY<DOUBLE>").repartition(4)
    found = collected(weights.strongest_connections(table, table, None, 3, 4, directions=("output",)))
    assert len(found) == 9 * 2 * 3
    for neuron in range(9):
        assert [found["output", "positive", 0, neuron, r] for r in (1, 2, 3)] == [(1, 71, 5.0), (1, 72, 5.0), (1, 73, 5.0)]
        assert [found["output", "negative", 0, neuron, r] for r in (1, 2, 3)] == [(1, 200, 0.0), (1, 201, 0.0), (1, 202, 0.0)]


def test_short_blocks_are_skipped(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)) * np.geomspace(1, 1e-6, 400)[:, None]
    rows = [(1, 0, False, 1, i, v.tolist()) for i, v in enumerate(vectors)] + [(1, 0, True, 0, i, rng.normal(size=8).tolist()) for i in range(7)]
    batch = pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("to_layer", "side", "asks", "layer", "neuron", "vector"))})
    seen = []
    see = weights._Strongest.see
    monkeypatch.setattr(weights._Strongest, "see", lambda self, product, names: (seen.append(len(names)), see(self, product, names))[1])
    out = list(weights._search(5, 20)([batch]))
    assert sum(seen) < 2 * 400 / 2  # Both signs; less than half of the vectors were multiplied.
    assert sum(b.num_rows for b in out) == 7 * 5 * 2  # No more candidates than are asked for.
    for b in out:
        for sign, neuron, name, weight in zip(*(b.column(c).to_pylist() for c in ("sign", "neuron", "to_neuron", "weight"))):
            product = vectors @ np.array(rows[400 + neuron][5])
            order = np.sort(product if sign == "negative" else -product)[:5]
            assert np.isclose(product[name], weight) and abs(weight) >= abs(order[4]) - 1e-12


def test_sparse_form_agrees_with_the_dense_one(spark):
    rng = np.random.default_rng(6)
    sizes = {0: 12, 1: 15, 3: 9}
    dense = [(layer, i, (rng.normal(size=10) * (rng.random(10) < 0.7)).tolist()) for layer, n in sizes.items() for i in range(n)]
    sparse = [(layer, i, d, x) for layer, i, v in dense for d, x in enumerate(v) if x]
    gains = [(layer, rng.normal(size=10).tolist()) for layer in sizes]
    a = spark.createDataFrame(dense, "layer INT, neuron BIGINT, vector ARRAY<DOUBLE>")
    b = spark.createDataFrame(sparse, "layer INT, neuron BIGINT, d INT, value DOUBLE")
    g = spark.createDataFrame(gains, "layer INT, gain ARRAY<DOUBLE>")
    h = spark.createDataFrame([(layer, d, x) for layer, v in gains for d, x in enumerate(v)], "layer INT, d INT, gain DOUBLE")
    want = collected(weights.strongest_connections(a, a, g, 3))
    assert collected(weights.sparse_connections(b, b, h, 3)) == want
    assert {k[0] for k in collected(weights.sparse_connections(b, b, None, 3, directions=("input",)))} == {"input"}


def sparse_batch(rows):
    """(asks, layer, neuron, {d: value}) as a batch of one side."""
    import pyarrow as pa

    columns = [[1] * len(rows), [0] * len(rows), *([r[i] for r in rows] for i in range(3)), [list(r[3]) for r in rows], [list(r[3].values()) for r in rows]]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    names = ["to_layer", "side", "asks", "layer", "neuron", "dims", "values"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


@pytest.mark.parametrize("cost", [0, 400, 10**9])  # Products listed, whichever is less, blocks multiplied.
@pytest.mark.parametrize("odd", [None, np.inf, np.nan])
def test_sparse_pairs_stay_in_their_task(monkeypatch, cost, odd):
    """Only the lists leave a side; pairs without a shared dimension are on none, pairs that cancel to 0 are."""
    monkeypatch.setattr(weights, "LISTED_COST", cost)
    monkeypatch.setattr(weights, "LISTED", 50)
    monkeypatch.setattr(weights, "SLAB", 3)
    rng = np.random.default_rng(8)
    vector = lambda: {int(d) * 1000: float(rng.integers(-2, 3)) for d in sorted(rng.choice(12, rng.integers(1, 5), False))}
    side, asks = [vector() for _ in range(60)], [vector() for _ in range(17)]
    if odd is not None:
        side[3][min(side[3])] = odd
    batch = sparse_batch([(False, 1, i, v) for i, v in enumerate(side)] + [(True, 0, i, v) for i, v in enumerate(asks)])
    got = {}
    for b in weights._search(4, 8, form=weights._Sparse)([batch]):
        for sign, neuron, name, weight in zip(*(b.column(c).to_pylist() for c in ("sign", "neuron", "to_neuron", "weight"))):
            got.setdefault((sign, neuron), []).append((weight, name))
    for i, own in enumerate(asks):
        met = [(sum(own[d] * v[d] for d in own.keys() & v.keys()), j) for j, v in enumerate(side) if own.keys() & v.keys()]
        for sign, factor in (("positive", -1), ("negative", 1)):
            best = sorted(met, key=lambda m: (np.isnan(m[0]), 0 if np.isnan(m[0]) else factor * m[0], m[1]))[:4]
            assert str([(w + 0.0, n) for w, n in got.get((sign, i), [])]) == str([(w + 0.0, n) for w, n in best])


def test_rows_travel_to_few_sides(spark, monkeypatch):
    """Rows dealt to tasks, for a table of many blocks: each goes to a few sides or parts, not to one per few blocks."""
    def passed(*_):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                n = batch.num_rows
                columns = [pa.array(["positive"] * n), batch.column(3), batch.column(4), batch.column(0), batch.column(4), pa.array([0.0] * n)]
                yield pa.RecordBatch.from_arrays(columns, ["sign", "layer", "neuron", "to_layer", "to_neuron", "weight"])

        return run

    monkeypatch.setattr(weights, "_search", passed)
    rows = spark.range(2000).selectExpr("0 AS layer", "id AS neuron", "array(1.0D, 2.0D) AS vector")
    found = weights.strongest_connections(rows, rows, None, 10**6, 4, False, ("output",))
    assert found.count() <= 16 * 2000


def test_equal_vectors_are_searched_once(monkeypatch):
    """Of many copies only as many as a list holds are multiplied; near ones are told apart exactly."""
    import pyarrow as pa

    near = [[1.0, 1.0 + i * 1e-13] for i in range(6)]
    vectors = [[1.0, 1.0]] * 500 + near
    rows = [(1, 0, False, 1, i, v) for i, v in enumerate(vectors)] + [(1, 0, True, 0, 0, [3.0, 1.0])]
    names = ("to_layer", "side", "asks", "layer", "neuron", "vector")
    batch = pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})
    seen = []
    see = weights._Strongest.see
    monkeypatch.setattr(weights._Strongest, "see", lambda self, product, names: (seen.append(len(names)), see(self, product, names))[1])
    lists = {b.column(0)[0].as_py(): b.column(4).to_pylist() for b in weights._search(4, 8)([batch])}
    assert sum(seen) <= 2 * (4 + 6)
    assert lists == {"positive": [505, 504, 503, 502], "negative": [0, 1, 2, 3]}


def test_missing_layers_connect_with_nothing(spark):
    rows = [(0, 1, [1.0]), (1, 2, [2.0]), (None, 3, [5.0])]
    table = spark.createDataFrame(rows, "layer INT, neuron BIGINT, vector ARRAY<DOUBLE>")
    found = weights.strongest_connections(table, table, None, 3, signs=("negative",)).collect()
    assert {(r["direction"], r["sign"], r["neuron"], r["to_neuron"]) for r in found} == {("output", "negative", 1, 2), ("input", "negative", 2, 1)}


def test_copies_of_a_row_do_not_grow_with_the_table(spark, monkeypatch):
    """Rows dealt: twice the root of the tasks per row at most, and ten times as many for ten times the table."""
    def passed(*_):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                n = batch.num_rows
                columns = [pa.array(["positive"] * n), batch.column(3), batch.column(4), batch.column(0), pa.array(range(n), pa.int64()), pa.array([0.0] * n)]
                yield pa.RecordBatch.from_arrays(columns, ["sign", "layer", "neuron", "to_layer", "to_neuron", "weight"])

        return run

    monkeypatch.setattr(weights, "_search", passed)

    def dealt(n):
        rows = spark.range(n).selectExpr("0 AS layer", "id AS neuron", "array_repeat(1.0D, 512) AS vector")
        # Lists longer than any row's copies, so that every copy is counted.
        return weights.strongest_connections(rows, rows, None, 20, 4, False, ("output",), ("positive",)).count()

    tasks = 2 * spark.sparkContext.defaultParallelism
    assert dealt(100) <= 100 * (2 * tasks**0.5 + 2)
    assert dealt(1000) <= 10 * dealt(100)


@pytest.mark.parametrize("repeated", [1, 40])
def test_lists_of_many_sides_are_merged(spark, repeated):
    """Candidates come from several sides; neurons that occur more than once share one list."""
    rng = np.random.default_rng(12)
    side = [(1, i, rng.normal(size=3).tolist()) for i in range(90)]
    asks = [(0, i // repeated, rng.normal(size=3).tolist()) for i in range(80)]
    shape = "layer INT, neuron BIGINT, vector ARRAY<DOUBLE>"
    found = collected(weights.strongest_connections(spark.createDataFrame(asks, shape), spark.createDataFrame(side, shape), None, 3, 2, directions=("output",)))
    assert len(found) == 80 // repeated * 2 * 3
    for neuron in range(80 // repeated):
        met = [(float(np.dot(v, w)), j) for _, i, v in asks if i == neuron for _, j, w in side]
        for sign, factor in (("positive", -1), ("negative", 1)):
            best = sorted(met, key=lambda m: (factor * m[0], m[1]))[:3]
            assert [found["output", sign, 0, neuron, r] for r in (1, 2, 3)] == [(1, j, round(w, 9)) for w, j in best]


def test_sides_and_parts_stay_bounded():
    """Few bytes moved for the wanted tasks, but no side or part beyond its bounds, however many rows there are."""
    wide = weights.SIDE_BYTES // (8 * weights.BLOCK)  # A side holds one block of such vectors.
    for rows, asks, width in ((10**4, 10**4, 64), (10**6, 10**4, 64), (10**4, 10**6, 64), (10**7, 10**7, 64), (5000, 300_000, wide)):
        sides, parts = weights._shape((rows, width), (asks, width), 24, 20, weights.BLOCK)
        assert rows / sides <= min(weights.BLOCK * weights.SIDE_BLOCKS, weights.SIDE_BYTES / (8 * width))
        assert asks / parts <= min(weights.BLOCK * weights.PART_BLOCKS, weights.PART_BYTES / (8 * width))
        assert sides * parts >= 24
