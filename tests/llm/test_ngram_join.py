from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import axonframe.llm.ngram_join as ngram
from axonframe.llm.ngram_join import ngram_join
from axonframe.llm.signature_tree import Forest, bitmap, united


def sets_of(texts, length=5):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set())
    return out


def brute(ids, texts, percent=80):
    sets = sets_of(texts)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, name in enumerate(ids):
        least[find(i)].append(name)
    return {(name, len(sets[i]), min(least[find(i)])) for i, name in enumerate(ids)}


def result(docs, **options):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, **options).collect()}


def test_equals_brute_force(make_docs, corpus):
    assert result(make_docs(corpus)) == brute(range(len(corpus)), corpus)


def test_hot_passages_and_small_bounds(make_docs, corpus, monkeypatch):
    """With tiny bounds every group is cut into cells and every block into links to one class."""
    for name, value in (("BLOCK", 4), ("CELL_HASHES", 300), ("FREQUENT", 50), ("SHARED", 2)):
        monkeypatch.setattr(ngram, name, value)
    assert result(make_docs(corpus)) == brute(range(len(corpus)), corpus)


def test_chain_of_near_copies(make_docs):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[3 * i :] + [f"v{j}" for j in range(3 * i)]) for i in range(30)]
    ids = [100 - i for i in range(30)]
    assert result(make_docs(list(zip(ids, texts)))) == brute(ids, texts)


def test_odd_rows(make_docs, spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (None, None), (5, ""), (6, None)]
    found = ngram_join(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in found} == {(1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 0, None), (5, 0, 5), (6, 0, 6)}
    assert len(found) == 7
    assert ngram_join(make_docs([])).count() == 0
    clash = make_docs(["a b c d e f", "a b c d e f"]).withColumn("k", F.lit("x")).withColumn("shingle", F.lit(1)).withColumn("n", F.lit(None).cast("int"))
    assert {(r.doc_id, r.component_id) for r in ngram_join(clash).collect()} == {(0, 0), (1, 0)}


def test_near_copies_without_id(make_docs):
    words = [f"w{i}" for i in range(100)]

    def changed(*places):
        return " ".join("changed" + str(i) if i in places else w for i, w in enumerate(words))

    # Two documents that only a row without id connects, and near copies none of which has an id.
    other = [f"v{i}" for i in range(60)]
    rows = [(7, changed(10, 30)), (None, changed(30)), (3, changed(30, 60, 80)), (None, " ".join(other)), (None, " ".join(["x", *other]))]
    assert result(make_docs(rows[:1] + rows[2:3])) == {(7, 96, 7), (3, 96, 3)}
    found = [(r.doc_id, r.component_id) for r in ngram_join(make_docs(rows)).collect()]
    assert sorted(found, key=str) == sorted([(7, 3), (None, 3), (3, 3), (None, None), (None, None)], key=str)


def test_run_longer_than_a_batch_with_few_classes():
    size = 8 * ngram.BLOCK + 1
    keys = np.sort(np.concatenate([np.repeat(np.arange(9), size // 3 + 1)]))
    keys = np.concatenate([keys, [3, 4]])
    shingle = np.concatenate([np.full(len(keys) - 2, 5), [6, 6]])
    batches = [
        pa.RecordBatch.from_arrays([pa.array(shingle[i : i + size]), pa.array(np.full(len(keys[i : i + size]), -1, np.int32)), pa.array(keys[i : i + size])], ["shingle", "salt", "k"])
        for i in range(0, len(keys), size)
    ]
    assert len(batches) > 2
    out = [r for b in ngram._blocks(iter(batches)) for r in b.to_pylist()]
    assert {r["k"] for r in out if r["kind"] == "block"} == {3, 4}
    forest = Forest(9)
    for r in out:
        if r["kind"] == "star":
            forest.unite(r["k"], r["other"])
    hot = [r["k"] for r in out if r["kind"] == "hot"]
    for k in hot:
        forest.unite(hot[0], k)
    assert len(set(forest.roots(0, 9).tolist())) == 1


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > p], rng.integers(0, 2**63, int(len(base) * p)).astype(np.uint64)])) for p in rng.random(8) * 0.2]
    sets = sorted((s for s in sets if len(s)), key=len)

    def similar(i, j):
        common = len(np.intersect1d(sets[i], sets[j]))
        return 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common)

    tried = []
    forest = Forest(len(sets))
    united(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], 80, forest, lambda i, j: tried.append(1) or similar(i, j))
    other = Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if similar(i, j):
                other.unite(i, j)
    assert (forest.roots(0, len(sets)) == other.roots(0, len(sets))).all()
    assert len(tried) < len(sets) ** 2 / 20
