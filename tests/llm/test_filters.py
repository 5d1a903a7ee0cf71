import random

import numpy as np
from pyspark.sql import functions as F

from axonframe.llm.license_scan import NOTICES, TEMPLATES, Hasher, Index, aligned, all_templates, license_scan
from axonframe.llm.toxicity import OrdinalModel, _hash, accepted, choose_features, fit_ordinal, labelled_sample, severity, toxicity_model

WORDS = [a + b for a in ("river", "stone", "cloud", "lamp", "green") for b in ("", "s", "ly", "ish", "er", "ing")]


def graded_texts(rng, n):
    bad = ["vile", "nasty", "rotten"]
    out = []
    for _ in range(n):
        grade = rng.choice((0, 0, 0, 1, 2))
        words = [rng.choice(WORDS) for _ in range(rng.randrange(10, 80))]
        for _ in range(grade * 4):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((" ".join(words), grade))
    return out


def test_held_out_grades(spark):
    rng = random.Random(1)
    train = spark.createDataFrame(graded_texts(rng, 600), "text STRING, grade INT")
    model = fit_ordinal(train)
    assert (np.diff(model.thresholds) > 0).all()
    rows = graded_texts(rng, 200)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id BIGINT, text STRING")
    found = {r.row_id: r for r in severity(docs, model).collect()}
    right = sum(found[i].grade == g for i, (_, g) in enumerate(rows))
    assert right >= 190
    means = [np.mean([found[i].expected_severity for i, (_, g) in enumerate(rows) if g == k]) for k in range(3)]
    assert means[0] < 0.2 < means[1] < means[2]


def likelihood(model, rows, weights):
    """Logarithm of the weighed likelihood of the grades, straight from their definition, less the fit's penalty."""
    score = np.array([sum(w * np.log1p(n) for w, n in zip(weights, counts)) for counts, _ in rows])
    above = 1 / (1 + np.exp(model[None, :] - score[:, None]))
    reached = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
    grades = np.array([g for _, g in rows])
    return np.mean(np.log(reached[np.arange(len(rows)), grades] - reached[np.arange(len(rows)), grades + 1])) - 1e-4 / 2 * (weights**2).sum()


def test_fit_is_the_most_likely_one(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        counts = (rng.randrange(5), rng.randrange(5))
        rows.append((counts, min(2, max(0, round(0.8 * counts[0] - 0.3 * counts[1] + rng.gauss(0, 0.9))))))
    texts = [(" ".join(["vile"] * a + ["calm"] * b), g) for (a, b), g in rows]
    features = np.array(sorted(_hash("w" + w) for w in ("vile", "calm")), np.int64)
    model = fit_ordinal(spark.createDataFrame(texts, "text STRING, grade INT"), features)
    at = [int(np.searchsorted(features, _hash("w" + w))) for w in ("vile", "calm")]
    weights, best = model.weights[at], model.thresholds
    most = likelihood(best, rows, weights)
    assert weights[0] > 0 > weights[1] and most > -1.0
    moves = np.random.default_rng(1).normal(size=(200, 4))
    for size in (0.3, 0.03):
        for move in size * moves:
            assert likelihood(np.sort(best + move[:2]), rows, weights + move[2:]) <= most + 1e-5


def test_labels_to_decisions(spark, make_docs):
    rng = random.Random(2)
    rows = graded_texts(rng, 400)
    docs = make_docs([t for t, _ in rows])
    labels = spark.createDataFrame([(i, 1, int(g > 0)) for i, (_, g) in enumerate(rows) if i % 2] + [(None, 1, 1), (0, 1, None), (2, 1, 0), (2, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    model = toxicity_model(docs, labels)
    kept = {r.doc_id for r in accepted(docs, model).collect()}
    assert sum((g == 0) == (i in kept) for i, (_, g) in enumerate(rows)) >= 396
    assert accepted(docs, model).columns == docs.columns
    assert len(toxicity_model(docs, labels, most=1).features) == 1


def test_bounded_sample_rejects_like_all_labels(spark, make_docs):
    rng = random.Random(3)
    texts, toxic = [], []
    for _ in range(4000):
        # Words that both sides use: documents with two or three of them are near the border.
        words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(30)]
        mild = rng.choice((0, 0, 0, 0, 1, 2, 3, 4))
        words[:mild] = ["vile", "nasty", "rotten", "foul"][:mild]
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(rng.random() < (0.01, 0.05, 0.2, 0.4, 0.9)[mild]))
    docs = make_docs(texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id BIGINT, toxic INT")
    scores = [{r.row_id: r.p_toxic for r in severity(docs, toxicity_model(docs, labels, bound)).collect()} for bound in (600, 8000)]
    dropped = [{i for i, p in found.items() if p >= 0.5} for found in scores]
    assert len(dropped[1]) > 300
    assert len(dropped[0] ^ dropped[1]) <= len(dropped[1]) // 10, [len(d) for d in dropped]
    assert abs(np.mean(list(scores[0].values())) - np.mean(toxic)) < 0.03
    sample = labelled_sample(docs, labels, 600)
    assert abs(sample.where("toxic = 0").agg(F.sum("weight")).first()[0] / toxic.count(0) - 1) < 0.05


def test_no_labels_and_odd_rows(spark, make_docs):
    empty = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    docs = make_docs([(1, None), (None, ""), (1, "x " * 5000), (2, "a")]).withColumn("row_id", F.lit("q")).withColumn("grade", F.lit(5))
    model = toxicity_model(docs, empty)
    assert [r.grade for r in severity(docs, model).collect()] == [0] * 4
    assert accepted(docs, model).count() == 4 and severity(make_docs([]), model).count() == 0
    one = spark.createDataFrame([("a b", 1)], "text STRING, grade INT")
    assert len(choose_features(one)) == 0 and isinstance(fit_ordinal(one), OrdinalModel)


def test_license_notices(make_docs):
    rng = random.Random(5)
    words = "river stone under the license cloud version of public".split()
    texts, want = [], []
    for i in range(120):
        before = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        name = rng.choice(sorted(TEMPLATES))
        notice = TEMPLATES[name].split()
        if i % 3 == 1 and len(notice) >= 10:
            notice.insert(5, "extra")
            del notice[8]
        after = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        texts.append(" ".join([*before, *notice, *after]) if i % 4 else " ".join(before))
        want.append((name, len(" ".join(before)) + bool(before), " ".join(notice)) if i % 4 else None)
    found = {}
    for r in license_scan(make_docs(texts)).collect():
        found.setdefault(r.row_id, []).append(r)
    for i, expected in enumerate(want):
        rows = [r for r in found.get(i, []) if expected and r.license == expected[0]]
        if expected:
            assert len(rows) == 1 and rows[0].coverage >= 0.8, (i, expected, found.get(i))
            assert abs(rows[0].start - expected[1]) <= 8 and abs(rows[0].stop - rows[0].start - len(expected[2])) <= 30
        else:
            assert not any(r.coverage == 1.0 for r in found.get(i, []))


def test_license_odd_rows(make_docs):
    notice = TEMPLATES["MIT"]
    docs = make_docs([(None, notice), (1, None), (2, ""), (3, notice + "; " + notice.upper() + "!"), (4, "x " * 20_000 + notice)]).withColumn("license", F.lit(1))
    rows = license_scan(docs).collect()
    assert sorted((str(r.row_id), r.start, r.matched) for r in rows) == [("3", 0, 5), ("3", 32, 5), ("4", 40_000, 5), ("None", 0, 5)]
    assert license_scan(make_docs([])).count() == 0


def test_license_edits_reach_the_alignment():
    templates = {**TEMPLATES, **NOTICES}
    index, hasher = Index(templates), Hasher()
    around = "river stone cloud lamp".split()
    for at, name in enumerate(index.names):
        words = templates[name].split()
        edits = [words]
        for i in range(len(words)):
            edits += [words[:i] + words[i + 1 :], words[:i] + ["changed"] + words[i + 1 :], words[:i] + ["added"] + words[i:]]
        # One more word before each: no two words of the template are neighbours.
        edits.append([w for word in words for w in ("added", word)][: 2 * 8])
        for edit in edits:
            hashes = hasher.of([*around, *edit, *around])
            hashes = hashes[hashes != 0]
            plain = max(aligned(index.words[at], hashes, begin)[0] for begin in range(2, 8))
            found = index.found(hashes).get(at, [])
            assert bool(found) == (plain >= 0.8 * len(index.words[at])), (name, edit)
            assert not found or -min(found)[0] >= plain


def test_short_license_edits(make_docs):
    docs = make_docs([
        "Released under MIT License", "Licensed under the Apach License, Version 2.0", "Released under the terms of the MIT License",
        "Licensed under a CC BY-NC 4.0", "Released now under some the good MIT old License", "under the License",
    ])
    found = {r.row_id: (r.license, r.matched) for r in license_scan(docs).collect()}
    assert found == {0: ("MIT", 4), 1: ("Apache-2.0", 6), 2: ("MIT", 5), 3: ("CC-BY-NC-4.0", 5), 4: ("MIT", 5)}


def test_whole_license_texts(make_docs):
    rng = random.Random(6)
    wholes = {name: text for name, text in all_templates().items() if name.endswith("-text")}
    assert len(wholes) >= 25
    texts, want = [], []
    for name, text in sorted(wholes.items()):
        words = text.split()
        for _ in range(len(words) // 40):
            words[rng.randrange(len(words))] = "changed"
        before, after = ([rng.choice(WORDS) for _ in range(rng.randrange(400))] for _ in range(2))
        texts.append(" ".join([*before, *words, *after]))
        want.append((name, len(" ".join(before)) + bool(before), len(" ".join(words))))
    found = license_scan(make_docs(texts)).collect()
    for i, (name, start, size) in enumerate(want):
        rows = [r for r in found if r.row_id == i and r.license.endswith("-text")]
        assert [r.license for r in rows] == [name], (name, rows)
        assert 0.9 < rows[0].coverage <= 1 and abs(rows[0].start - start) <= 40 and abs(rows[0].stop - rows[0].start - size) <= 80


def test_license_copies_names_and_tags(make_docs):
    mit = all_templates()["MIT-text"].strip()
    docs = make_docs([mit + "\n\n" + mit, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) */", "under the GNU Lesser General Public License", "Dual: ISC License, CC0 1.0 or The Unlicense"])
    rows = license_scan(docs).collect()
    assert sorted((r.start, r.stop) for r in rows if r.license == "MIT-text") == [(0, len(mit)), (len(mit) + 2, 2 * len(mit) + 2)]
    assert {r.license for r in rows if r.row_id == 1} == {"MIT", "GPL-2.0-only", "Classpath-exception-2.0"}
    assert {r.license for r in rows if r.row_id == 2} == {"LGPL-name"}
    assert {r.license for r in rows if r.row_id == 3} == {"ISC-name", "CC0-1.0-name", "Unlicense-name"}
