import random

import numpy as np
import pytest

from axonframe.llm.license_scan import NOTICES, TEMPLATES, Fingerprints, Hasher, Index, Wholes, all_templates, license_scan, longest_run, needed_words, winnowed

OTHER = "river stone cloud lamp garden window mirror candle orbit paper".split()


def whole_texts():
    return {name: text for name, text in all_templates().items() if name.endswith("-text")}


def hashed(texts):
    hasher = Hasher()
    found = [hasher.of(text.split()) for text in texts]
    return [h[h != 0] for h in found]


def common_words(a, b):
    """Longest common subsequence by the full table, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        step = np.where(b == word, row[:-1] + 1, row[1:])
        row = np.concatenate([[0], np.maximum.accumulate(step)])
    return int(row[-1])


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_each_window_keeps_a_place(size):
    order = np.random.default_rng(size).permutation(200)
    places = set(winnowed(order, size).tolist())
    assert all(any(i + j in places for j in range(size)) for i in range(200 - size + 1))
    assert len(places) < 200 or size < 3


@pytest.mark.parametrize("coverage", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("grams_of, texts", [(1, {**TEMPLATES, **NOTICES}), (2, whole_texts())])
def test_matches_hold_enough_selected_grams(coverage, grams_of, texts):
    words = hashed(texts[name] for name in sorted(texts))
    needed = [needed_words(len(w), coverage) for w in words]
    prints = Fingerprints(words, needed, grams_of)
    rng = random.Random(4)
    for i, w in enumerate(words):
        missing = len(w) - needed[i]
        step = longest_run(len(w), needed[i]) + 1
        for lost in (list(range(step - 1, len(w), step))[:missing], rng.sample(range(len(w)), missing), list(range(missing))):
            left = w.copy()
            left[lost] = 1  # No word's hash.
            at, entry = prints.hits(left)
            own = {int(p) for x, p, t in zip(at, prints.place[entry], prints.template[entry]) if t == i and p == x}
            assert len(own) >= prints.required[i] >= 1, (i, lost)


def test_edited_whole_texts_against_the_full_table():
    rng = random.Random(8)
    texts = {name: text for name, text in whole_texts().items() if len(text.split()) < 1500}
    wholes = Wholes(texts, 0.8)
    hasher = Hasher()
    decided = [0, 0]
    for at, name in enumerate(wholes.names):
        for share in (0.0, 0.05, 0.1, 0.15, 0.3):
            words = texts[name].split()
            for _ in range(int(share * len(words))):
                i, kind = rng.randrange(len(words)), rng.randrange(4)
                words[i : i + 1] = [[], ["changed"], ["changed"], ["added", words[i]]][kind]
            around = [rng.choice(OTHER) for _ in range(200)]
            bare = hasher.of([*around, *words, *around])
            bare = bare[bare != 0]
            most = common_words(np.array(wholes.words[at], np.uint64), bare)
            found = wholes.found(bare).get(at, [])
            assert bool(found) == (most >= wholes.needed[at]), (name, share, most, wholes.needed[at])
            assert not found or 0.99 * most <= -found[0][0] <= most
            decided[bool(found)] += 1
    assert min(decided) > 5


def test_interrupted_texts_and_copies(make_docs):
    texts = whole_texts()
    rng = random.Random(9)
    rows, want = [], []
    for name in ("MIT-text", "BSD-3-Clause-text", "Apache-2.0-text", "GPL-2.0-text"):
        words = texts[name].split()
        half = len(words) // 2
        between = [rng.choice(OTHER) for _ in range(half)]
        rows.append(" ".join([*words[:half], *between, *words[half:]]))
        want.append((len(rows) - 1, name, 1.0, 0, len(rows[-1])))
        whole = " ".join(words)
        rows.append(" ".join([whole, *between, whole, whole]))
        second = len(whole) + 2 + len(" ".join(between))
        want += [(len(rows) - 1, name, 1.0, start, start + len(whole)) for start in (0, second, second + len(whole) + 1)]
    found = license_scan(make_docs(rows), texts).collect()
    assert sorted((r.row_id, r.license, r.coverage, r.start, r.stop) for r in found) == sorted(want)


def test_templates_without_words_or_that_repeat_themselves(make_docs):
    templates = {"none": "", "signs": "-- ++", "again": "yes " * 60, "pairs": "to and fro " * 30}
    docs = make_docs(["yes " * 70, "to and fro " * 27, "to and fro " * 20, "nothing -- ++ here", ""])
    found = {(r.row_id, r.license, r.matched) for r in license_scan(docs, templates).collect()}
    assert found == {(0, "again", 60), (1, "pairs", 81)}
    assert license_scan(docs, {}).count() == 0
    assert Index({}).found(np.zeros(0, np.uint64)) == {} and Wholes({}, 0.8).found(np.ones(5, np.uint64)) == {}
