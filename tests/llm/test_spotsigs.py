import hashlib
import random

import pytest
from pyspark.sql import functions as F

import axonframe.llm.spotsigs as spots
from axonframe.llm.spotsigs import Spots, edited_fingerprints, fingerprints, jaccard, similar_prints


@pytest.mark.parametrize("size", [1 << 24, 4000])
def test_edited_texts(make_docs, corpus, monkeypatch, size):
    monkeypatch.setattr(spots, "RANGE_BYTES", size)
    rows = sorted((i * 7 % 211, t) for i, t in enumerate(corpus))
    found = {r.row_id: r for r in edited_fingerprints(make_docs(rows)).collect()}
    assert len(found) == len(rows)
    read = Spots()
    for at, (name, text) in enumerate(rows):
        text, following = text or "", rows[(at + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, new, other = read.of(text), read.of(edited), read.of(following)
        r = found[name]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (jaccard(own, new), jaccard(own, other))
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)


def test_odd_rows(make_docs):
    rows = [(r.row_id, r.n_chars, r.near_next) for r in edited_fingerprints(make_docs([(None, "z"), (4, None), (4, "the quick brown fox"), (9, "")])).collect()]
    assert sorted(rows, key=str) == sorted([(None, 1, 0.0), (4, 0, 0.0), (4, 19, 0.0), (9, 0, 0.0)], key=str)
    assert [(r.row_id, r.near_next) for r in edited_fingerprints(make_docs([(3, "alone in the dark blue night")])).collect()] == [(3, 1.0)]
    assert edited_fingerprints(make_docs([])).count() == 0
    clash = make_docs(["a", "b"]).withColumn("id", F.lit("x")).withColumn("range", F.lit(1)).withColumn("extra", F.lit(7))
    assert edited_fingerprints(clash).count() == 2


def spots_of(text):
    """The chains of a text, read off word by word."""
    words = [("".join(c for c in w.lower() if c.isalnum())) for w in text.split()]
    found = set()
    for i, word in enumerate(words):
        if word in spots.ANCHORS:
            chain = [w for w in words[i + 1 :] if w not in spots.ANCHORS and w.isalpha()][:3]
            if len(chain) == 3:
                found.add((word, *chain))
    return found or ({text} if text else set())


def likeness(a, b):
    return float(a == b) if not a or not b else len(a & b) / len(a | b)


def test_chains_word_by_word(make_docs, corpus):
    rows = [(i, t or "") for i, t in enumerate(corpus)]
    found = {r.row_id: r for r in edited_fingerprints(make_docs(rows)).collect()}
    for at, (name, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 4
        own = spots_of(text)
        assert len(found[name].fingerprint) == 8 * len(own)
        assert found[name].near_edited == likeness(own, spots_of(text[: len(text) - cut] + following[:cut]))
        assert found[name].near_next == likeness(own, spots_of(following))


def test_similar_prints(make_docs, corpus):
    rng = random.Random(3)
    texts = list(corpus)
    for length in (60, 90, 200, 400, 400):  # Long texts with one to three words changed: similar, not equal fingerprints.
        words = [rng.choice("the of and to in".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(length)]
        texts.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(length)] = "changed"
            texts.append(" ".join(words))
    prints = fingerprints(make_docs(texts))
    sets = {r.fingerprint: {r.fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)} for r in prints.collect() if r.fingerprint}
    names = sorted(sets)
    want = {frozenset((a, b)) for i, a in enumerate(names) for b in names[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = similar_prints(prints).collect()
    assert {frozenset((r.a, r.b)) for r in found} == want and len(found) == len(want) and len(want) > 5
