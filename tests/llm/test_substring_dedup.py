import re

from pyspark.sql import functions as F

import axonframe.llm.substring_dedup as dedup
from axonframe.llm.substring_dedup import substring_dedup


def brute(rows, length=20):
    seen, out = {}, {}
    for name, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        cover = [False] * len(words)
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                cover[i : i + length] = [True] * length
            seen.setdefault(key, (name, i))
        out[name] = (len(words), sum(cover), " ".join(w for w, c in zip(words, cover) if not c))
    return out


def result(docs, **options):
    return {r.row_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, **options).collect()}


def test_equals_brute_force(make_docs, corpus):
    rows = list(enumerate(corpus))
    assert result(make_docs(rows)) == brute(rows)
    assert result(make_docs(rows), length=3) == brute(rows, 3)


def test_collisions_lose_nothing(make_docs, corpus, monkeypatch):
    """A sketch that is far too small estimates nearly all windows as repeated."""
    monkeypatch.setattr(dedup, "MIN_BITS", 16)
    monkeypatch.setattr(dedup, "MAX_BITS", 16)
    rows = list(enumerate(corpus)) + [(1000 + i, " ".join(f"u{i}_{j}" for j in range(3000))) for i in range(40)]
    assert result(make_docs(rows)) == brute(rows)


def test_odd_rows(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    found = substring_dedup(make_docs([(3, text), (3, text), (1, None), (None, text), (2, "")])).collect()
    assert sorted((str(r.row_id), r.n_words, r.n_removed) for r in found) == [("1", 0, 0), ("2", 0, 0), ("3", 30, 0), ("3", 30, 0), ("None", 30, 30)]
    assert substring_dedup(make_docs([])).count() == 0
    clash = make_docs([text, text]).withColumn("window", F.lit(1)).withColumn("id", F.lit("x")).withColumn("rest", F.lit(2.0)).withColumn("owned", F.array(F.lit(1)))
    rows = {r.row_id: (r.n_removed, r.rest.id, r.rest.rest) for r in substring_dedup(clash).collect()}
    assert rows == {0: (0, "x", 2.0), 1: (30, "x", 2.0)}
