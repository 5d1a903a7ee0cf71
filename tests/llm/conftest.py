import random

import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = "the of and to in river stone cloud lamp green table orbit candle mirror garden window paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (id, text); with the columns of the documents table."""

    def build(texts, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS).repartition(partitions) if rows else spark.createDataFrame([], DOCS)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty, blank, short and long ones."""
    rng = random.Random(7)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.choice((3, 4, 5, 8, 30, 120, 400))) for _ in range(60)]
    for i in range(0, 30, 2):
        words = texts[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[i])
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 25)}" for _ in range(25)]
    texts += [None, "", "   \n\t ", "one", "One", "a b c d", "A b\nc  d", "x " * 200, "naïve Ünïcode 東京 😀 text", " lead and trail \n", prose(rng, 6000)]
    return texts
