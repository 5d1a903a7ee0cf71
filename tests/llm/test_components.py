import random

from axonframe.llm.components import components
from axonframe.llm.tables import Scratch


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(160)]
    links += [(5000, 5000 + i) for i in range(1, 100)] + [(7, 7), (None, 3), (8000, None), (9000, 9000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(links, "a BIGINT, b BIGINT"), Scratch(spark, "test"), "c").collect()
    assert {(r.node, r.root) for r in found} == {(x, find(x)) for x in parent} and len(found) == len(parent)
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT"), Scratch(spark, "test"), "c").count() == 0
