from pyspark.sql import functions as F

from axonframe.llm.merkle import audit, manifest

SCHEMA = "id BIGINT, payload STRING"


def audited(spark, a, b):
    sides = [manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", F.col("payload")) for rows in (a, b)]
    return sorted((str(r.id), r.kind, r.start, r.stop) for r in audit(*sides).collect())


def test_locates_every_fault(spark):
    a = [(i, f"payload {i}") for i in list(range(-100, 9000, 3)) + [10**15, 10**15 + 1]]
    b = [(i, p + "!" if i in (50, 8999) else p[:-1] + "#" if i in (-100, 4097, 10**15) else p) for i, p in a if i not in (2, 5000)] + [(78, "new")]
    place = {}
    for i, p in sorted(a):
        start = max((place[j][1] for j in [place.get(("last", i // 4096), None)] if j is not None), default=0)
        place[i] = (start, start + len(p))
        place[("last", i // 4096)] = i
    kinds = dict((k, s) for k, s, _, _ in audited(spark, a, b))
    other, ends = dict(b), {}
    for i, p in sorted(b):
        start = ends.get(i // 4096, 0)
        place[("b", i)] = start
        ends[i // 4096] = start + len(p)
    want = {}
    for i, p in a:
        if i not in other:
            want[str(i)] = "missing"
        elif other[i] != p:
            want[str(i)] = "changed"
        elif place[i][0] != place[("b", i)]:
            want[str(i)] = "moved"
    want["78"] = "extra"
    assert kinds == want
    rows = audited(spark, a, b)
    assert ("50", "changed", *place[50]) in rows


def test_equal_empty_and_odd_rows(spark):
    rows = [(1, "a"), (1, "b"), (2, None), (None, "x"), (3, ""), (4, "long " * 50_000)]
    assert audited(spark, rows, rows[::-1]) == [] and audited(spark, [], []) == []
    assert audited(spark, rows, rows + [(1, "b")])[0][:2] == ("1", "copies")
    assert audited(spark, rows, [r for r in rows if r[0] is not None]) == [("None", "missing", 0, 1)]
    assert [r[1] for r in audited(spark, rows, [])] == ["missing"] * 5
