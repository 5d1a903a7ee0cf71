import random
import re

from pyspark.sql import functions as F

from axonframe.llm.pii import BASE, KINDS, find_pii, masked, spans_text

IBAN = next(k for k in KINDS if k.name == "iban")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def bare(text):
    return re.sub("[^0-9]", "", text)


BASES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(bare(m)) <= 19 and luhn(bare(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(bare(m)) <= 15),
]


def brute(text):
    found = [(m.start(), i, name, m.end()) for i, (name, pattern, valid) in enumerate(BASES) for m in re.finditer(pattern, text or "") if valid(m.group())]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))


def base_spans(docs):
    rows = find_pii(docs).select("row_id", spans_text(F.filter("spans", lambda s: s["kind"].isin(*BASE))).alias("s")).collect()
    return {r.row_id: r.s for r in rows}


def test_base_kinds_equal_brute_force(make_docs):
    rng = random.Random(1)
    parts = ["a@b.co", "x.y_z+1@mail-a.example.org", "@", "a@b", "a@b.com_x@d.org", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.255", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "4012888888881881", "+1 (212) 555-0100", "+12", "+1 (", "++44 20 7946 0958", "12 34", "5  6", "é😀", "东京 1.1.1.1", "\n", ".", "-", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "x"]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -.+@()a") for _ in range(80)) for _ in range(400)] + [None, "", "plain"]
    found = base_spans(make_docs(texts))
    for i, text in enumerate(texts):
        assert found[i] == brute(text), repr(text)


def test_very_long_runs(make_docs):
    """No recursion and no squared time on runs of one character class; brute force checks shorter ones."""
    runs = lambda n: ["1" * n, "1 " * n, "a" * n, "1." * n, "+1" + " " * n, "a@" + "b." * n + "c"]
    found = base_spans(make_docs(runs(1500)))
    for i, text in enumerate(runs(1500)):
        assert found[i] == brute(text)
    assert len(base_spans(make_docs([*runs(100_000), "1.2.3.4 " * 3_000]))) == 7


def test_account_numbers_and_context(make_docs):
    texts = ["iban DE89 3704 0044 0532 0130 00 end", "GB82WEST12345698765432", "iban DE88 3704 0044 0532 0130 00", "call 212-555-0100 now", "order 212-555-0100 now"]
    rows = {r.row_id: r.spans for r in find_pii(make_docs(texts)).collect()}
    assert [(s.kind, s.start, s.stop) for s in rows[0]] == [("iban", 5, 32)] and rows[0][0].score == 1.0
    assert [s.kind for s in rows[1]] == ["iban"] and [s.kind for s in rows[2]] == []
    assert [s.kind for s in rows[3]] == ["number"] and rows[4] == []


def test_whole_context_words_on_both_sides(make_docs):
    far = "x" * 60
    cases = [
        ("call me now 212-555-0100", 1), ("phone in november: 212-555-0100", 1), ("212-555-0100 is my phone", 1), ("recall 212-555-0100", 0),
        ("callers 212-555-0100", 0), ("212-555-0100", 0), (f"call {far} 212-555-0100", 0), ("call: order no 212-555-0100", 0), ("TEL212-555-0100", 1),
        (f"{'a' * 30} tel {'b' * 34} 212-555-0100", 1), (f"xxtel {'b' * 35} 212-555-0100", 0), (f"212-555-0100 {'b' * 35} tela", 0),
    ]
    rows = {r.row_id: r.spans for r in find_pii(make_docs([text for text, _ in cases])).collect()}
    for i, (text, n) in enumerate(cases):
        assert [s.kind for s in rows[i]] == ["number"] * n, text
    scores = {r.row_id: r.spans[0].score for r in find_pii(make_docs(["ipsum 1.2.3.4", "ip 1.2.3.4", "1.2.3.4 is a version"])).collect()}
    assert scores[0] == 0.6 and abs(scores[1] - 0.85) < 1e-9 and abs(scores[2] - 0.35) < 1e-9


def test_account_numbers_have_their_countrys_length(make_docs):
    def account(country, body):
        digits = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(digits) % 97:02d}{body}"

    texts = [account("DE", "1" * 18), account("DE", "1" * 16), account("NO", "1" * 11), account("ZZ", "1" * 16)]
    rows = {r.row_id: len(r.spans) for r in find_pii(make_docs([f"iban {t} end" for t in texts]), kinds=(IBAN,)).collect()}
    assert rows == {0: 1, 1: 0, 2: 1, 3: 1}


def test_masks_and_odd_rows(make_docs):
    docs = make_docs([(1, "mail a@b.co, ip 1.2.3.4!"), (1, "mail a@b.co, ip 1.2.3.4!"), (None, None), (2, "none")]).withColumn("spans", F.lit(1)).withColumn("row_id", F.lit("x"))
    rows = find_pii(docs).select("row_id", masked(F.col("text"), F.col("spans")).alias("t")).collect()
    assert sorted((str(r.row_id), r.t) for r in rows) == [("1", "mail <email>, ip <ip>!")] * 2 + [("2", "none"), ("None", "")]
    assert find_pii(make_docs([])).count() == 0


def test_no_python_in_the_plan(make_docs):
    plan = find_pii(make_docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
