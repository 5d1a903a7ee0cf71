import math
import random

import pytest

from axonframe.operators import responses
from axonframe.schemas import RESPONSE

TABLE = f"k INT, tokens ARRAY<STRING>, response {RESPONSE}"


def echo(spark, cases):
    """cases: (tokens, seen response tokens, log probabilities at 'unknown' marks)."""
    rows = []
    for k, (tokens, seen, top) in enumerate(cases):
        text, offsets, at = "", [], []
        plain = iter(top)
        for s in seen:
            offsets.append(len(text))
            text += s
            at.append(next(plain) if s == "unknown" else {})
        rows.append((k, tokens, ([(text, (text,), (seen, at, offsets))],)))
    return spark.createDataFrame(rows, TABLE)


END = ["\n", "<", "end", ">", "\n"]
LP = {"3": math.log(0.75), "4": math.log(0.25), "x": -0.1}
FIVE = {"5": -1.0}


def test_alignment_cases(spark):
    line = lambda *t: [*t, "\t", "unknown"]
    cases = [
        # An earlier table before the start mark must not count.
        (["a", "b"], [*line("a"), "<start>", "\n", *line("a"), "\n", *line("b"), *END], [FIVE, LP, FIVE]),
        # A token split into three, a token with a newline folded in.
        (["hello", "b"], ["<start>", "\n", *line("he", "ll", "o"), *line("\nb"), *END], [LP, FIVE]),
        # A split character given as bytes, after text; and a whole token given as bytes.
        (["é", "ü!"], ["<start>", "\n", *line("bytes:\\xc3", "bytes:\\xa9"), "\n", *line("bytes:\\xc3", "bytes:\\xbc!"), *END], [LP, FIVE]),
        # A tab that is itself a token; no valid level.
        (["\t", "c"], ["<start>", "\n", "\t", "\t", "unknown", "\n", "\t", "c", "\t", "unknown", *END], [LP, {"x": -1.0}]),
        # Fewer lines than tokens.
        (["a", "b", "c"], ["<start>", "\n", *line("a")], [LP]),
        # No start mark at all: every line counts.
        (["a"], ["\n", *line("a"), *END], [FIVE]),
    ]
    found = {r["k"]: r for r in responses.parse_echo_responses(echo(spark, cases)).collect()}
    expected = {0: [3.25, 5.0], 1: [3.25, 0.0], 2: [3.25, 5.0], 3: [3.25, 0.0], 4: [3.25], 5: [5.0]}
    for k, values in expected.items():
        assert found[k]["expected"] == pytest.approx(values), k
        assert found[k]["tokens"] == cases[k][0][: len(values)]
    assert found[0]["dist_values"][0] == [3.0, 4.0] and found[0]["dist_probs"][0] == pytest.approx([0.75, 0.25])
    assert found[1]["dist_values"][1] == [] and found[3]["dist_probs"][1] == []
    assert found[0]["scale"] == "simulated_normalized_activations"


@pytest.mark.parametrize("tokens,seen,message", [
    (["a"], ["<start>", "\n", "z", "\t", "unknown", *END], "does not match token 0"),
    (["a"], ["<start>", "\n", "a", "\t", "unknown", "\n", "b", "\t"], "no end mark"),
])
def test_alignment_errors(spark, tokens, seen, message):
    with pytest.raises(Exception, match=message):
        responses.parse_echo_responses(echo(spark, [(tokens, seen, [LP])])).collect()


def plain_model(completion, tokens):
    lines = completion.strip("\n").split("༗\n")
    start = next((i for i, line in enumerate(lines) if line.startswith(f"{tokens[0]}\t")), None)
    if start is None or len(lines) - start != len(tokens):
        return [0] * len(tokens)
    out = []
    for line, token in zip(lines[start:], tokens):
        if not line.startswith(f"{token}\t"):
            return [0] * len(tokens)
        field = line.split("\t")[1]
        out.append(int(field) if field in responses.LEVEL_TOKENS else 0)
    return out


def test_plain_completions(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for k in range(400):
        tokens = [rng.choice(["a", "b", " c", "d\te", "f\n", "."]) for _ in range(rng.randrange(1, 6))]
        said = [t if rng.random() < 0.95 else "?" for t in tokens]
        body = "".join(f"{t}\t{rng.choice(['0', '7', '10', '11', 'x', ''])}༗\n" for t in said)
        style = rng.randrange(4)
        completion = ["", "\n", "intro༗\n", "no tab\n"][style] + (body if rng.random() < 0.5 else body[:-2])
        rows.append((k, tokens, ([(None, (completion,), None)],)))
        expected[k] = plain_model(completion, tokens)
    found = responses.parse_plain_responses(spark.createDataFrame(rows, TABLE)).collect()
    assert {r["k"]: [int(v) for v in r["expected"]] for r in found} == expected
    assert sum(any(v) for v in expected.values()) > 80


def test_lenient_mode_keeps_the_last_level(spark):
    rows = [(0, ["a", "b"], ([(None, ("a\t3༗\nb\t4༗\n",), None)],))]
    table = spark.createDataFrame(rows, TABLE)
    assert responses.parse_plain_responses(table).first()["expected"] == [3.0, 0.0]
    assert responses.parse_plain_responses(table, strict=False).first()["expected"] == [3.0, 4.0]


def test_single_token_responses_keep_their_order(spark):
    rows = [(1, p, f"t{p}", ([(None, None, (None, [{str(p): -0.5, "?": -0.1}], None))],)) for p in (2, 0, 1)]
    table = spark.createDataFrame(rows, f"k INT, pos INT, token STRING, response {RESPONSE}").repartition(3)
    row = responses.parse_token_responses(table, ["k"]).first()
    assert row["tokens"] == ["t0", "t1", "t2"] and row["expected"] == [0.0, 1.0, 2.0]
