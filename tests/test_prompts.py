import pytest
from pyspark.sql import functions as F

from axonframe.operators import prompts

RECORD = "ARRAY<STRUCT<tokens: ARRAY<STRING>, activations: ARRAY<DOUBLE>>>"
RECORDS = [(["a", "b", "c"], [1.0, 0.0, 0.0]), (["d", "e", "f"], [0.0, 1.0, 0.0])]

# The wanted prompts, character by character.
EXPLAIN = """We're studying neurons in a neural network. Each neuron looks for some particular thing in a short document. Look at the parts of the document the neuron activates for and summarize in a single sentence what the neuron is looking for. Don't list examples of words.

The activation format is token<tab>activation. Activation values range from 0 to 10. A neuron finding what it's looking for is represented by a non-zero activation value. The higher the activation value, the stronger the match.

Neuron 1
Activations:
<start>
a\t10
b\t0
c\t0
<end>
<start>
d\t0
e\t10
f\t0
<end>

Explanation of neuron 1 behavior: the main thing this neuron does is find vowels.

Neuron 2
Activations:
<start>
a\t10
b\t0
c\t0
<end>
<start>
d\t0
e\t10
f\t0
<end>

Explanation of neuron 2 behavior:<|endofprompt|> the main thing this neuron does is find"""

TOKENS = """We're studying neurons in a neural network. Each neuron looks for some particular kind of token (which can be a word, or part of a word). Look at the tokens the neuron activates for (listed below) and summarize in a single sentence what the neuron is looking for. Don't list examples of words.



Tokens:
'these', ' are', ' tokens'

Explanation:
This neuron is looking for this is a test explanation.



Tokens:
'foo', 'bar', 'baz'

Explanation:
<|endofprompt|>This neuron is looking for"""

SIMULATE = """We're studying neurons in a neural network.
Each neuron looks for some particular thing in a short document.
Look at summary of what the neuron does, and try to predict how it will fire on each token.

The activation format is token<tab>activation, activations go from 0 to 10, "unknown" indicates an unknown activation. Most activations will be 0.


Neuron 1
Explanation of neuron 1 behavior: the main thing this neuron does is find vowels
Activations: 
<start>
a\t10
b\t0
c\t0
<end>
<start>
d\tunknown
e\t10
f\t0
<end>



Neuron 2
Explanation of neuron 2 behavior: the main thing this neuron does is find EXPLANATION<|endofprompt|>
Activations: 
<start>
0\tunknown
1\tunknown
2\tunknown
<end>
"""

ONE_TOKEN = """We're studying neurons in a neural network. Each neuron looks for some particular thing in a short document. Look at  an explanation of what the neuron does, and try to predict its activations on a particular token.

The activation format is token<tab>activation, and activations range from 0 to 10. Most activations will be 0.

Neuron 1
Explanation of neuron 1 behavior: the main thing this neuron does is find vowels
Activations: 
<start>
a\t10
b\t0
c\t0
<end>
<start>
d\t0
e\t10
f\t0
<end>


Now, we're going predict the activation of a new neuron on a single token, following the same rules as the examples above. Activations still range from 0 to 10.
Neuron 2
Explanation of neuron 2 behavior: the main thing this neuron does is find numbers and nothing else
Text:
ghi

Last token in the text:
i

Last token activation, considering the token in the context in which it appeared in the text:
10


Neuron 3
Explanation of neuron 3 behavior: the main thing this neuron does is find numbers and nothing else
Text:
01

Last token in the text:
1

Last token activation, considering the token in the context in which it appeared in the text:
<|endofprompt|>"""


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(
        [(0, RECORDS, "vowels", [0, 1])], f"example_no INT, records {RECORD}, explanation STRING, first_revealed ARRAY<INT>"
    )


@pytest.fixture(scope="module")
def neurons(spark):
    return spark.createDataFrame([(0, 5, RECORDS)], f"layer INT, neuron INT, records {RECORD}")


def sequence(spark, explanation="EXPLANATION"):
    return spark.createDataFrame([(0, 0, ["0", "1", "2"], explanation)], "layer INT, neuron INT, tokens ARRAY<STRING>, explanation STRING")


def as_pairs(messages):
    return [(m["role"], m["content"]) for m in messages]


def test_explanation_prompt(neurons, examples):
    row = prompts.explain_prompts(neurons, examples, "instruction_following").first()
    assert row["prompt"] == EXPLAIN
    chat = as_pairs(prompts.explain_prompts(neurons, examples, "harmony_v4").first()["prompt"])
    assert [role for role, _ in chat] == ["system", "user", "assistant", "user"]
    assert chat[2][1] == " vowels."
    assert "".join(text for _, text in chat) == EXPLAIN.replace("<|endofprompt|>", "")


def test_zeros_are_repeated_without_only_when_sparse(spark, examples):
    sparse = [(["a"] * 6, [0.0] * 5 + [3.0])]
    table = spark.createDataFrame([(0, 0, sparse)], f"layer INT, neuron INT, records {RECORD}")
    text = prompts.explain_prompts(table, examples, "none").first()["prompt"]
    assert text.count("all zeros filtered out:\n<start>\na\t10\n<end>\n") == 1
    assert "filtered out" not in prompts.explain_prompts(table, examples, "none", repeat_nonzero=False).first()["prompt"]


def test_long_prompts_drop_example_records(spark, neurons, examples):
    """Two examples with two records each: as many as needed lose their last record."""
    two = examples.unionByName(examples.withColumn("example_no", F.lit(1)))
    render = lambda **kw: prompts.explain_prompts(neurons, two, "harmony_v4", **kw).first()
    full = render()["n_tokens"]
    shown = lambda row: "".join(m["content"] for m in row["prompt"]).count("<start>")
    assert shown(render()) == 6
    room = 4097 - full
    one = render(max_completion=room + 1)
    assert shown(one) == 5 and as_pairs(one["prompt"])[1][1].count("<start>") == 1
    assert shown(render(max_completion=4000)) == 4
    assert shown(render(context_size=2049)) == 4


@pytest.mark.parametrize("fmt", prompts.FORMATS)
def test_heads_measured_once_choose_as_whole_texts_do(neurons, examples, fmt):
    whole = lambda texts: prompts.rough_tokens(texts)  # another function: every prompt is measured as a whole
    longest = prompts.explain_prompts(neurons, examples, fmt).first()["n_tokens"]
    for room in range(4097 - longest - 2, 4097 - longest + 30, 4):
        plain = prompts.explain_prompts(neurons, examples, fmt, max_completion=room, counter=whole).collect()
        assert prompts.explain_prompts(neurons, examples, fmt, max_completion=room).collect() == plain


def test_numbered_lists_show_the_activations(neurons, examples):
    chat = as_pairs(prompts.explain_prompts(neurons, examples, "harmony_v4", numbered_list=3).first()["prompt"])
    assert chat[1][1].endswith('Here is 1 possible explanation for neuron 1 behavior, beginning with "the main thing this neuron does is find":\n1. the main thing this neuron does is find')
    assert chat[3][1].endswith('Here are 3 possible explanations for neuron 2 behavior, each beginning with "the main thing this neuron does is find":\n1. the main thing this neuron does is find')
    assert "a\t10" in chat[3][1]


def test_token_prompt(spark):
    shown = spark.createDataFrame(
        [(0, ["these", " are", " tokens"], " this is a test explanation")], "example_no INT, tokens ARRAY<STRING>, explanation STRING"
    )
    table = spark.createDataFrame([(0, 0, ["foo", "bar", "baz"])], "layer INT, neuron INT, tokens ARRAY<STRING>")
    assert prompts.token_prompts(table, shown, "instruction_following").first()["prompt"] == TOKENS
    chat = as_pairs(prompts.token_prompts(table, shown).first()["prompt"])
    assert "".join(text for _, text in chat) == TOKENS.replace("<|endofprompt|>", "")
    with pytest.raises(Exception, match="prompt too long"):
        prompts.token_prompts(table, shown, max_completion=5000).collect()
    with pytest.raises(ValueError):
        prompts.token_prompts(table, shown, numbered_list=True)


def test_simulation_prompt(spark, examples):
    row = prompts.simulate_prompts(sequence(spark, " EXPLANATION "), examples).first()
    assert row["prompt"] == SIMULATE
    chat = as_pairs(prompts.simulate_prompts(sequence(spark), examples, "harmony_v4").first()["prompt"])
    assert [role for role, _ in chat] == ["system", "user", "assistant", "user", "assistant"]
    assert "".join(text for _, text in chat) == SIMULATE.replace("<|endofprompt|>", "")


def test_single_token_prompt(spark, examples):
    one = spark.createDataFrame([([(["g", "h", "i"], [0.0, 0.0, 1.0])], 2)], f"records {RECORD}, token_index INT")
    found = prompts.single_token_prompts(sequence(spark, "numbers and nothing else"), examples, one)
    assert found.count() == 3
    assert found.where("pos = 1").first()["prompt"] == ONE_TOKEN


def test_plain_prompt(spark, examples):
    chat = as_pairs(prompts.plain_prompts(sequence(spark), examples).first()["prompt"])
    assert [role for role, _ in chat] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert chat[2][1] == "a\t10༗\nb\t0༗\nc\t0༗\n\n\n"
    assert chat[5][1].endswith("Sequence 1 Tokens without Activations:\n0\t༗\n1\t༗\n2\t༗\n\n\nSequence 1 Tokens with Activations:\n")


def messages(spark, roles):
    return spark.createDataFrame([([(r, str(i)) for i, r in enumerate(roles)],)], "m ARRAY<STRUCT<role: STRING, content: STRING>>")


@pytest.mark.parametrize("roles,broken,extra", [
    (["system", "user", "assistant", "user"], [], []),
    (["user", "assistant"], [0], [0]),
    (["system", "user", "system", "user"], [2], []),
    (["system", "assistant", "assistant"], [1, 2], [1, 2]),
    ([], [], []),
])
def test_role_order(spark, roles, broken, extra):
    table = messages(spark, roles)
    row = table.select(prompts.role_violations(F.col("m")).alias("a"), prompts.role_violations(F.col("m"), True).alias("b")).first()
    assert (row["a"], row["b"]) == (broken, extra)


def test_finish_checks(spark):
    bad = messages(spark, ["user"])
    with pytest.raises(Exception, match="unexpected role at message 0"):
        bad.select(prompts.finish(F.col("m"), "none")).collect()
    with pytest.raises(Exception, match="no user message"):
        messages(spark, ["system"]).select(prompts.finish(F.col("m"), "instruction_following")).collect()
    with pytest.raises(ValueError):
        prompts.finish(F.col("m"), "markdown")


def test_prompt_length(spark):
    table = messages(spark, ["system", "user"])
    assert table.select(prompts.prompt_length(F.col("m"), "harmony_v4")).first()[0] == 12
    assert table.select(prompts.prompt_length(F.col("m"), "none")).first()[0] == 1


def test_postprocessing(spark):
    text = "the main thing this neuron does is find a\n2.  b \n13.the main thing this neuron does is find c."
    table = spark.createDataFrame([([text],)], "c ARRAY<STRING>")
    assert table.select(prompts.explanations_from(F.col("c"), numbered_list=True)).first()[0] == ["a", "b", "c."]
    ends = spark.createDataFrame([(["a.", "a. ", "a.\n", "a..", "a"],)], "c ARRAY<STRING>")
    assert ends.select(prompts.explanations_from(F.col("c"), final_period=True)).first()[0] == ["a", "a", "a.\n", "a.", "a"]


def test_new_requests(spark):
    rows = spark.createDataFrame([("m", 1), ("m", 1), ("m", 2)], "model STRING, n INT")
    fresh = prompts.new_requests(rows, None, ["n", "model"])
    assert fresh.count() == 2
    answered = fresh.where("n = 1")
    assert [r["n"] for r in prompts.new_requests(rows, answered, ["model", "n"]).collect()] == [2]


def test_simulation_kinds(spark, examples):
    assert prompts.simulation_prompts(sequence(spark), "all_at_once", examples).first()["prompt"] == SIMULATE
    with pytest.raises(ValueError):
        prompts.simulation_prompts(sequence(spark), "at_random", examples)
    with pytest.raises(Exception, match="empty explanation"):
        prompts.plain_prompts(sequence(spark, ""), examples).collect()
