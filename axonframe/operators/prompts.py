"""Prompt tables: one Spark job renders the prompt of every neuron, sequence or token.

Example prompts are a small table the caller passes in; they are rendered once and become
literals of the plan, so no join is needed.  A prompt is ``ARRAY<STRUCT<role, content>>``;
``finish`` turns it into the wanted format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.arrays import nonzero_count, to_levels, upto
from axonframe.functions.text import (
    framed,
    hidden_lines,
    plain_lines,
    quoted_tokens,
    rendered_records,
    split_numbered,
    strip,
    without_final_period,
    without_prefix,
)
from axonframe.operators.scale import top_rows
from axonframe.schemas import MESSAGES, NEURON, check_choice

# Prompt formats, context sizes and the texts the prompts are made of.
FORMATS = ("none", "instruction_following", "harmony_v4")
CONTEXT_SIZES = (2049, 4097)
SIMULATION_TYPES = ("all_at_once", "one_at_a_time", "no_logprobs")
END_OF_PROMPT = "<|endofprompt|>"
EXPLANATION_PREFIX = "the main thing this neuron does is find"
LOOKING_FOR = "This neuron is looking for"
SPARSE_SHARE = 0.2
EXPLAIN_SYSTEM = (
    "We're studying neurons in a neural network. Each neuron looks for some particular thing in a short document. "
    "Look at the parts of the document the neuron activates for and summarize in a single sentence what the neuron "
    "is looking for. Don't list examples of words.\n\n"
    "The activation format is token<tab>activation. Activation values range from 0 to 10. A neuron finding what it's "
    "looking for is represented by a non-zero activation value. The higher the activation value, the stronger the match."
)
TOKENS_SYSTEM = (
    "We're studying neurons in a neural network. Each neuron looks for some particular kind of token (which can be a "
    "word, or part of a word). Look at the tokens the neuron activates for (listed below) and summarize in a single "
    "sentence what the neuron is looking for. Don't list examples of words."
)
SIMULATE_SYSTEM = (
    "We're studying neurons in a neural network.\n"
    "Each neuron looks for some particular thing in a short document.\n"
    "Look at summary of what the neuron does, and try to predict how it will fire on each token.\n\n"
    'The activation format is token<tab>activation, activations go from 0 to 10, "unknown" indicates an unknown '
    "activation. Most activations will be 0.\n"
)
TOKEN_SYSTEM = (
    "We're studying neurons in a neural network. Each neuron looks for some particular thing in a short document. "
    "Look at  an explanation of what the neuron does, and try to predict its activations on a particular token.\n\n"
    "The activation format is token<tab>activation, and activations range from 0 to 10. Most activations will be 0.\n"
)
TOKEN_TURN = (
    "Now, we're going predict the activation of a new neuron on a single token, following the same rules as the "
    "examples above. Activations still range from 0 to 10."
)
PLAIN_SYSTEM = (
    "For each sequence, you will see the tokens in the sequence where the activations are left blank. You will print "
    "the exact same tokens verbatim, but with the activations filled in according to the explanation.\n"
)
ZEROS_DROPPED = "\nSame activations, but with all zeros filtered out:"
LAST_TOKEN = "\n\nLast token in the text:\n"
LAST_ACTIVATION = (
    "\n\nLast token activation, considering the token in the context in which it appeared in the text:\n"
)

TokenCounter = Callable[[Column], Column]


def rough_tokens(texts: Column) -> Column:
    """Default token count of an array of texts: words and punctuation marks.

    Pass a function with the same shape (for instance a pandas UDF around a real tokeniser)
    where exact counts matter.
    """
    pieces = F.transform(texts, lambda t: F.size(F.regexp_extract_all(t, F.lit(r"(\w+|[^\w\s])"), F.lit(1))))
    return F.aggregate(pieces, F.lit(0), lambda total, n: total + n)


def message(role: str, content: Column | str) -> Column:
    text = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def _literal(messages: list[tuple[str, str]]) -> Column:
    if not messages:
        return F.array().cast(MESSAGES)
    return F.array(*[message(role, content) for role, content in messages])


def contents(messages: Column) -> Column:
    return F.transform(messages, lambda m: m["content"])


def role_violations(messages: Column, allow_extra_system: bool = False) -> Column:
    """Positions (from 0) whose role does not follow: system, user, assistant, user, ..."""

    def expected(position: Column) -> Column:
        before = F.get(messages, position - 1)["role"]
        return F.when(position == 0, F.lit("system")).when(before == "user", F.lit("assistant")).otherwise(F.lit("user"))

    def wrong(position: Column) -> Column:
        role = F.get(messages, position)["role"]
        broken = role != expected(position)
        return broken & (role != "system") if allow_extra_system else broken

    positions = F.transform(messages, lambda _, i: i)
    return F.filter(positions, wrong)


def marked_end(messages: Column) -> Column:
    """Append the end-of-prompt mark to the last user message."""
    users = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i).otherwise(-1)), lambda i: i >= 0)
    last = F.array_max(users)
    return F.transform(
        messages,
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when(i == last, F.concat(m["content"], F.lit(END_OF_PROMPT))).otherwise(m["content"]).alias("content"),
        ),
    )


def finish(messages: Column, fmt: str, allow_extra_system: bool = False) -> Column:
    """Check the roles, then give the message list or one text; a wrong order fails the job."""
    check_choice("prompt format", fmt, FORMATS)
    broken = role_violations(messages, allow_extra_system)
    checked = F.when(F.size(broken) == 0, messages).otherwise(
        F.raise_error(F.concat(F.lit("unexpected role at message "), F.get(broken, F.lit(0)).cast("string")))
    )
    if fmt == "harmony_v4":
        return checked
    if fmt == "instruction_following":
        no_user = ~F.exists(checked, lambda m: m["role"] == "user")
        checked = F.when(no_user, F.raise_error(F.lit("the prompt has no user message"))).otherwise(marked_end(checked))
    return F.array_join(contents(checked), "")


def prompt_length(messages: Column, fmt: str, counter: TokenCounter = rough_tokens) -> Column:
    """Length in tokens: 4 per message and 2 at the end for message lists, else the text's."""
    check_choice("prompt format", fmt, FORMATS)
    if fmt == "harmony_v4":
        return counter(contents(messages)) + 4 * F.size(messages) + 2
    marked = marked_end(messages) if fmt == "instruction_following" else messages
    return counter(F.array(F.array_join(contents(marked), "")))


def _records_top(records: Column) -> Column:
    """Largest clamped activation of an array of records."""
    return F.greatest(F.lit(0.0), F.array_max(F.transform(records, lambda r: F.array_max(r["activations"]))))


def _collected(examples: DataFrame, *columns: Column) -> list:
    """Rendered examples in order.  All of them are part of every prompt, so one prompt holds them."""
    return examples.orderBy("example_no").select(*columns).collect()


def _explain_request(records: Column, number: Column, fmt: str, repeat_nonzero: bool, several: int | None, shown: int) -> Column:
    """The user message that shows a neuron's records and asks for an explanation."""
    top = _records_top(records)
    count = lambda size: F.aggregate(F.transform(records, size), F.lit(0), lambda total, n: total + n)
    nonzero = count(lambda r: nonzero_count(to_levels(r["activations"], top)))
    share = F.try_divide(nonzero, count(lambda r: F.size(r["activations"])))
    no = number.cast("string")
    parts = [F.lit("\n\nNeuron "), no, F.lit("\nActivations:"), rendered_records(records, top)]
    if repeat_nonzero:
        again = F.concat(F.lit(ZEROS_DROPPED), rendered_records(records, top, omit_zeros=True))
        parts.append(F.when(share < SPARSE_SHARE, again).otherwise(F.lit("")))
    if several is None:
        parts += [F.lit("\nExplanation of neuron "), no, F.lit(" behavior:")]
        if fmt != "instruction_following":
            parts.append(F.lit(f" {EXPLANATION_PREFIX}"))
    else:
        heading = "Here is 1 possible explanation" if shown == 1 else f"Here are {several} possible explanations"
        each = "beginning" if shown == 1 else "each beginning"
        parts += [
            F.lit(f"\n{heading} for neuron "), no,
            F.lit(f' behavior, {each} with "{EXPLANATION_PREFIX}":\n1. {EXPLANATION_PREFIX}'),
        ]
    return F.concat(*parts)


def explain_prompts(
    neurons: DataFrame,
    examples: DataFrame,
    fmt: str = "harmony_v4",
    context_size: int = 4097,
    max_completion: int = 60,
    repeat_nonzero: bool = True,
    numbered_list: int | None = None,
    counter: TokenCounter = rough_tokens,
) -> DataFrame:
    """Ask for an explanation of each neuron from its token/activation records.

    ``neurons``: layer, neuron, records (a train split).  ``examples``: example_no, records,
    explanation.  A prompt that does not fit loses the last record of its first example, then
    of the second, and so on; all these heads are rendered once and each row takes the first
    that fits.  Where lengths add up (message lists, or the default counter, which never joins a
    head's last mark with the line break after it) a head is measured once as well; other counters
    measure whole texts.  The 2k context shows one record per example and two of the neuron's.
    With ``numbered_list`` the prompt shows the activations as well.
    """
    check_choice("prompt format", fmt, FORMATS)
    if context_size not in CONTEXT_SIZES:
        raise ValueError(f"{context_size} is not a valid context size")
    if numbered_list is not None and numbered_list <= 0:
        raise ValueError("the number of explanations must be positive")
    small = context_size == CONTEXT_SIZES[0]
    lead = f" {EXPLANATION_PREFIX}" if fmt == "instruction_following" and numbered_list is None else ""

    shown = F.slice("records", 1, 1) if small else F.col("records")
    fewer = F.slice("records", 1, F.greatest(F.size("records") - 1, F.lit(1)))
    request = lambda records: _explain_request(records, F.col("example_no") + 1, fmt, repeat_nonzero, numbered_list, 1)
    rows = _collected(examples, request(shown).alias("full"), request(fewer).alias("fewer"),
                      (F.size("records") > 1).alias("can_drop"), "explanation")
    droppable = [] if small else [i for i, row in enumerate(rows) if row["can_drop"]]
    heads = []
    for dropped in range(len(droppable) + 1):
        turns = [("system", EXPLAIN_SYSTEM)]
        for i, row in enumerate(rows):
            turns.append(("user", row["fewer"] if i in droppable[:dropped] else row["full"]))
            turns.append(("assistant", f"{lead} {row['explanation']}."))
        heads.append(turns)

    own = F.slice("records", 1, 2) if small else F.col("records")
    ask = _explain_request(own, F.lit(len(rows) + 1), fmt, repeat_nonzero, numbered_list, 0)
    turns = [message("user", F.col("_ask"))] + ([message("assistant", lead)] if lead else [])
    asked = neurons.withColumn("_ask", ask)
    room = context_size - max_completion
    if fmt == "harmony_v4" or counter is rough_tokens:
        # Heads are measured once, here; a row measures its own messages only.
        sizes = _head_lengths(neurons.sparkSession, heads, fmt, counter)
        tail = prompt_length(F.array(*turns), fmt, counter)
        lengths = F.array(*[F.lit(size) for size in sizes])
        first = F.array_min(F.filter(F.transform(lengths, lambda size, i: F.when(size + F.col("_tail") <= room, i)), F.isnotnull))
        placed = asked.withColumn("_tail", tail).withColumn("_head", F.coalesce(first, F.lit(len(heads) - 1)))
        found = placed.withColumn(
            "messages", F.concat(F.get(F.array(*[_literal(head) for head in heads]), F.col("_head")), F.array(*turns))
        ).withColumn("n_tokens", F.get(lengths, F.col("_head")) + F.col("_tail")).drop("_tail", "_head")
    else:
        choices = [F.concat(_literal(head), F.array(*turns)) for head in heads]
        picked = choices[-1]
        for choice in reversed(choices[:-1]):
            picked = F.when(prompt_length(choice, fmt, counter) <= room, choice).otherwise(picked)
        found = asked.withColumn("messages", picked).withColumn("n_tokens", prompt_length(F.col("messages"), fmt, counter))
    return found.withColumn("prompt", finish(F.col("messages"), fmt)).drop("_ask", "records")


def _head_lengths(spark: SparkSession, heads: list, fmt: str, counter: TokenCounter) -> list[int]:
    """Tokens of each head: the sum of its messages' in message lists, those of its joined text elsewhere."""
    def size(head: list) -> Column:
        if fmt == "harmony_v4":
            return counter(contents(_literal(head))) + 4 * len(head)
        return counter(F.array(F.lit("".join(content for _, content in head))))

    return list(spark.range(1).select(*[size(head).alias(f"_{i}") for i, head in enumerate(heads)]).first())


def _token_turns(tokens: Column, fmt: str, numbered: bool) -> tuple[Column, str]:
    """User text and the start of the assistant text for a token list."""
    lead = LOOKING_FOR + ("\n1." if numbered else "")
    ask = F.concat(F.lit("\n\n\n\nTokens:\n"), quoted_tokens(tokens), F.lit("\n\nExplanation:\n"))
    if fmt == "instruction_following":
        return ask, lead
    return F.concat(ask, F.lit(lead)), ""


def token_prompts(
    neurons: DataFrame,
    examples: DataFrame | None = None,
    fmt: str = "harmony_v4",
    context_size: int = 4097,
    max_completion: int = 60,
    numbered_list: bool = False,
    counter: TokenCounter = rough_tokens,
) -> DataFrame:
    """Ask for an explanation of each neuron from its list of tokens.

    ``neurons``: layer, neuron, tokens.  ``examples``: example_no, tokens, explanation.  A
    prompt that does not fit fails the job.
    """
    check_choice("prompt format", fmt, FORMATS)
    if examples is not None and numbered_list:
        raise ValueError("examples cannot be combined with numbered lists")
    turns = [("system", TOKENS_SYSTEM)]
    if examples is not None:
        ask, lead = _token_turns(F.col("tokens"), fmt, False)
        for row in _collected(examples, ask.alias("ask"), "explanation"):
            turns += [("user", row["ask"]), ("assistant", f"{lead}{row['explanation']}.")]
    ask, lead = _token_turns(F.col("tokens"), fmt, numbered_list)
    own = [message("user", ask)] + ([message("assistant", lead)] if lead else [])
    length = prompt_length(F.col("messages"), fmt, counter)
    too_long = F.raise_error(F.concat(F.lit("prompt too long: "), F.col("n_tokens").cast("string")))
    fits = F.col("n_tokens") + max_completion <= context_size
    return (
        neurons.withColumn("messages", F.concat(_literal(turns), F.array(*own)))
        .withColumn("n_tokens", length)
        .withColumn("messages", F.when(fits, F.col("messages")).otherwise(too_long))
        .withColumn("prompt", finish(F.col("messages"), fmt))
        .drop("tokens")
    )


def _about(number: Column | int, explanation: Column) -> Column:
    no = F.lit(str(number)) if isinstance(number, int) else number.cast("string")
    return F.concat(
        F.lit("Neuron "), no, F.lit("\nExplanation of neuron "), no, F.lit(f" behavior: {EXPLANATION_PREFIX} "), explanation
    )


def simulate_prompts(sequences: DataFrame, examples: DataFrame, fmt: str = "instruction_following") -> DataFrame:
    """Ask for the activations of all tokens of a sequence at once.

    ``sequences``: any keys, explanation, tokens.  ``examples``: example_no, records,
    explanation, first_revealed (one position per record from which levels are shown).
    """
    check_choice("prompt format", fmt, FORMATS)
    shown = rendered_records(F.col("records"), _records_top(F.col("records")), start_indices=F.col("first_revealed"))
    turns = [("system", SIMULATE_SYSTEM)]
    rows = _collected(
        examples,
        F.concat(F.lit("\n\n"), _about(F.col("example_no") + 1, F.col("explanation"))).alias("ask"),
        F.concat(F.lit("\nActivations: "), shown, F.lit("\n")).alias("answer"),
    )
    for row in rows:
        turns += [("user", row["ask"]), ("assistant", row["answer"])]
    own = [
        message("user", F.concat(F.lit("\n\n"), _about(len(rows) + 1, strip(F.col("explanation"))))),
        message("assistant", F.concat(F.lit("\nActivations: "), framed(F.array(hidden_lines(F.col("tokens")))))),
    ]
    prompt = F.concat(_literal(turns), F.array(*own))
    return sequences.withColumn("messages", prompt).withColumn("prompt", finish(F.col("messages"), fmt))


def _nonempty(explanation: Column) -> Column:
    """An empty explanation fails the job."""
    return F.when(explanation == "", F.raise_error(F.lit("empty explanation")).cast("string")).otherwise(explanation)


def _last_token(number: int, explanation: Column, tokens: Column) -> Column:
    return F.concat(
        F.lit("\n"), _about(number, strip(explanation)), F.lit("\nText:\n"), F.array_join(tokens, ""),
        F.lit(LAST_TOKEN), F.element_at(tokens, -1), F.lit(LAST_ACTIVATION),
    )


def single_token_prompts(
    sequences: DataFrame, examples: DataFrame, token_example: DataFrame, fmt: str = "instruction_following"
) -> DataFrame:
    """Ask for the activation of one token per prompt: one row per token of each sequence.

    ``token_example`` has one row: records (one record), token_index.  ``pos`` is the token
    that a prompt asks for.
    """
    check_choice("prompt format", fmt, FORMATS)
    shown = rendered_records(F.col("records"), _records_top(F.col("records")))
    turns = [("system", TOKEN_SYSTEM + "\n")]
    rows = _collected(
        examples,
        F.concat(_about(F.col("example_no") + 1, F.col("explanation")), F.lit("\n")).alias("ask"),
        F.concat(F.lit("Activations: "), shown, F.lit("\n\n")).alias("answer"),
    )
    for row in rows:
        turns += [("user", row["ask"]), ("assistant", row["answer"])]
    turns.append(("system", TOKEN_TURN))
    record = F.get("records", F.lit(0))
    level = F.get(to_levels(record["activations"], _records_top(F.slice("records", 1, 1))), F.col("token_index"))
    known = token_example.select(
        upto(record["tokens"], F.col("token_index")).alias("tokens"), level.cast("string").alias("level")
    ).limit(2).collect()
    if len(known) != 1:
        raise ValueError("exactly one single-token example is needed")
    count = len(rows)
    example_tokens = F.array(*[F.lit(t) for t in known[0]["tokens"]])
    own = F.array(
        message("user", _last_token(count + 1, F.col("explanation"), example_tokens)),
        message("assistant", f"{known[0]['level']}\n\n"),
        message("user", _last_token(count + 2, F.col("explanation"), F.col("_seen"))),
    )
    positions = F.transform("tokens", lambda _, i: i)
    return (
        sequences.withColumn("explanation", _nonempty(F.col("explanation")))
        .withColumn("pos", F.explode(positions))
        .withColumn("_seen", upto(F.col("tokens"), F.col("pos")))
        .withColumn("messages", F.concat(_literal(turns), own))
        .withColumn("prompt", finish(F.col("messages"), fmt, allow_extra_system=True))
        .drop("_seen")
    )


def plain_prompts(sequences: DataFrame, examples: DataFrame, fmt: str = "harmony_v4") -> DataFrame:
    """Ask to repeat all tokens with their activations, without log probabilities."""
    check_choice("prompt format", fmt, FORMATS)
    top = _records_top(F.col("records"))

    def ask(number: Column, tokens: Column) -> Column:
        return F.concat(
            F.lit("Sequence "), number.cast("string"), F.lit(" Tokens without Activations:\n"), plain_lines(tokens),
            F.lit("\n\nSequence "), number.cast("string"), F.lit(" Tokens with Activations:\n"),
        )

    filled = F.transform(
        "records",
        lambda r, i: F.struct(
            ask(i + 1, r["tokens"]).alias("ask"),
            F.concat(plain_lines(r["tokens"], to_levels(r["activations"], top)), F.lit("\n\n")).alias("answer"),
        ),
    )
    rows = _collected(
        examples, F.concat(_about(F.col("example_no") + 1, F.col("explanation")), F.lit("\n\n")).alias("about"), filled.alias("filled")
    )
    turns = [("system", TOKEN_SYSTEM + PLAIN_SYSTEM)]
    for row in rows:
        for i, pair in enumerate(row["filled"]):
            turns += [("user", (row["about"] if i == 0 else "") + pair["ask"]), ("assistant", pair["answer"])]
    own = message(
        "user", F.concat(_about(len(rows) + 1, F.col("explanation")), F.lit("\n\n"), ask(F.lit(1), F.col("tokens")))
    )
    return (
        sequences.withColumn("explanation", _nonempty(F.col("explanation")))
        .withColumn("messages", F.concat(_literal(turns), F.array(own)))
        .withColumn("prompt", finish(F.col("messages"), fmt))
    )


def simulation_prompts(sequences: DataFrame, kind: str, examples: DataFrame, **options) -> DataFrame:
    """Prompts of one simulation kind: all tokens at once, one token at a time, or plain."""
    check_choice("simulation type", kind, SIMULATION_TYPES)
    render = dict(zip(SIMULATION_TYPES, (simulate_prompts, single_token_prompts, plain_prompts)))
    return render[kind](sequences, examples, **options)


def explanations_from(completions: Column, numbered_list: bool = False, final_period: bool = False) -> Column:
    """Explanations in an array of completions: list items, or the completions themselves."""
    if numbered_list:
        items = F.flatten(F.transform(completions, split_numbered))
        return F.transform(items, lambda e: strip(without_prefix(e, EXPLANATION_PREFIX)))
    return F.transform(completions, without_final_period) if final_period else completions


def new_requests(requests: DataFrame, answered: DataFrame | None, key: list[str]) -> DataFrame:
    """Distinct requests that have no response yet.

    Requests are matched by a hash of their canonical JSON and by the JSON itself, so equal
    hashes of different requests do no harm.
    """
    text = F.to_json(F.struct(*sorted(key)))
    keyed = requests.withColumn("request", text).withColumn("request_key", F.xxhash64("request"))
    fresh = keyed.dropDuplicates(["request_key", "request"])
    if answered is None:
        return fresh
    return fresh.join(answered.select("request_key", "request"), ["request_key", "request"], "left_anti")


def grouped_messages(turns: DataFrame, keys: list[str], order: str = "turn") -> DataFrame:
    """Message list per conversation, in turn order; a row is one prompt."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", "content")))
    return turns.groupBy(*keys).agg(
        F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )


def record_lists(split: DataFrame, size: int | None = None) -> DataFrame:
    """Records of a split as one array per neuron (a split is bounded by the retained lists)."""
    rows = split if size is None else top_rows(split, NEURON, [F.col("position"), F.col("seq_id")], size, "_n").drop("_n")
    items = F.array_sort(F.collect_list(F.struct("position", "tokens", "activations")))
    return rows.groupBy(*NEURON).agg(
        F.transform(items, lambda r: F.struct(r["tokens"].alias("tokens"), r["activations"].alias("activations"))).alias("records")
    )
