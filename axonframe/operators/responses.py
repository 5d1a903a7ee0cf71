"""Parse completions into simulated activations.

Responses are matched row by row with array expressions: nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.arrays import let
from axonframe.functions.text import FRAME_OPEN, HIDDEN, PLAIN_END
from axonframe.operators.prompts import FORMATS
from axonframe.schemas import SIMULATED_SCALE, check_choice

# The activation tokens a distribution may be made of.
LEVEL_TOKENS = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10")
START_MARK = FRAME_OPEN.strip()
BYTES_MARK = "bytes:"


def level_probabilities(top_logprobs: Column) -> Column:
    """Map from level to normalised probability; keys that are no level are dropped."""
    valid = F.map_filter(top_logprobs, lambda token, _: token.isin(*LEVEL_TOKENS))
    weights = F.transform_values(F.transform_keys(valid, lambda token, _: token.cast("int")), lambda _, lp: F.exp(lp))

    def normalised(w: Column) -> Column:
        total = F.aggregate(F.map_values(w), F.lit(0.0), lambda a, b: a + b)
        return let(total, lambda t: F.transform_values(w, lambda _, x: F.try_divide(x, t)))

    return let(weights, normalised)


def expected_level(probabilities: Column) -> Column:
    """Mean level; 0.0 for an empty distribution."""
    return F.aggregate(
        F.map_entries(probabilities), F.lit(0.0), lambda total, e: total + e["key"] * e["value"]
    )


def token_estimate(top_logprobs: Column) -> Column:
    """Expected level, levels and probabilities of one position."""
    return let(
        level_probabilities(top_logprobs),
        lambda p: F.struct(
            expected_level(p).alias("expected"),
            F.transform(F.map_keys(p), lambda k: k.cast("double")).alias("values"),
            F.map_values(p).alias("probs"),
        ),
    )


def _simulation_columns(estimates: Column) -> dict[str, Column]:
    return {
        "expected": F.transform(estimates, lambda e: e["expected"]),
        "dist_values": F.transform(estimates, lambda e: e["values"]),
        "dist_probs": F.transform(estimates, lambda e: e["probs"]),
        "scale": F.lit(SIMULATED_SCALE),
    }


def completion_text(choice: Column, fmt: str) -> Column:
    check_choice("prompt format", fmt, FORMATS)
    return choice["message"]["content"] if fmt == "harmony_v4" else choice["text"]


def parse_plain(completion: Column, tokens: Column, strict: bool = True) -> Column:
    """Levels read from a completion that repeats "token<tab>level" lines.

    All 0 when the tokens are not repeated faithfully; 0 where a level is not 0..10.  With
    ``strict`` the last line keeps its end mark if the completion ends with one, so its level
    reads as 0; otherwise the mark is removed first.
    """
    trimmed = F.regexp_replace(completion, r"\A\n+|\n+\z", "")
    if not strict:
        trimmed = F.regexp_replace(trimmed, f"{PLAIN_END.strip()}\\z", "")
    lines = F.split(trimmed, PLAIN_END)
    opening = F.concat(F.get(tokens, F.lit(0)), F.lit("\t"))
    first = F.array_position(F.transform(lines, lambda line: F.startswith(line, opening)), True)
    rest = F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))
    faithful = (
        (first > 0)
        & (F.size(rest) == F.size(tokens))
        & F.forall(
            F.zip_with(rest, tokens, lambda line, t: F.startswith(line, F.concat(t, F.lit("\t")))),
            lambda ok: F.coalesce(ok, F.lit(False)),
        )
    )
    def level(line: Column) -> Column:
        field = F.get(F.split(line, "\t"), F.lit(1))
        return F.when(field.isin(*LEVEL_TOKENS), field.try_cast("int")).otherwise(0)

    return F.when(faithful, F.transform(rest, level)).otherwise(F.transform(tokens, lambda _: F.lit(0)))


def parse_plain_responses(responses: DataFrame, fmt: str = "harmony_v4", strict: bool = True) -> DataFrame:
    """responses: keys, tokens, response -> simulations without distributions."""
    text = completion_text(F.get("response.choices", F.lit(0)), fmt)
    levels = parse_plain(text, F.col("tokens"), strict)
    none = F.array().cast("array<array<double>>")
    return responses.withColumns(
        {
            "expected": F.transform(levels, lambda v: v.cast("double")),
            "dist_values": none,
            "dist_probs": none,
            "scale": F.lit(SIMULATED_SCALE),
        }
    ).drop("response")


def _byte_value(token: Column) -> Column:
    """Bytes of a response token: text as UTF-8, or the escapes after the byte mark."""
    body = F.substr(token, F.lit(len(BYTES_MARK) + 1))
    parts = F.regexp_extract_all(body, F.lit(r"(?s)(\\x[0-9a-fA-F]{2}|.)"), F.lit(1))
    digits = F.transform(
        parts, lambda p: F.when(F.length(p) == 4, F.substr(p, F.lit(3))).otherwise(F.hex(p))
    )
    escaped = F.unhex(F.array_join(digits, ""))
    return F.when(F.startswith(token, F.lit(BYTES_MARK)), escaped).otherwise(F.encode(token, "UTF-8"))


def _merged_back(response_tokens: Column, at: Column, wanted: Column) -> Column:
    """Join response tokens backwards from position ``at`` until ``wanted`` is covered.

    Byte tokens are decoded once the bytes gathered so far are whole characters.  Every
    response token has at least one byte, so four tokens per wanted character always suffice.
    Gives the merged text and the number of tokens used.
    """
    reach = F.least(at + 1, 4 * F.length(wanted) + 4).cast("int")
    tail = F.reverse(F.slice(response_tokens, (at + 2 - reach).cast("int"), reach))
    empty = F.lit("").cast("binary")
    start = F.struct(F.lit("").alias("text"), empty.alias("open"), F.lit(0).alias("used"))

    def add(state: Column, token: Column) -> Column:
        done = (F.length(state["text"]) >= F.length(wanted)) & (F.length(state["open"]) == 0)
        pending = F.startswith(token, F.lit(BYTES_MARK)) | (F.length(state["open"]) > 0)
        gathered = F.concat(_byte_value(token), state["open"])
        whole = F.is_valid_utf8(gathered.cast("string"))
        text = F.when(~pending, F.concat(token, state["text"])).when(
            whole, F.concat(gathered.cast("string"), state["text"])
        ).otherwise(state["text"])
        left = F.when(pending & ~whole, gathered).otherwise(empty)
        return F.when(done, state).otherwise(
            F.struct(text.alias("text"), left.alias("open"), (state["used"] + 1).alias("used"))
        )

    return F.aggregate(tail, start, add)


def align_response(choice: Column, text: Column, tokens: Column) -> Column:
    """Estimates for the tokens of a sequence from an echoed prompt with log probabilities.

    Token k belongs to the k-th place after the last start mark where a tab is followed by
    the hidden mark.  If the response token before the tab is the wanted token, or the wanted
    token was split into several, the place's log probabilities count.  If a newline was
    folded into it, the estimate is 0 with an empty distribution.  Anything else, or an end
    that is not followed by the end mark, fails the job.  Fewer places than tokens give a
    shorter result.
    """
    log = choice["logprobs"]
    seen = log["tokens"]
    after_last = F.length(F.substring_index(text, START_MARK, -1))
    scoring_start = F.when(
        F.contains(text, F.lit(START_MARK)), F.length(text) - after_last - len(START_MARK)
    ).otherwise(-1)
    places = let(
        scoring_start,
        lambda begin: F.filter(
            F.transform(seen, lambda _, i: i),
            lambda i: (i >= 2)
            & (F.get(seen, i) == HIDDEN)
            & (F.get(seen, i - 1) == "\t")
            & (F.get(log["text_offset"], i) >= begin),
        ),
    )
    return let(
        F.slice(places, 1, F.greatest(F.size(tokens), F.lit(1))), lambda used: _aligned(used, log, tokens)
    )


def _aligned(used: Column, log: Column, tokens: Column) -> Column:
    """Estimates at the places ``used``, one per token."""
    seen = log["tokens"]

    def estimate(place: Column, k: Column) -> Column:
        wanted = F.get(tokens, k)
        before = F.get(seen, place - 2)
        nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        broken = F.raise_error(F.concat(F.lit("response does not match token "), k.cast("string"), F.lit(": "), wanted))

        def from_pieces(merged: Column) -> Column:
            ends = F.endswith(merged["text"], wanted)
            return (
                F.when(ends & (merged["used"] > 1), F.get(log["top_logprobs"], place))
                .when(ends & F.contains(before, F.lit("\n")), nothing)
                .otherwise(broken.cast("map<string,double>"))
            )

        pieces = let(_merged_back(seen, place - 2, wanted), from_pieces)
        return token_estimate(F.when(before == wanted, F.get(log["top_logprobs"], place)).otherwise(pieces))

    estimates = F.transform(used, estimate)
    last = F.when(F.size(used) > 0, F.element_at(used, -1)).otherwise(F.lit(1))
    complete = (F.size(used) == F.size(tokens)) & (F.size(seen) > last + 1)
    closed = (F.get(seen, last + 2) == "<") & (F.get(seen, last + 3) == "end")
    checked = F.when(complete & ~F.coalesce(closed, F.lit(False)), F.raise_error(F.lit("no end mark after the last token")).cast(
        "array<struct<expected:double,values:array<double>,probs:array<double>>>"
    )).otherwise(estimates)
    return F.when(F.size(tokens) > 0, checked).otherwise(F.slice(estimates, 1, 0))


def parse_echo_responses(responses: DataFrame, fmt: str = "instruction_following") -> DataFrame:
    """responses: keys, tokens, response -> one simulated sequence per row."""
    choice = F.get("response.choices", F.lit(0))
    aligned = responses.withColumn("_estimates", align_response(choice, completion_text(choice, fmt), F.col("tokens")))
    return (
        aligned.withColumns(_simulation_columns(F.col("_estimates")))
        .withColumn("tokens", F.slice("tokens", F.lit(1), F.size("_estimates")))
        .drop("_estimates", "response")
    )


def parse_token_responses(responses: DataFrame, keys: list[str]) -> DataFrame:
    """responses: keys, pos, token, response (one token asked) -> one simulated sequence per key.

    A key is one sequence, so a group holds at most its tokens.
    """
    first = F.get(F.get("response.choices", F.lit(0))["logprobs"]["top_logprobs"], F.lit(0))
    items = F.array_sort(F.collect_list(F.struct("pos", "token", "estimate")))
    gathered = (
        responses.withColumn("estimate", token_estimate(first))
        .groupBy(*keys)
        .agg(items.alias("_items"))
    )
    return gathered.select(
        *keys,
        F.col("_items.token").alias("tokens"),
        *[c.alias(name) for name, c in _simulation_columns(F.col("_items.estimate")).items()],
    )
