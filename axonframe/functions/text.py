"""Column expressions over text: stripping, numbered lists, rendering of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank at the ends of a text.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"

# Text shown in place of a hidden activation, and the frame around a record.
HIDDEN = "unknown"
FRAME_OPEN = "\n<start>\n"
FRAME_BETWEEN = "\n<end>\n<start>\n"
FRAME_CLOSE = "\n<end>\n"

# The line ending of the format without log probabilities.
PLAIN_END = "༗\n"


def strip(text: Column) -> Column:
    """Remove blanks of any kind, Unicode included, at both ends."""
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def strip_left(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")


def split_numbered(text: Column) -> Column:
    """Items of a numbered list, each without leading blanks."""
    return F.transform(F.split(text, r"\n\p{Nd}+\."), strip_left)


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def without_final_period(text: Column) -> Column:
    """Drop one final "." or ". "."""
    return F.regexp_replace(text, r"\. ?\z", "")


def quoted_tokens(tokens: Column) -> Column:
    """'a', 'b', 'c'"""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")


def record_lines(tokens: Column, shown: Column) -> Column:
    """One "token<tab>value" line per token."""
    return F.array_join(F.zip_with(tokens, shown, lambda t, v: F.concat(t, F.lit("\t"), v.cast("string"))), "\n")


def shown_levels(levels: Column, start: Column | int = 0) -> Column:
    """Levels as text, hidden before position ``start``."""
    first = F.lit(start) if isinstance(start, int) else start
    return F.transform(levels, lambda v, i: F.when(i < first, F.lit(HIDDEN)).otherwise(v.cast("string")))


def nonzero_lines(tokens: Column, levels: Column) -> Column:
    pairs = F.filter(F.arrays_zip(tokens.alias("t"), levels.alias("v")), lambda p: p["v"] > 0)
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(p["t"], F.lit("\t"), p["v"].cast("string"))), "\n"
    )


def hidden_lines(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit("\t" + HIDDEN))), "\n")


def plain_lines(tokens: Column, levels: Column | None = None) -> Column:
    """The format without log probabilities: "token<tab>level" closed by a rare character."""
    if levels is None:
        return F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit("\t" + PLAIN_END))), "")
    return F.array_join(
        F.zip_with(tokens, levels, lambda t, v: F.concat(t, F.lit("\t"), v.cast("string"), F.lit(PLAIN_END))), ""
    )


def framed(record_texts: Column) -> Column:
    """Rendered records between start and end marks."""
    return F.concat(F.lit(FRAME_OPEN), F.array_join(record_texts, FRAME_BETWEEN), F.lit(FRAME_CLOSE))


def rendered_records(
    records: Column,
    top: Column,
    omit_zeros: bool = False,
    start_indices: Column | None = None,
    hide_activations: bool = False,
) -> Column:
    """An array of records as prompt text, levels relative to ``top``."""
    from axonframe.functions.arrays import to_levels

    if omit_zeros and (hide_activations or start_indices is not None):
        raise ValueError("zeros can only be omitted when every activation is shown")
    if hide_activations:
        return framed(F.transform(records, lambda r: hidden_lines(r["tokens"])))
    if omit_zeros:
        return framed(
            F.transform(records, lambda r: nonzero_lines(r["tokens"], to_levels(r["activations"], top)))
        )
    start = (lambda i: F.lit(0)) if start_indices is None else (lambda i: F.get(start_indices, i))
    return framed(
        F.transform(
            records,
            lambda r, i: record_lines(r["tokens"], shown_levels(to_levels(r["activations"], top), start(i))),
        )
    )
