"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans.  Validators confirm them: part values of addresses, digit
counts of phone numbers, the Luhn check of card numbers, the mod-97 check and the country's length
of account numbers.
Whole context words near a span, before or after it, raise its score, words that speak against
it lower it.  The base
kinds email, ip, card and phone are always kept once their validator holds; account numbers and
long bare digit strings (phone numbers without a plus sign) need their score.

Positions: splitting a text at a pattern and extracting all matches gives its pieces and matches
in turn; their summed lengths are the spans.  The patterns are possessive where nothing can be
given back, and start only where a run of their characters starts (or the last match ended), so
that a very long run is read once and never by recursion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.  ``likely`` and ``unlikely`` are words looked for on both sides of a span."""

    name: str
    pattern: str
    hint: str
    score: float
    likely: tuple[str, ...] = ()
    unlikely: tuple[str, ...] = ()
    validator: str = "none"
    needed: float = 0.0
    digits: tuple[int, int] = field(default=(0, 0))


#: Base kinds come first, in the order of ties.  ``hint`` is a cheap test of the whole text.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, ("mail", "email", "contact", "write")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address"), ("version", "section"), "parts"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9]", 0.7, ("card", "visa", "credit", "payment"), ("order", "isbn", "serial"), "luhn", 0.0, (14, 19)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, ("phone", "telephone", "call", "tel", "mobile", "fax"), (), "digits", 0.0, (10, 15)),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, ("iban", "account", "konto", "compte"), ("part", "model"), "mod97", 0.5),
    Kind("number", r"(?<![0-9+.-])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}", 0.3, ("phone", "telephone", "call", "tel", "mobile", "fax"), ("order", "id", "no"), "digits", 0.5, (10, 10)),
)
BASE = ("email", "ip", "card", "phone")

#: Code points on each side of a span, up to the next span of its kind, in which whole context words
#: count, and what a word adds or takes.
CONTEXT = 40
STEP = 0.25

# Characters of an account number by country.
IBAN_SIZES = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 "
    "GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
    "MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 "
    "VA22 VG24 XK20"
)

SPANS = "array<struct<start:bigint,kind_no:int,kind:string,stop:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (upper case, without spaces) passes the mod-97 check."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.split(moved, ""), F.lit(0), lambda rest, c: F.when(value(c) < 10, (rest * 10 + value(c)) % 97).otherwise((rest * 100 + value(c)) % 97)
    ) == 1


def _valid(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.validator == "parts":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        small = lambda p: F.coalesce(F.when(part(p), F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"), F.lit(False))
        return F.forall(F.split(match, r"\."), small)
    if kind.validator == "mod97":
        account = F.regexp_replace(match, " ", "")
        sizes = F.str_to_map(F.lit(",".join(f"{c[:2]}:{c[2:]}" for c in IBAN_SIZES.split())))
        wanted = F.try_element_at(sizes, F.substring(account, 1, 2)).cast("int")  # Other countries have no known length.
        return F.when(F.coalesce(wanted, F.length(account)) == F.length(account), mod97(account)).otherwise(False)
    if kind.validator in ("luhn", "digits"):
        right = F.length(digits).between(*kind.digits)
        return F.when(right, luhn(digits)).otherwise(False) if kind.validator == "luhn" else right
    return F.lit(True)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    """The score of a span between two pieces of text.  A word that is cut where the context ends does not count."""
    blank = F.lit(" ")
    near = F.concat(F.right(F.concat(blank, before), F.lit(CONTEXT + 1)), blank, F.left(F.concat(after, blank), F.lit(CONTEXT + 1)))
    score = F.lit(kind.score)
    for words, step in ((kind.likely, STEP), (kind.unlikely, -STEP)):
        if words:
            score = score + F.when(near.rlike(rf"(?i)(?<=[^\p{{L}}])(?:{'|'.join(words)})(?=[^\p{{L}}])"), step).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _spans(kind: Kind, number: int, text: Column) -> Column:
    """Confirmed spans of one kind: leftmost matches that do not overlap."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    sides = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.slice(pieces, 2, F.size(matches)), lambda p, q: F.struct(p.alias("before"), q.alias("after")))
    steps = F.zip_with(matches, sides, lambda m, s: F.struct(
        F.length(s["before"]).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size"),
        _valid(kind, m).alias("valid"), _score(kind, s["before"], s["after"]).alias("score"),
    ))
    # Running ends in two levels, so that the work stays in proportion to the matches.
    ends = _running(F.transform(steps, lambda s: s["gap"] + s["size"]))
    placed = F.zip_with(steps, ends, lambda s, end: F.struct(
        (end - s["size"]).alias("start"), F.lit(number).alias("kind_no"), F.lit(kind.name).alias("kind"), end.alias("stop"),
        F.when(s["valid"], s["score"]).otherwise(-1.0).alias("score"),
    ))
    confirmed = F.filter(placed, lambda s: s["score"] >= kind.needed)
    found = text.contains(kind.hint) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(found, confirmed).otherwise(F.array().cast(SPANS)).cast(SPANS)


def _running(values: Column, block: int = 128) -> Column:
    """Running totals of an array of numbers."""
    none = F.array().cast("array<bigint>")
    total = lambda array: F.aggregate(array, F.lit(0).cast("bigint"), lambda a, b: a + b)
    inside = lambda array, first: F.aggregate(array, none, lambda done, v: F.concat(
        done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), first) + v)))
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(block))).otherwise(F.array().cast("array<int>"))
    totals = F.transform(starts, lambda at: total(F.slice(values, at, block)))
    firsts = inside(totals, F.lit(0).cast("bigint"))
    return F.flatten(F.zip_with(F.zip_with(starts, totals, lambda at, own: F.struct(at.alias("at"), own.alias("own"))), firsts,
                                lambda s, end: inside(F.slice(values, s["at"], block), end - s["own"])))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data: row_id, text, spans, one row per input row, without a shuffle.

    ``spans``: array of (start, kind_no, kind, stop, score), sorted by start, then in the order
    of ``kinds``; positions are code points, the stop exclusive.  A null text is empty and has no
    spans.  Spans of different kinds may overlap.  Repeated rows and null ids are kept; other
    columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.select("row_id", "text", pii_spans(F.col("text"), kinds).alias("spans"))


def pii_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The spans of a text that is not null."""
    return F.array_sort(F.concat(*[_spans(k, i, text) for i, k in enumerate(kinds)]))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, the first names the gap."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(F.lit(0), span["start"] - done["at"]).cast("int"))
        name = F.when(span["start"] >= done["at"], F.concat(F.lit("<"), span["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(done["at"], span["stop"]).alias("at"), F.concat(done["out"], gap, name).alias("out"))

    rest = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
