"""Queries that render prompts and read completions back."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.functions import text as tx
from axonframe.functions.arrays import to_levels
from axonframe.operators import prompts, responses, tokens
from axonframe.operators.records import neuron_records, select_neurons, with_levels
from axonframe.operators.splits import one_split
from axonframe.plans.fixtures import acts
from axonframe.plans.record_queries import K
from axonframe.plans.registry import ACTS, LEVELS, TOPS, VALS, query, sql_heap
from axonframe.plans.registry import quoted as q
from axonframe.schemas import NEURON
from axonframe.session import cut_lineage

PREFIX = prompts.EXPLANATION_PREFIX
BASE = f"WITH {ACTS}, {TOPS}, {LEVELS}"


def levelled(spark, sf):
    return with_levels(acts(spark, sf))


# Rendering of one record.
@query(
    "render_records",
    f"""{BASE} SELECT layer, neuron, seq_id, {q(tx.FRAME_OPEN)} || array_to_string(list_transform(list_zip(tokens, levels),
      lambda z: z[1] || chr(9) || z[2]), chr(10)) || {q(tx.FRAME_CLOSE)} AS rendered FROM levels""",
)
def render_records(spark, sf):
    records = F.array(F.struct("tokens", "activations"))
    return levelled(spark, sf).select(*NEURON, "seq_id", tx.rendered_records(records, F.col("relu_max")).alias("rendered"))


@query(
    "render_omit_zeros",
    f"""{BASE} SELECT layer, neuron, seq_id, {q(tx.FRAME_OPEN)} || array_to_string(list_transform(
      list_filter(list_zip(tokens, levels), lambda z: z[2] > 0), lambda z: z[1] || chr(9) || z[2]), chr(10)) || {q(tx.FRAME_CLOSE)} AS rendered FROM levels""",
)
def render_omit_zeros(spark, sf):
    records = F.array(F.struct("tokens", "activations"))
    return levelled(spark, sf).select(
        *NEURON, "seq_id", tx.rendered_records(records, F.col("relu_max"), omit_zeros=True).alias("rendered")
    )


@query(
    "render_revealed",
    f"""{BASE} SELECT layer, neuron, seq_id, {q(tx.FRAME_OPEN)} || array_to_string(list_transform(list_zip(tokens, levels, range(len(levels))),
      lambda z: z[1] || chr(9) || CASE WHEN z[3] < 2 THEN 'unknown' ELSE CAST(z[2] AS VARCHAR) END), chr(10)) || {q(tx.FRAME_CLOSE)} AS rendered,
      {q(tx.FRAME_OPEN)} || array_to_string(list_transform(tokens, lambda t: t || chr(9) || 'unknown'), chr(10)) || {q(tx.FRAME_CLOSE)} AS hidden FROM levels""",
)
def render_revealed(spark, sf):
    records = F.array(F.struct("tokens", "activations"))
    top = F.col("relu_max")
    return levelled(spark, sf).select(
        *NEURON, "seq_id",
        tx.rendered_records(records, top, start_indices=F.array(F.lit(2))).alias("rendered"),
        tx.rendered_records(records, top, hide_activations=True).alias("hidden"),
    )


@query(
    "render_token_list",
    f"WITH {ACTS} SELECT layer, neuron, seq_id, array_to_string(list_transform(tokens, lambda t: '''' || t || ''''), ', ') AS listed FROM acts",
)
def render_token_list(spark, sf):
    return acts(spark, sf).select(*NEURON, "seq_id", tx.quoted_tokens(F.col("tokens")).alias("listed"))


# Prompts.  Every neuron shows its train split: positions 0, 4, 8 of its twelve top records.  The
# examples are the first two of these of two neurons.
TRAIN = f"""scored AS (SELECT *, list_max(activations) AS score FROM acts),
{sql_heap("scored", K, keep="seq_id, score, tokens, activations")},
sized AS (SELECT *, rank - 1 AS p, count(*) OVER (PARTITION BY layer, neuron) // 4 AS each FROM heap),
train AS (SELECT layer, neuron, p // 4 AS position, tokens, activations FROM sized WHERE p % 4 = 0 AND p < each * 4)"""
EXAMPLES_SQL = f"""{TRAIN},
ex AS (SELECT neuron AS example_no, list(struct_pack(t := tokens, a := activations) ORDER BY position) AS records,
  CASE neuron WHEN 0 THEN 'vowels' ELSE 'numbers' END AS explanation FROM train WHERE layer = 0 AND neuron < 2 AND position < 2 GROUP BY neuron)"""


def train_lists(spark, sf):
    kept = neuron_records(acts(spark, sf), K, 0, None)
    return prompts.record_lists(one_split(kept, "train"))


def examples(spark, sf):
    base = select_neurons(acts(spark, sf), [0], [0, 1])
    rows = prompts.record_lists(one_split(neuron_records(base, K, 0, None), "train"), 2)
    return rows.select(
        F.col("neuron").alias("example_no"), "records",
        F.when(F.col("neuron") == 0, "vowels").otherwise("numbers").alias("explanation"),
        F.array(F.lit(0), F.lit(1)).alias("first_revealed"),
    )


def _sql_levels(activations: str, top: str) -> str:
    return f"list_transform({activations}, lambda x: CASE WHEN {top} <= 0 THEN 0 ELSE CAST(least(10, floor(10.0 * greatest(0.0, x) / {top})) AS INT) END)"


RENDERED = f"""recs AS (SELECT key_layer, key_neuron, unnest(range(len(records))) AS i, unnest(records) AS r FROM owned),
tops2 AS (SELECT key_layer, key_neuron, greatest(0.0, max(list_max(r.a))) AS top FROM recs GROUP BY ALL),
lev AS (SELECT recs.key_layer, recs.key_neuron, i, r.t AS t, {_sql_levels("r.a", "top")} AS l FROM recs JOIN tops2 USING (key_layer, key_neuron)),
bodies AS (
  SELECT key_layer, key_neuron,
    {q(tx.FRAME_OPEN)} || string_agg(array_to_string(list_transform(list_zip(t, l), lambda z: z[1] || chr(9) || z[2]), chr(10)), {q(tx.FRAME_BETWEEN)} ORDER BY i) || {q(tx.FRAME_CLOSE)} AS body,
    {q(tx.FRAME_OPEN)} || string_agg(array_to_string(list_transform(list_filter(list_zip(t, l), lambda z: z[2] > 0), lambda z: z[1] || chr(9) || z[2]), chr(10)), {q(tx.FRAME_BETWEEN)} ORDER BY i) || {q(tx.FRAME_CLOSE)} AS nonzero,
    {q(tx.FRAME_OPEN)} || string_agg(array_to_string(list_transform(list_zip(t, l, range(len(l))), lambda z: z[1] || chr(9) || CASE WHEN z[3] < i THEN 'unknown' ELSE CAST(z[2] AS VARCHAR) END), chr(10)), {q(tx.FRAME_BETWEEN)} ORDER BY i) || {q(tx.FRAME_CLOSE)} AS revealed,
    sum(len(list_filter(l, lambda v: v <> 0))) / CAST(sum(len(l)) AS DOUBLE) AS share
  FROM lev GROUP BY ALL)"""
OWNED = """owned AS (
  SELECT layer AS key_layer, neuron AS key_neuron, list(struct_pack(t := tokens, a := activations) ORDER BY position) AS records
  FROM train GROUP BY ALL
  UNION ALL SELECT -1, example_no, records FROM ex)"""


def _ask_sql(number: str, tail: str) -> str:
    return (
        f"chr(10) || chr(10) || 'Neuron ' || {number} || chr(10) || 'Activations:' || body || "
        f"CASE WHEN share < 0.2 THEN {q(prompts.ZEROS_DROPPED)} || nonzero ELSE '' END || {tail}"
    )


def _explain_sql(lead: str, answer: str, mark: str, several: int | None = None) -> str:
    tail = lambda n: f"chr(10) || 'Explanation of neuron ' || {n} || ' behavior:' || {lead}"
    shown = own_tail = tail
    if several is not None:
        listed = lambda n, head, each: (
            f"chr(10) || '{head} for neuron ' || {n} || ' behavior, {each} with \"{PREFIX}\":' || chr(10) || '1. {PREFIX}'"
        )
        shown = lambda n: listed(n, "Here is 1 possible explanation", "beginning")
        own_tail = lambda n: listed(n, f"Here are {several} possible explanations", "each beginning")
    example = _ask_sql("(key_neuron + 1)", shown("(key_neuron + 1)"))
    own = _ask_sql("3", own_tail("3"))
    return f"""WITH {ACTS}, {EXAMPLES_SQL}, {OWNED}, {RENDERED},
    head AS (SELECT {q(prompts.EXPLAIN_SYSTEM)} || string_agg({example} || {answer} || ' ' || explanation || '.', '' ORDER BY key_neuron) AS head
      FROM bodies JOIN ex ON key_neuron = example_no WHERE key_layer = -1)
    SELECT key_layer AS layer, key_neuron AS neuron, head || {own} || {mark} AS prompt FROM bodies, head WHERE key_layer >= 0"""


@query("explain_prompts", _explain_sql(q(f" {PREFIX}"), "''", "''"))
def explain_prompts(spark, sf):
    return prompts.explain_prompts(train_lists(spark, sf), examples(spark, sf), "none").select(*NEURON, "prompt")


@query("explain_prompts_instruction", _explain_sql("''", q(f" {PREFIX}"), q(f"{prompts.END_OF_PROMPT} {PREFIX}")))
def explain_prompts_instruction(spark, sf):
    return prompts.explain_prompts(train_lists(spark, sf), examples(spark, sf), "instruction_following").select(*NEURON, "prompt")


@query("explain_prompts_numbered", _explain_sql("''", "''", "''", 3))
def explain_prompts_numbered(spark, sf):
    found = prompts.explain_prompts(train_lists(spark, sf), examples(spark, sf), "none", numbered_list=3)
    return found.select(*NEURON, "prompt")


# The small context: one record per example, two of the neuron's own.
OWNED_SMALL = """owned AS (
  SELECT layer AS key_layer, neuron AS key_neuron, list(struct_pack(t := tokens, a := activations) ORDER BY position) AS records
  FROM train WHERE position < 2 GROUP BY ALL
  UNION ALL SELECT -1, example_no, records[1:1] FROM ex)"""


@query("explain_prompts_2k", _explain_sql(q(f" {PREFIX}"), "''", "''").replace(OWNED, OWNED_SMALL))
def explain_prompts_2k(spark, sf):
    found = prompts.explain_prompts(train_lists(spark, sf), examples(spark, sf), "none", context_size=2049)
    return found.select(*NEURON, "prompt")


# Room for a completion that leaves some prompts whole and makes others give up records of their examples.
LONG_ANSWER = 3692
OWNED_FEWER = f"""{OWNED[:-1]} UNION ALL SELECT -2, example_no, records[1:1] FROM ex)"""
_TURN = lambda n: _ask_sql(n, f"chr(10) || 'Explanation of neuron ' || {n} || ' behavior:' || {q(f' {PREFIX}')}")


@query(
    "explain_prompts_shrunk",
    f"""WITH {ACTS}, {EXAMPLES_SQL}, {OWNED_FEWER}, {RENDERED},
    heads AS (SELECT dropped, {q(prompts.EXPLAIN_SYSTEM)} || string_agg({_TURN("(key_neuron + 1)")} || ' ' || explanation || '.', '' ORDER BY key_neuron) AS head
      FROM bodies JOIN ex ON key_neuron = example_no, range(3) d(dropped) WHERE key_layer = CASE WHEN key_neuron < dropped THEN -2 ELSE -1 END GROUP BY dropped),
    texts AS (SELECT key_layer AS layer, key_neuron AS neuron, dropped, head || {_TURN("3")} AS prompt FROM bodies, heads WHERE key_layer >= 0),
    measured AS (SELECT *, len(regexp_extract_all(prompt, '(\\w+|[^\\w\\s])'))::BIGINT AS n_tokens FROM texts),
    placed AS (SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY CASE WHEN n_tokens + {LONG_ANSWER} <= 4097 THEN dropped ELSE 9 - dropped END) AS place FROM measured)
    SELECT layer, neuron, n_tokens, prompt FROM placed WHERE place = 1""",
)
def explain_prompts_shrunk(spark, sf):
    found = prompts.explain_prompts(train_lists(spark, sf), examples(spark, sf), "none", max_completion=LONG_ANSWER)
    return found.select(*NEURON, "n_tokens", "prompt")


_ASKED = _ask_sql("(key_neuron + 1)", f"chr(10) || 'Explanation of neuron ' || (key_neuron + 1) || ' behavior:' || {q(f' {PREFIX}')}")


@query(
    "explain_messages",
    f"""WITH {ACTS}, {EXAMPLES_SQL}, {OWNED}, {RENDERED},
    own AS (SELECT key_layer AS layer, key_neuron AS neuron, {_ask_sql("3", "chr(10) || 'Explanation of neuron 3 behavior:" + f" {PREFIX}'")} AS content FROM bodies WHERE key_layer >= 0),
    shown AS (SELECT key_neuron, {_ASKED} AS content FROM bodies WHERE key_layer = -1)
    SELECT layer, neuron, CAST(5 AS BIGINT) AS position, 'user' AS role, content FROM own
    UNION ALL SELECT layer, neuron, 4, 'assistant', ' numbers.' FROM own
    UNION ALL SELECT layer, neuron, 1 + 2 * key_neuron, 'user', shown.content FROM own, shown
    UNION ALL SELECT layer, neuron, 2, 'assistant', ' vowels.' FROM own
    UNION ALL SELECT layer, neuron, 0, 'system', {q(prompts.EXPLAIN_SYSTEM)} FROM own""",
)
def explain_messages(spark, sf):
    found = prompts.explain_prompts(train_lists(spark, sf), examples(spark, sf), "harmony_v4")
    rows = found.select(*NEURON, F.posexplode("prompt").alias("position", "m"))
    return rows.select(*NEURON, "position", "m.role", "m.content")


TABLE = """means AS (SELECT layer, neuron, token, avg(a) AS avg_activation FROM vals GROUP BY ALL),
listed AS (SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY avg_activation DESC, token) AS rank FROM means),
lists AS (SELECT layer, neuron, string_agg('''' || token || '''', ', ' ORDER BY rank) AS shown FROM listed WHERE rank <= 5 GROUP BY ALL)"""


@query(
    "token_prompts",
    f"""WITH {ACTS}, {VALS}, {TABLE}
    SELECT layer, neuron, {q(prompts.TOKENS_SYSTEM)} || repeat(chr(10), 4) || 'Tokens:' || chr(10) || shown || chr(10) || chr(10) ||
      'Explanation:' || chr(10) || {q(prompts.LOOKING_FOR)} AS prompt FROM lists""",
)
def token_prompts(spark, sf):
    table = tokens.token_lists(tokens.token_averages(acts(spark, sf), 5))
    return prompts.token_prompts(table.select(*NEURON, "tokens"), fmt="none").select(*NEURON, "prompt")


@query(
    "token_prompts_examples",
    f"""WITH {ACTS}, {VALS}, {TABLE}, turns AS (
      SELECT layer, neuron, repeat(chr(10), 4) || 'Tokens:' || chr(10) || shown || chr(10) || chr(10) || 'Explanation:' || chr(10) AS ask FROM lists),
    head AS (SELECT {q(prompts.TOKENS_SYSTEM)} || string_agg(ask || {q(prompts.LOOKING_FOR)} || CASE neuron WHEN 0 THEN ' vowels.' ELSE ' numbers.' END, '' ORDER BY neuron) AS head
      FROM turns WHERE layer = 0 AND neuron < 2)
    SELECT layer, neuron, head || ask || {q(prompts.END_OF_PROMPT + prompts.LOOKING_FOR)} AS prompt FROM turns, head""",
)
def token_prompts_examples(spark, sf):
    """Two neurons' lists with their explanations come before each neuron's own."""
    lists = cut_lineage(tokens.token_lists(tokens.token_averages(acts(spark, sf), 5)).select(*NEURON, "tokens"))
    explanation = F.when(F.col("neuron") == 0, " vowels").otherwise(" numbers").alias("explanation")
    shown = select_neurons(lists, [0], [0, 1]).select(F.col("neuron").alias("example_no"), "tokens", explanation)
    return prompts.token_prompts(lists, shown, "instruction_following").select(*NEURON, "prompt")


def sequences(spark, sf):
    explanation = F.concat(F.lit(" neuron "), F.col("neuron").cast("string"), F.lit(" "))
    return acts(spark, sf).select(*NEURON, "seq_id", "tokens", explanation.alias("explanation"))


ABOUT = lambda n, e: f"'Neuron ' || {n} || chr(10) || 'Explanation of neuron ' || {n} || ' behavior: {PREFIX} ' || {e}"
SEQ_HEAD = f"WITH {ACTS}, {EXAMPLES_SQL}, {OWNED}, {RENDERED}"


@query(
    "simulate_prompts",
    f"""{SEQ_HEAD}, head AS (
      SELECT {q(prompts.SIMULATE_SYSTEM)} || string_agg(chr(10) || chr(10) || {ABOUT("(key_neuron + 1)", "explanation")} || chr(10) || 'Activations: ' || revealed || chr(10), '' ORDER BY key_neuron) AS head
      FROM bodies JOIN ex ON key_neuron = example_no WHERE key_layer = -1)
    SELECT layer, neuron, seq_id, head || chr(10) || chr(10) || {ABOUT("3", "'neuron ' || neuron")} || {q(prompts.END_OF_PROMPT)} || chr(10) || 'Activations: ' ||
      {q(tx.FRAME_OPEN)} || array_to_string(list_transform(tokens, lambda t: t || chr(9) || 'unknown'), chr(10)) || {q(tx.FRAME_CLOSE)} AS prompt FROM acts, head""",
)
def simulate_prompts(spark, sf):
    found = prompts.simulate_prompts(sequences(spark, sf), examples(spark, sf))
    return found.select(*NEURON, "seq_id", "prompt")


def token_example(shown):
    return shown.where(F.col("example_no") == 0).select("records", F.lit(3).alias("token_index"))


LAST = lambda n, e, t: (
    f"chr(10) || {ABOUT(n, e)} || chr(10) || 'Text:' || chr(10) || array_to_string({t}, '') || {q(prompts.LAST_TOKEN)} || ({t})[-1] || {q(prompts.LAST_ACTIVATION)}"
)


@query(
    "single_token_prompts",
    f"""{SEQ_HEAD}, head AS (
      SELECT {q(prompts.TOKEN_SYSTEM)} || chr(10) || string_agg({ABOUT("(key_neuron + 1)", "explanation")} || chr(10) || 'Activations: ' || body || chr(10) || chr(10), '' ORDER BY key_neuron)
        || {q(prompts.TOKEN_TURN)} AS head FROM bodies JOIN ex ON key_neuron = example_no WHERE key_layer = -1),
    one AS (SELECT records[1].t[1:4] AS t, {_sql_levels("records[1].a", "greatest(0.0, list_max(records[1].a))")}[4] AS level FROM ex WHERE example_no = 0),
    asked AS (SELECT layer, neuron, seq_id, unnest(range(len(tokens))) AS pos, tokens AS all_tokens FROM acts)
    SELECT layer, neuron, seq_id, pos, md5(head || {LAST("3", "'neuron ' || neuron", "one.t")} || level || chr(10) || chr(10) ||
      {LAST("4", "'neuron ' || neuron", "all_tokens[1:pos + 1]")} || {q(prompts.END_OF_PROMPT)}) AS digest FROM asked, head, one""",
)
def single_token_prompts(spark, sf):
    shown = cut_lineage(examples(spark, sf))
    found = prompts.single_token_prompts(sequences(spark, sf), shown, token_example(shown))
    return found.select(*NEURON, "seq_id", "pos", F.md5("prompt").alias("digest"))


PLAIN_END = q(tx.PLAIN_END)
ASK_PLAIN = lambda n, t: (
    f"'Sequence ' || {n} || ' Tokens without Activations:' || chr(10) || array_to_string(list_transform({t}, lambda x: x || chr(9) || {PLAIN_END}), '') || "
    f"chr(10) || chr(10) || 'Sequence ' || {n} || ' Tokens with Activations:' || chr(10)"
)


@query(
    "plain_prompts",
    f"""{SEQ_HEAD}, turns AS (
      SELECT key_neuron, i, CASE WHEN i = 0 THEN {ABOUT("(key_neuron + 1)", "explanation")} || chr(10) || chr(10) ELSE '' END || {ASK_PLAIN("(i + 1)", "t")} ||
        array_to_string(list_transform(list_zip(t, l), lambda z: z[1] || chr(9) || z[2] || {PLAIN_END}), '') || chr(10) || chr(10) AS turn
      FROM lev JOIN ex ON key_neuron = example_no WHERE key_layer = -1),
    head AS (SELECT {q(prompts.TOKEN_SYSTEM + prompts.PLAIN_SYSTEM)} || string_agg(turn, '' ORDER BY key_neuron, i) AS head FROM turns)
    SELECT layer, neuron, seq_id, head || {ABOUT("3", "' neuron ' || neuron || ' '")} || chr(10) || chr(10) || {ASK_PLAIN("1", "tokens")} AS prompt FROM acts, head""",
)
def plain_prompts(spark, sf):
    found = prompts.plain_prompts(sequences(spark, sf), examples(spark, sf), "none")
    return found.select(*NEURON, "seq_id", "prompt")


# Completions rendered from the levels, some of them damaged by rule.
@query(
    "completion_parse",
    f"""{BASE} SELECT layer, neuron, seq_id, array_to_string(CASE seq_id % 4
      WHEN 0 THEN levels
      WHEN 1 THEN list_transform(list_zip(levels, range(len(levels))), lambda z: CASE WHEN z[2] = len(levels) - 1 THEN 0 ELSE z[1] END)
      WHEN 2 THEN list_transform(levels, lambda v: 0)
      ELSE list_transform(levels, lambda v: CASE WHEN v = 3 THEN 0 ELSE v END) END, ',') AS parsed FROM levels""",
)
def completion_parse(spark, sf):
    """By sequence: clean after a lead-in; with a closing mark; with a changed token; with a bad level."""
    rows = levelled(spark, sf)
    body = tx.plain_lines(F.col("tokens"), F.col("levels"))
    unclosed = F.substr(body, F.lit(1), F.length(body) - len(tx.PLAIN_END))
    kind = F.col("seq_id") % 4
    completion = (
        F.when(kind == 0, F.concat(F.lit("\nSure.\t༗\n"), unclosed))
        .when(kind == 1, body)
        .when(kind == 2, F.concat(F.lit("x"), F.substr(unclosed, F.lit(1))))
        .otherwise(F.replace(F.concat(unclosed, F.lit("༗\n")), F.lit("\t3༗\n"), F.lit("\televen༗\n")))
    )
    completion = F.when(kind == 3, F.substr(completion, F.lit(1), F.length(completion) - 2)).otherwise(completion)
    choice = F.struct(F.lit(None).cast("string").alias("text"), F.struct(completion.alias("content")).alias("message"))
    response = F.struct(F.array(choice).alias("choices")).alias("response")
    parsed = responses.parse_plain_responses(rows.select(*NEURON, "seq_id", "tokens", response))
    return parsed.select(
        *NEURON, "seq_id", F.array_join(F.transform("expected", lambda v: v.cast("int").cast("string")), ",").alias("parsed")
    )


def echo_responses(spark, sf, accent=""):
    """An echoed prompt per sequence.  Every fifth token is split in two by the responding
    model, every seventh one has the newline before it folded in.  With an ``accent`` before each
    token, those that are split start with its bytes, one response token each."""
    rows = levelled(spark, sf).where(F.size("tokens") > 0)
    rows = rows.withColumn("tokens", F.transform("tokens", lambda t: F.concat(F.lit(accent), t)))
    octets = F.array(*[F.lit(f"bytes:\\x{octet:02x}") for octet in accent.encode()])

    def pieces(t, i):
        split = F.array(F.substr(t, F.lit(1), F.lit(1)), F.substr(t, F.lit(2)))
        if accent:
            split = F.concat(octets, F.array(F.substr(t, F.lit(len(accent) + 1))))
        folded = F.array(F.concat(F.lit("\n"), t))
        name = F.when((i + F.col("seq_id")) % 7 == 3, folded).when(
            (i + F.col("seq_id")) % 5 == 1, F.concat(F.array(F.lit("\n")), split)
        ).otherwise(F.array(F.lit("\n"), t))
        return F.concat(name, F.array(F.lit("\t"), F.lit("unknown")))

    lead = F.array(*[F.lit(t) for t in ["t1", "\t", "unknown", "<start>"]])
    tail = F.array(*[F.lit(t) for t in ["\n", "<", "end", ">", "\n"]])
    seen = F.concat(lead, F.flatten(F.transform("tokens", pieces)), tail)
    offsets = F.transform(
        F.sequence(F.lit(0), F.size("seen") - 1),
        lambda i: F.length(F.array_join(F.slice(F.col("seen"), F.lit(1), i), "")),
    )
    # The k-th unknown mark after the lead predicts the k-th level with certainty 3 : 1 against the next.
    marks = F.transform("seen", lambda s, i: F.size(F.filter(F.slice(F.col("seen"), F.lit(1), i + 1), lambda x: x == "unknown")) - 2)
    level = lambda k: F.get("levels", k)
    top = F.transform(
        marks,
        lambda k: F.when(
            k >= 0,
            F.map_from_arrays(
                F.array(level(k).cast("string"), ((level(k) + 1) % 11).cast("string"), F.lit("x")),
                F.array(F.lit(-0.28768207245178085), F.lit(-1.3862943611198906), F.lit(-0.1)),
            ),
        ).otherwise(F.map_from_arrays(F.array(F.lit("x")), F.array(F.lit(-0.1)))),
    )
    staged = rows.withColumn("seen", seen).withColumn("offsets", offsets).withColumn("top", top)
    logprobs = F.struct(F.col("seen").alias("tokens"), F.col("top").alias("top_logprobs"), F.col("offsets").alias("text_offset"))
    choice = F.struct(
        F.array_join("seen", "").alias("text"), F.struct(F.lit(None).cast("string").alias("content")).alias("message"), logprobs.alias("logprobs")
    )
    return staged.select(*NEURON, "seq_id", "tokens", F.struct(F.array(choice).alias("choices")).alias("response"))


ALIGNED = f"""{BASE}, v AS (SELECT layer, neuron, seq_id, unnest(range(len(levels))) AS pos, unnest(levels) AS l FROM levels)
    SELECT layer, neuron, seq_id, pos, 'simulated_normalized_activations' AS scale,
      CASE WHEN (pos + seq_id) % 7 = 3 THEN 0.0 ELSE round(0.75::DOUBLE * l + 0.25::DOUBLE * ((l + 1) % 11), 6) END AS expected,
      CAST(CASE WHEN (pos + seq_id) % 7 = 3 THEN 0 ELSE 2 END AS BIGINT) AS n_levels FROM v"""


def aligned(found):
    rows = found.select(*NEURON, "seq_id", "scale", F.posexplode(F.arrays_zip("expected", "dist_values")).alias("pos", "z"))
    return rows.select(
        *NEURON, "seq_id", F.col("pos").cast("bigint").alias("pos"), "scale",
        F.round("z.expected", 6).alias("expected"), F.size("z.dist_values").alias("n_levels"),
    )


@query("response_align", ALIGNED)
def response_align(spark, sf):
    return aligned(responses.parse_echo_responses(echo_responses(spark, sf)))


@query("response_bytes", ALIGNED)
def response_bytes(spark, sf):
    """Tokens whose first letter comes back as two byte tokens."""
    return aligned(responses.parse_echo_responses(echo_responses(spark, sf, "é")))


@query(
    "single_token_responses",
    f"""{BASE} SELECT layer, neuron, seq_id, array_to_string(tokens, ' ') AS tokens,
    round(list_sum(list_transform(levels, lambda l: 0.75::DOUBLE * l + 0.25::DOUBLE * ((l + 1) % 11))), 6) AS total FROM levels""",
)
def single_token_responses(spark, sf):
    rows = levelled(spark, sf).select(*NEURON, "seq_id", F.posexplode(F.arrays_zip("tokens", "levels")).alias("pos", "z"))
    level = F.col("z.levels")
    top = F.map_from_arrays(
        F.array(level.cast("string"), ((level + 1) % 11).cast("string")), F.array(F.lit(-0.28768207245178085), F.lit(-1.3862943611198906))
    )
    logprobs = F.struct(F.array(top).alias("top_logprobs"))
    response = F.struct(F.array(F.struct(logprobs.alias("logprobs"))).alias("choices")).alias("response")
    asked = rows.select(*NEURON, "seq_id", "pos", F.col("z.tokens").alias("token"), response)
    found = responses.parse_token_responses(asked, [*NEURON, "seq_id"])
    total = F.aggregate("expected", F.lit(0.0), lambda a, b: a + b)
    return found.select(*NEURON, "seq_id", F.array_join("tokens", " ").alias("tokens"), F.round(total, 6).alias("total"))
