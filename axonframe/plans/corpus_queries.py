"""Queries over texts: windows, slices, shards, labels, conversations, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.functions.text import is_blank, split_numbered, strip, without_final_period
from axonframe.operators import corpus, labels, prompts, responses
from axonframe.operators.plugins import activations_with
from axonframe.operators.scale import previous_value
from axonframe.plans.fixtures import acts, table
from axonframe.plans.registry import ACTS, query, quoted

END = quoted(prompts.END_OF_PROMPT)

# The blank class of the engine in the SQL engine's regex syntax.
SQL_BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '\\A{SQL_BLANK}+|{SQL_BLANK}+\\z', '', 'g')"


STREAM = r"""words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda t: t <> '') AS tokens FROM documents),
flat AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM words),
stream AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM flat)"""


def windows_sql(length: int, stride: int, cap: int | None = None) -> str:
    limit = f" AND k < {cap}" if cap else ""
    return f"""WITH {STREAM},
    placed AS (SELECT token, p, unnest(range(greatest(0, (p - {length}) // {stride}), p // {stride} + 1)) AS k FROM stream),
    windows AS (SELECT k AS seq_id, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY p) AS tokens
      FROM placed WHERE p >= k * {stride} AND p < k * {stride} + {length}{limit} GROUP BY k)
    SELECT * FROM windows WHERE n_tokens = {length}"""


def _windows(name: str, length: int, stride: int | None, cap: int | None = None):
    @query(name, windows_sql(length, stride or length, cap))
    def run(spark, sf):
        found = corpus.token_windows(table(spark, sf, "documents"), length, stride, cap, context=1024)
        return found.select("seq_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))

    return run


_windows("corpus_windows", 64, None)
_windows("corpus_windows_stride", 64, 48)
_windows("corpus_windows_gap", 64, 80)
_windows("corpus_windows_capped", 128, 128, 1000)

@query(
    "corpus_windows_letters",
    """WITH flat AS (SELECT doc_id, unnest(string_split(text, '')) AS token, unnest(range(length(text))) AS i FROM documents WHERE trim(text) <> ''),
    stream AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM flat)
    SELECT p // 256 AS seq_id, md5(string_agg(token, '' ORDER BY p)) AS digest FROM stream GROUP BY ALL HAVING count(*) = 256""",
)
def corpus_windows_letters(spark, sf):
    """A caller's own tokeniser: single characters."""
    found = corpus.token_windows(table(spark, sf, "documents"), 256, tokenizer=lambda text: F.split(text, ""))
    return found.select("seq_id", F.md5(F.array_join("tokens", "")).alias("digest"))


INDEXED = "indexed AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents)"


@query("row_index", f"WITH {INDEXED} SELECT doc_id, row_index FROM indexed")
def row_index(spark, sf):
    return corpus.with_row_index(table(spark, sf, "documents").select("doc_id"))


@query(
    "percent_slice",
    f"WITH {INDEXED} SELECT doc_id, row_index FROM indexed WHERE row_index >= round(0.125 * (SELECT count(*) FROM documents)) AND row_index < round(0.5 * (SELECT count(*) FROM documents))",
)
def percent_slice(spark, sf):
    return corpus.spec_slice(table(spark, sf, "documents").select("doc_id"), "corpus[12.5%:50%]")


@query("corpus_slice", f"WITH {INDEXED} SELECT doc_id, row_index, lang, length(text) AS n FROM indexed WHERE row_index >= 100")
def corpus_slice(spark, sf):
    wanted = corpus.parse_range("train[100:]")
    found = corpus.row_slice(table(spark, sf, "documents"), wanted.start, wanted.end)
    return found.select("doc_id", "row_index", "lang", F.length("text").alias("n"))


@query(
    "shard_ranges",
    f"""WITH {INDEXED}, total AS (SELECT count(*) AS n FROM documents)
    SELECT doc_id, row_index, CASE WHEN row_index < (n % 7) * (n // 7 + 1) THEN row_index // (n // 7 + 1)
      ELSE (n % 7) + (row_index - (n % 7) * (n // 7 + 1)) // (n // 7) END AS shard_id FROM indexed, total""",
)
def shard_ranges(spark, sf):
    return corpus.with_shard(table(spark, sf, "documents").select("doc_id"), 7).select("doc_id", "row_index", "shard_id")


@query(
    "blank_filter",
    rf"""WITH parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line FROM documents)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT regexp_full_match(line, '{SQL_BLANK}*')) AS n_kept,
    sum(length({sql_strip("line")}))::BIGINT AS n_chars FROM parts GROUP BY doc_id""",
)
def blank_filter(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count(F.when(~is_blank(F.col("line")), 1)).alias("n_kept"),
        F.sum(F.length(strip(F.col("line")))).alias("n_chars"),
    )


@query(
    "usable_texts",
    rf"""SELECT doc_id, md5({sql_strip("text")}) AS digest FROM documents WHERE NOT regexp_full_match(text, '{SQL_BLANK}*')""",
)
def usable_texts(spark, sf):
    return corpus.usable_texts(table(spark, sf, "documents"), stripped=True).select("doc_id", F.md5("text").alias("digest"))


# Label roll-ups.
LONG = """long AS (
  UNPIVOT (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))
  ON quality, toxic INTO NAME label VALUE value)"""


def long_labels(spark, sf):
    joined = labels.join_arguments(
        table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), key="doc_id"
    )
    return labels.unpivot_labels(joined, ["doc_id", "lang"])


@query("label_unpivot", f"WITH {LONG} SELECT doc_id, lang, label, CAST(value AS BIGINT) AS value FROM long")
def label_unpivot(spark, sf):
    return long_labels(spark, sf)


@query(
    "label_prevalence",
    f"WITH {LONG} SELECT label, sum(value)::BIGINT AS positives, count(value) AS n, round(avg(value), 6) AS share FROM long GROUP BY label",
)
def label_prevalence(spark, sf):
    return labels.label_prevalence(long_labels(spark, sf)).withColumn("share", F.round("share", 6))


@query("labels_per_text", f"WITH {LONG} SELECT doc_id, sum(value)::BIGINT AS n_labels FROM long GROUP BY doc_id")
def labels_per_text(spark, sf):
    return labels.labels_per_text(long_labels(spark, sf), ["doc_id"])


@query(
    "label_rollup",
    f"WITH {LONG} SELECT label, lang, sum(value)::BIGINT AS value, count(*) AS n FROM long GROUP BY ROLLUP (label, lang)",
)
def label_rollup(spark, sf):
    return labels.rolled_totals(long_labels(spark, sf), "label", "lang", "value")


@query(
    "taxonomy_roll_up",
    """SELECT s.c_mktsegment AS segment, r.r_name AS level2, max(CASE WHEN s.c_acctbal > 9000 THEN 1 ELSE 0 END)::BIGINT AS value
    FROM customer s JOIN nation n ON s.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY s.c_mktsegment, r.r_name""",
)
def taxonomy_roll_up(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    taxonomy = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("level1"), F.col("r_name").alias("level2")
    )
    long = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("label"), (F.col("c_acctbal") > 9000).cast("int").alias("value")
    )
    return labels.roll_up(long, taxonomy, ["segment"])


@query(
    "argument_join",
    """SELECT d.doc_id, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic, b.text AS note FROM documents d
    JOIN labels l USING (doc_id) LEFT JOIN (SELECT item_id AS doc_id, text FROM benchmark) b USING (doc_id)""",
)
def argument_join(spark, sf):
    notes = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("note"))
    texts = table(spark, sf, "documents").select("doc_id")
    return labels.join_arguments(texts, table(spark, sf, "labels"), notes, "doc_id")


# Conversations as prompts.
def turns(spark, sf):
    return table(spark, sf, "conversations").withColumnRenamed("text", "content")


def messages(spark, sf):
    return prompts.grouped_messages(turns(spark, sf), ["conv_id"])


ORDERED = """ordered AS (
  SELECT conv_id, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""
BROKEN = """broken AS (
  SELECT conv_id, i FROM ordered
  WHERE role <> CASE WHEN before IS NULL THEN 'system' WHEN before = 'user' THEN 'assistant' ELSE 'user' END)"""


@query("role_violations", f"WITH {ORDERED}, {BROKEN} SELECT conv_id, i AS position FROM broken")
def role_violations(spark, sf):
    return messages(spark, sf).select("conv_id", F.explode(prompts.role_violations(F.col("messages"))).alias("position"))


@query(
    "role_violations_long",
    f"""WITH turned AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn, role, before FROM turned
    WHERE role <> CASE WHEN before IS NULL THEN 'system' WHEN before = 'user' THEN 'assistant' ELSE 'user' END AND role <> 'system'""",
)
def role_violations_long(spark, sf):
    """The same check on the long table, for conversations that are too long for one row."""
    lagged = previous_value(turns(spark, sf).drop("content"), ["conv_id"], "turn", "role", "before", chunk=2)
    wanted = F.when(F.col("before").isNull(), "system").when(F.col("before") == "user", "assistant").otherwise("user")
    return lagged.where((F.col("role") != wanted) & (F.col("role") != "system"))


# A system message is put in front of conversations that have none; valid ones are rendered.
FIXED = f"""fixed AS (
  SELECT conv_id, -1 AS i, 'system' AS role, 'Be brief.' AS content FROM ordered WHERE i = 0 AND role <> 'system'
  UNION ALL SELECT conv_id, i, role, content FROM ordered),
relagged AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM fixed),
wrong AS (SELECT DISTINCT conv_id FROM relagged
  WHERE role <> CASE WHEN before IS NULL THEN 'system' WHEN before = 'user' THEN 'assistant' ELSE 'user' END),
last_user AS (SELECT conv_id, max(i) AS last FROM fixed WHERE role = 'user' GROUP BY conv_id)"""


def valid_messages(spark, sf):
    system = F.array(prompts.message("system", "Be brief."))
    fixed = F.when(F.get("messages", F.lit(0))["role"] == "system", F.col("messages")).otherwise(F.concat(system, F.col("messages")))
    table_ = messages(spark, sf).withColumn("messages", fixed)
    return table_.where(F.size(prompts.role_violations(F.col("messages"))) == 0)


@query(
    "prompt_concat",
    f"""WITH {ORDERED}, {FIXED} SELECT conv_id, string_agg(content, '' ORDER BY i) AS prompt FROM fixed
    WHERE conv_id NOT IN (SELECT conv_id FROM wrong) GROUP BY conv_id""",
)
def prompt_concat(spark, sf):
    return valid_messages(spark, sf).select("conv_id", prompts.finish(F.col("messages"), "none").alias("prompt"))


@query(
    "prompt_instruction",
    f"""WITH {ORDERED}, {FIXED} SELECT conv_id, string_agg(content || CASE WHEN i = last THEN {END} ELSE '' END, '' ORDER BY i) AS prompt
    FROM fixed JOIN last_user USING (conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM wrong) GROUP BY conv_id""",
)
def prompt_instruction(spark, sf):
    return valid_messages(spark, sf).select("conv_id", prompts.finish(F.col("messages"), "instruction_following").alias("prompt"))


@query(
    "prompt_length",
    r"""SELECT conv_id, (sum(4 + len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\t\n\x0b\f\r ]'))) + 2)::BIGINT AS n_tokens
    FROM conversations GROUP BY conv_id""",
)
def prompt_length(spark, sf):
    return messages(spark, sf).select("conv_id", prompts.prompt_length(F.col("messages"), "harmony_v4").alias("n_tokens"))


# Completions: documents with list markers put in.
@query(
    "numbered_list_split",
    rf"""WITH marked AS (SELECT doc_id, replace(replace(text, '. ', chr(10) || '2.  '), ', ', chr(10) || '13.the main thing this neuron does is find ') AS c FROM documents),
    items AS (SELECT doc_id, list_transform(regexp_split_to_array(c, '\n\p{{Nd}}+\.'), lambda s: regexp_replace(s, '\A{SQL_BLANK}+', '')) AS parts FROM marked),
    rows AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM items)
    SELECT doc_id, i AS position, {sql_strip("CASE WHEN starts_with(part, 'the main thing this neuron does is find') THEN substr(part, 40) ELSE part END")} AS explanation FROM rows""",
)
def numbered_list_split(spark, sf):
    marked = F.replace(
        F.replace(F.col("text"), F.lit(". "), F.lit("\n2.  ")), F.lit(", "), F.lit(f"\n13.{prompts.EXPLANATION_PREFIX} ")
    )
    found = prompts.explanations_from(F.array(marked), numbered_list=True)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("position", "explanation"))


@query(
    "final_period",
    r"""WITH e AS (SELECT doc_id, unnest([0::BIGINT, 1, 2, 3]) AS kind, unnest([text, text || '.', text || '. ', text || '.' || chr(10)]) AS t FROM documents)
    SELECT doc_id, kind, md5(CASE WHEN right(t, 1) = '.' THEN left(t, length(t) - 1) WHEN right(t, 2) = '. ' THEN left(t, length(t) - 2) ELSE t END) AS digest FROM e""",
)
def final_period(spark, sf):
    text = F.col("text")
    kinds = F.array(text, F.concat(text, F.lit(".")), F.concat(text, F.lit(". ")), F.concat(text, F.lit(".\n")))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(kinds).alias("kind", "t"))
    return rows.select("doc_id", "kind", F.md5(without_final_period(F.col("t"))).alias("digest"))


@query(
    "request_dedupe",
    """SELECT role, text, count(*) AS asked FROM (SELECT DISTINCT role, text FROM conversations
      WHERE (role, text) NOT IN (SELECT role, text FROM conversations WHERE turn = 1)) GROUP BY ALL""",
)
def request_dedupe(spark, sf):
    key = ["role", "text"]
    rows = table(spark, sf, "conversations").select("turn", *key)
    answered = prompts.new_requests(rows.where(F.col("turn") == 1).select(*key), None, key)
    return prompts.new_requests(rows.select(*key), answered, key).groupBy(*key).agg(F.count("*").alias("asked"))


# Log probabilities: the embedding values of a vector, at levels 0..10 and stray tokens beyond.
@query(
    "logprob_expected_value",
    """WITH lp AS (SELECT vec_id, unnest(range(len(embedding))) AS level, unnest(embedding) AS x FROM embeddings),
    w AS (SELECT vec_id, level, exp(-abs(CAST(x AS DOUBLE)) * 10.0::DOUBLE) AS w FROM lp WHERE level <= 10 AND (level + vec_id) % 3 <> 0)
    SELECT vec_id, round(sum(level * w) / sum(w), 6) AS expected, count(*) AS n_levels, round(max(w) / sum(w), 6) AS top_probability FROM w GROUP BY vec_id""",
)
def logprob_expected_value(spark, sf):
    pairs = F.filter(
        F.transform(
            "embedding",
            lambda x, i: F.struct(i.cast("string").alias("k"), (-F.abs(x.cast("double")) * 10.0).alias("v"), i.alias("i")),
        ),
        lambda p: (p["i"] + F.col("vec_id")) % 3 != 0,
    )
    logprobs = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))
    found = table(spark, sf, "embeddings").select("vec_id", responses.token_estimate(logprobs).alias("e"))
    return found.select(
        "vec_id", F.round("e.expected", 6).alias("expected"), F.size("e.values").alias("n_levels"),
        F.round(F.array_max("e.probs"), 6).alias("top_probability"),
    )


@query(
    "numbered_items",
    rf"""SELECT doc_id, len(regexp_split_to_array(text, '\n\p{{Nd}}+\.')) AS n_items FROM documents""",
)
def numbered_items(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(split_numbered(F.col("text"))).alias("n_items"))


# A caller's function over corpus windows: neuron n of two reacts to words of length n + 3.
def _word_lengths(batch):
    import pandas as pd

    parts = []
    for neuron in range(2):
        values = [[float(len(t) == neuron + 3) * (1 + i % 4) for i, t in enumerate(tokens)] for tokens in batch["tokens"]]
        parts.append(batch.assign(layer=0, neuron=neuron, activations=values))
    return pd.concat(parts)[["layer", "neuron", "seq_id", "tokens", "activations"]]


@query(
    "plugin_activations",
    f"""WITH {STREAM}, placed AS (SELECT p // 64 AS seq_id, p % 64 AS i, token FROM stream),
    n AS (SELECT unnest([0::BIGINT, 1]) AS neuron)
    SELECT CAST(0 AS BIGINT) AS layer, neuron, seq_id, sum(CASE WHEN length(token) = neuron + 3 THEN 1 + i % 4 ELSE 0 END)::DOUBLE AS total
    FROM placed, n GROUP BY neuron, seq_id HAVING count(*) = 64""",
)
def plugin_activations(spark, sf):
    windows = corpus.token_windows(table(spark, sf, "documents"), 64)
    found = activations_with(windows, _word_lengths)
    return found.select("layer", "neuron", "seq_id", F.aggregate("activations", F.lit(0.0), lambda a, b: a + b).alias("total"))
