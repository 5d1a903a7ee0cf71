"""Queries that write files, read them back, and keep summaries over streams.

Each run works in a new folder below the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from axonframe.operators import page, records, scoring, tokens
from axonframe.operators.corpus import chain_splits, token_windows, with_corpus_order
from axonframe.operators.scale import top_rows
from axonframe.plans.fixtures import acts, sims, table
from axonframe.plans.record_queries import BOUNDS, K, N, SCORED
from axonframe.plans.registry import ACTS, COARSE, LEVELS, PAIRS, SIMS, TOPS, VALS, query, sql_draw, sql_heap
from axonframe.plans.score_queries import EDGES, RELATED, SCORE_SQL, connections
from axonframe.schemas import NEURON
from axonframe.session import cut_lineage, shared_dir
from axonframe.sources import neurons, texts
from axonframe.sources.neuron_files import write_neuron_files
from axonframe.streaming import running


#: Bytes of text in one file that one task has to read.
FILE_BYTES = 64 * 1024 * 1024


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/axonframe-{uuid.uuid4().hex}"


RECORD_ROWS = f"""{sql_heap("scored", K, keep="seq_id, score, tokens, activations")},
drawn AS (
  SELECT layer, neuron, tokens, activations, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS rank FROM scored),
buckets AS (
  SELECT layer, neuron, seq_id, tokens, activations, CAST((score >= q50)::INT + (score >= q90)::INT + (score >= q99)::INT + (score >= q999)::INT AS BIGINT) AS bucket
  FROM scored JOIN bounds USING (layer, neuron)),
by_bucket AS (
  SELECT *, bucket AS place,
         row_number() OVER (PARTITION BY layer, neuron, bucket ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS rank FROM buckets),
lists AS (
  SELECT layer, neuron, 'top' AS kind, CAST(NULL AS BIGINT) AS bucket, rank, tokens, activations FROM heap
  UNION ALL SELECT layer, neuron, 'random', NULL, rank, tokens, activations FROM drawn WHERE rank <= {N}
  UNION ALL SELECT layer, neuron, 'quantile', place, rank, tokens, activations FROM by_bucket WHERE rank <= 2)"""


def written_tree(spark, sf):
    """Write the record tree of all neurons and read it back."""
    from axonframe.plans.fixtures import coarse

    base = coarse(acts(spark, sf))
    index = cut_lineage(records.record_index(base))
    boundaries = cut_lineage(records.quantile_boundaries(index))
    kept = records.neuron_records(base, K, N, per_quantile=2, index=index, boundaries=boundaries)
    nested = neurons.to_neuron_records(kept, records.moments(base), boundaries)
    folder = new_folder(spark)
    neurons.write_neuron_records(nested, folder)
    return neurons.read_neuron_records(spark, f"{folder}/neurons")


@query(
    "neuron_json_records",
    f"""WITH {ACTS}, {COARSE}, {SCORED}, {BOUNDS}, {RECORD_ROWS}
    SELECT layer, neuron, kind, bucket, rank, array_to_string(tokens, ' ') AS tokens, round(list_sum(activations), 6) + 0.0 AS total FROM lists""",
)
def neuron_json_records(spark, sf):
    rows = neurons.record_rows(written_tree(spark, sf))
    total = F.aggregate("activations", F.lit(0.0), lambda a, b: a + b)
    return rows.select(*NEURON, "kind", "bucket", "rank", F.array_join("tokens", " ").alias("tokens"), (F.round(total, 6) + 0.0).alias("total"))


@query(
    "neuron_json_stats",
    f"""WITH {ACTS}, {COARSE}, {SCORED}, {BOUNDS}, v AS (SELECT layer, neuron, unnest(activations) AS a FROM coarse),
    m AS (SELECT layer, neuron, round(avg(a), 6) + 0.0 AS mean, round(var_samp(a), 6) AS variance FROM v GROUP BY ALL)
    SELECT layer, neuron, layer AS layer_index, neuron AS neuron_index, mean, variance, q50, q999 FROM m JOIN bounds USING (layer, neuron)""",
)
def neuron_json_stats(spark, sf):
    return written_tree(spark, sf).select(
        *NEURON, "neuron_id.layer_index", "neuron_id.neuron_index", (F.round("mean", 6) + 0.0).alias("mean"), F.round("variance", 6).alias("variance"),
        F.get("quantile_boundaries", F.lit(0)).alias("q50"), F.get("quantile_boundaries", F.lit(3)).alias("q999"),
    )


@query(
    "shown_records",
    f"""WITH {ACTS}, {COARSE}, {SCORED}, {BOUNDS}, {RECORD_ROWS}
    SELECT layer, neuron, kind, bucket, rank FROM lists WHERE rank <= CASE kind WHEN 'top' THEN 4 WHEN 'random' THEN 2 ELSE 1 END""",
)
def shown_records(spark, sf):
    return page.shown_records(neurons.record_rows(written_tree(spark, sf))).select(*NEURON, "kind", "bucket", "rank")


@query(
    "explanation_json",
    f"""WITH {ACTS}, {TOPS}, {LEVELS}, {SIMS}, {PAIRS}
    SELECT layer, neuron, explanation_id, 'explanation ' || explanation_id AS explanation, {SCORE_SQL} FROM pairs GROUP BY layer, neuron, explanation_id""",
)
def explanation_json(spark, sf):
    """Score all explanations, write one JSON line per neuron, read the lines back."""
    base = acts(spark, sf)
    pairs = scoring.pair_sequences(base, sims(base))
    names = pairs.select(*scoring.EXPLANATION).distinct().withColumn(
        "explanation", F.concat(F.lit("explanation "), F.col("explanation_id").cast("string"))
    )
    scored = scoring.scored_simulations(pairs, names)
    defined = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in scoring.SCORES]
    simulation = F.struct("scored_sequence_simulations", *defined).alias("scored_simulation")
    item = F.struct("explanation_id", "explanation", simulation)
    lines = scored.groupBy(*NEURON).agg(F.array_sort(F.collect_list(item), _by_id).alias("scored_explanations"))
    key = F.struct(F.col("layer").alias("layer_index"), F.col("neuron").alias("neuron_index")).alias("neuron_id")
    folder = new_folder(spark)
    lines.select(*NEURON, F.to_json(F.struct(key, "scored_explanations")).alias("value")).write.partitionBy(*NEURON).text(folder)
    found = neurons.explanation_rows(neurons.read_explanations(spark, folder, strict=True))
    return found.select(
        *NEURON, "explanation_id", "explanation", *[F.round(c, 6).alias(c) for c in scoring.SCORES]
    )


def _by_id(a, b):
    return F.when(a["explanation_id"] < b["explanation_id"], -1).when(a["explanation_id"] > b["explanation_id"], 1).otherwise(0)


@query(
    "scored_heads",
    f"""WITH {ACTS}, {TOPS}, {LEVELS}, {SIMS}
    SELECT layer, neuron, explanation_id, least(count(*), 5) AS n_top, greatest(count(*) - 5, 0) AS n_random FROM sims GROUP BY ALL""",
)
def scored_heads(spark, sf):
    base = acts(spark, sf)
    pairs = scoring.pair_sequences(base, sims(base))
    names = pairs.select(*scoring.EXPLANATION, F.lit("e").alias("explanation")).distinct()
    heads = scoring.scored_simulations(pairs, names).withColumn("h", page.scored_heads(F.col("scored_sequence_simulations")))
    return heads.select(*scoring.EXPLANATION, F.size("h.top").alias("n_top"), F.size("h.random").alias("n_random"))


@query(
    "token_average_json",
    f"""WITH {ACTS}, {VALS}, means AS (SELECT layer, neuron, token, avg(a) AS avg_activation FROM vals GROUP BY ALL),
    listed AS (SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY avg_activation DESC, token) AS rank FROM means)
    SELECT layer, neuron, rank, token, round(avg_activation, 6) AS avg_activation FROM listed WHERE rank <= 6""",
)
def token_average_json(spark, sf):
    lists = tokens.token_lists(tokens.token_averages(acts(spark, sf), 6))
    folder = new_folder(spark)
    tagged = F.struct("tokens", "average_activations", F.lit("TokenLookupTableSummaryOfNeuron").alias("dataclass_name"))
    lists.select(*NEURON, F.to_json(tagged).alias("value")).write.partitionBy(*NEURON).text(folder)
    return neurons.read_token_averages(spark, folder).withColumn("avg_activation", F.round("avg_activation", 6))


@query(
    "token_weight_json",
    f"""WITH {ACTS}, {VALS}, means AS (SELECT layer, neuron, token, avg(a) AS strength FROM vals GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY strength DESC, token) AS up,
      row_number() OVER (PARTITION BY layer, neuron ORDER BY strength, token) AS down FROM means),
    sides AS (SELECT layer, neuron, 'positive' AS sign, up AS rank, token, strength FROM ranked WHERE up <= 4
      UNION ALL SELECT layer, neuron, 'negative', down, token, strength FROM ranked WHERE down <= 4)
    SELECT layer, neuron, direction, sign, rank, token, round(strength, 6) AS strength FROM sides, (VALUES ('input'), ('output')) d(direction)""",
)
def token_weight_json(spark, sf):
    """Token lists by sign, written in the weight summary format and read back."""
    means = tokens.token_means(acts(spark, sf))

    def side(sign):
        order = F.col("avg_activation").desc() if sign > 0 else F.col("avg_activation").asc()
        best = top_rows(means, NEURON, [order, F.col("token")], 4)
        items = F.array_sort(F.collect_list(F.struct("rank", "token", "avg_activation")))
        name = "up" if sign > 0 else "down"
        return best.groupBy(*NEURON).agg(items.alias("i")).select(
            *NEURON, F.struct(F.col("i.token").alias("tokens"), F.col("i.avg_activation").alias("strengths")).alias(name))

    lists = side(1).join(side(-1), NEURON)
    whole = F.struct(
        F.col("up").alias("input_positive"), F.col("down").alias("input_negative"), F.col("up").alias("output_positive"),
        F.col("down").alias("output_negative"), F.lit("WeightBasedSummaryOfNeuron").alias("dataclass_name"),
    )
    folder = new_folder(spark)
    lists.select(*NEURON, F.to_json(whole).alias("value")).write.partitionBy(*NEURON).text(folder)
    return neurons.read_token_weights(spark, folder).withColumn("strength", F.round("strength", 6))


@query(
    "related_json",
    f"WITH {EDGES}, {RELATED} SELECT direction, layer, neuron, rank, to_layer, to_neuron, round(weight, 6) AS weight FROM related",
)
def related_json(spark, sf):
    """Connection lists written as one JSON object per neuron and read back."""
    found = connections(spark, sf)
    item = F.struct("rank", F.concat_ws("_", "to_layer", "to_neuron").alias("name"), "weight")
    pick = lambda d, s: F.array_sort(F.collect_list(F.when((F.col("direction") == d) & (F.col("sign") == s), item)))
    sides = found.groupBy(*NEURON).agg(
        *[pick(d, s).alias(f"{d}_{s}") for d in ("input", "output") for s in ("positive", "negative")]
    )

    def matrix(d):
        lists = F.struct(*[
            F.col(f"{d}_{s}.{field}").alias(f"top_{s}_{plural}")
            for s in ("positive", "negative") for field, plural in (("name", "neurons"), ("weight", "weights"))
        ])
        return F.when(F.size(f"{d}_positive") > 0, lists)

    folder = new_folder(spark)
    # Tasks place their own files: no folder per neuron, and no file that the driver moves.
    write_neuron_files(sides.select(*NEURON, matrix("output").alias("c_proj"), matrix("input").alias("c_fc")), folder)
    related = page.listed_related(neurons.read_related(spark, folder))
    return related.select("direction", *NEURON, "rank", "to_layer", "to_neuron", F.round("weight", 6).alias("weight"))


@query(
    "labelled_tsv",
    """WITH shown AS (SELECT doc_id, lang, trim(text, ' ' || chr(10) || chr(9)) AS premise FROM documents)
    SELECT CASE WHEN lang = (SELECT min(lang) FROM documents) THEN 0::BIGINT ELSE 1 END AS split_no, md5(premise) AS digest, count(*) AS n
    FROM shown WHERE premise <> '' GROUP BY ALL""",
)
def labelled_tsv(spark, sf):
    """Texts written as two labelled TSV splits and read back in list order."""
    folder = new_folder(spark)
    docs = table(spark, sf, "documents")
    first = docs.agg(F.min("lang")).first()[0]
    rows = docs.select(
        "lang", F.col("doc_id").cast("string").alias("Argument ID"), F.lit("c").alias("Conclusion"), F.lit("in favor of").alias("Stance"),
        F.concat(F.lit("  "), F.col("text")).alias("Premise"),
    )
    for name, part in (("a.tsv", rows.where(F.col("lang") == first)), ("b.tsv", rows.where(F.col("lang") != first))):
        part.drop("lang").write.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').option(
            "ignoreLeadingWhiteSpace", "false"
        ).csv(f"{folder}/{name}")
    found = texts.read_labelled_texts(spark, folder, ["a.tsv", "b.tsv"])
    return found.groupBy("split_no", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(
    "labelled_windows",
    r"""WITH shown AS (SELECT doc_id % 2 AS split_no, doc_id, list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda t: t <> '') AS tokens FROM documents),
    flat AS (SELECT split_no, doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM shown),
    stream AS (SELECT token, row_number() OVER (ORDER BY split_no, doc_id, i) - 1 AS p FROM flat)
    SELECT p // 64 AS seq_id, string_agg(token, ' ' ORDER BY p) AS tokens FROM stream GROUP BY ALL HAVING count(*) = 64""",
)
def labelled_windows(spark, sf):
    """Texts with line breaks in two labelled splits, read in list order and cut into windows."""
    folder = new_folder(spark)
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("Argument ID"), F.lit("c").alias("Conclusion"), F.lit("in favor of").alias("Stance"),
        F.col("text").alias("Premise"),
    )
    for part, name in enumerate(("a.tsv", "b.tsv")):
        own = rows.where(F.col("doc_id") % 2 == part)
        # A file with quoted line breaks is read by one task, so there are more files for more text.
        size = own.agg(F.sum(F.octet_length("Premise"))).first()[0] or 0
        side = own.repartitionByRange(max(3, -(-size // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id").drop("doc_id")
        side.write.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').option("quoteAll", "true").csv(f"{folder}/{name}")
    found = with_corpus_order(texts.read_labelled_texts(spark, folder, ["a.tsv", "b.tsv"]))
    return token_windows(found, 64, order="corpus_no").select("seq_id", F.array_join("tokens", " ").alias("tokens"))


@query("label_tsv", "SELECT CAST(doc_id AS VARCHAR) AS argument_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def label_tsv(spark, sf):
    folder = new_folder(spark)
    table(spark, sf, "labels").withColumnRenamed("doc_id", "Argument ID").write.option("sep", "\t").option("header", "true").csv(folder)
    return texts.read_labels(spark, folder)


@query(
    "metadata_tsv",
    "SELECT CAST(event_id AS VARCHAR) AS argument_id, event_type AS url, date_trunc('second', ts) AS stamp FROM events",
)
def metadata_tsv(spark, sf):
    folder = new_folder(spark)
    stamped = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("Argument ID"), F.col("event_type").alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("stamp")
    )
    stamped.write.option("sep", "\t").option("header", "true").csv(folder)
    return texts.read_metadata(spark, folder, stamp="stamp").withColumn("stamp", F.col("stamp").cast("timestamp_ntz"))


def _corpus(fmt):
    sql = "SELECT doc_id, md5(text) AS digest FROM documents WHERE trim(text) <> ''"

    @query(f"text_scan_{fmt}", sql)
    def run(spark, sf):
        folder = new_folder(spark)
        table(spark, sf, "documents").select("doc_id", "text").write.format(fmt).save(folder)
        return texts.read_texts(spark, folder, fmt).select("doc_id", F.md5("text").alias("digest"))

    return run


for _fmt in ("parquet", "json"):
    _corpus(_fmt)


@query(
    "text_scan_text",
    "SELECT md5(line) AS digest, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL",
)
def text_scan_text(spark, sf):
    """Plain text files: every line is a text."""
    folder = new_folder(spark)
    table(spark, sf, "documents").select("text").write.text(folder)
    return texts.read_texts(spark, folder, "text").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("text_stream", "SELECT doc_id, md5(text) AS digest FROM documents WHERE trim(text) <> ''")
def text_stream(spark, sf):
    """New files of texts as a stream, written on as they come."""
    folder = new_folder(spark)
    table(spark, sf, "documents").select("doc_id", "text").write.json(f"{folder}/in")
    stream = texts.stream_texts(spark, f"{folder}/in", "json", "doc_id BIGINT, text STRING")
    digests = stream.select("doc_id", F.md5("text").alias("digest"))
    digests.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out", "parquet").awaitTermination()
    return spark.read.schema("doc_id BIGINT, digest STRING").parquet(f"{folder}/out")


@query("json_objects", "SELECT 'n' || n_nationkey AS name, n_name AS text, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def json_objects(spark, sf):
    """One object of any shape per file."""
    folder = new_folder(spark)
    rows = table(spark, sf, "nation").withColumn("key", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    value = F.to_json(F.struct(F.struct(F.col("key").alias("name")).alias("id"), F.array("n_name").alias("texts"), F.col("n_regionkey").alias("region")))
    rows.select("key", value.alias("value")).write.partitionBy("key").text(folder)
    data = F.col("data")
    return texts.read_objects(spark, folder).select(
        F.variant_get(data, "$.id.name", "string").alias("name"), F.variant_get(data, "$.texts[0]", "string").alias("text"),
        F.variant_get(data, "$.region", "bigint").alias("region"),
    )


@query(
    "neuron_exists",
    f"WITH {EDGES} SELECT layer, neuron, neuron % 3 <> 0 AS present FROM n",
)
def neuron_exists(spark, sf):
    """Which of all neurons have a record, asked for at once."""
    wanted = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("layer"), F.col("vec_id").alias("neuron"))
    return neurons.with_presence(wanted, wanted.where(F.col("neuron") % 3 != 0))


@query(
    "taxonomy_json",
    """SELECT r_name AS level2, n_name AS level1, n_name AS phrase FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def taxonomy_json(spark, sf):
    """Regions, groups of nations and nations as one nested JSON object."""
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = joined.groupBy("r_name", F.col("n_name").alias("g")).agg(F.collect_list("n_name").alias("p"))
    per_region = inner.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("g", "p"))).alias("m"))
    return texts.taxonomy_rows(per_region.select(F.to_json(F.create_map("r_name", "m")).alias("value")))


@query(
    "puzzle_json",
    f"""WITH {ACTS} SELECT 'n' || layer || '_' || neuron || '_' || seq_id AS name, 'find ' || neuron AS explanation, CAST(0 AS BIGINT) AS sentence_no,
    array_to_string(tokens, ' ') AS tokens, round(list_sum(list_transform(activations, lambda x: greatest(0.0, x))), 6) AS total FROM acts""",
)
def puzzle_json(spark, sf):
    """Each sequence as a puzzle: positive activations as pairs, the others as plain tokens."""
    item = lambda z: F.when(
        z["activations"] > 0, F.concat(F.lit('["'), z["tokens"], F.lit('", '), z["activations"].cast("string"), F.lit("]"))
    ).otherwise(F.concat(F.lit('"'), z["tokens"], F.lit('"')))
    base = acts(spark, sf)
    name = F.concat(F.lit("n"), F.concat_ws("_", "layer", "neuron", "seq_id"))
    sentence = F.array_join(F.transform(F.arrays_zip("tokens", "activations"), item), ", ")
    body = F.concat(
        F.lit('{"'), name, F.lit('": {"name": "'), name, F.lit('", "explanation": "find '), F.col("neuron").cast("string"),
        F.lit('", "false_explanations": ["no"], "sentences": [['), sentence, F.lit("]]}}"),
    )
    total = F.aggregate("activations", F.lit(0.0), lambda a, b: a + b)
    return texts.puzzle_rows(base.select(body.alias("value"))).select(
        "name", "explanation", "sentence_no", F.array_join("tokens", " ").alias("tokens"), F.round(total, 6).alias("total")
    )


def tagged_rows(spark, sf):
    """JSON objects with a tag, with all fields of a type, and with only some of them."""
    kind = F.col("seq_id") % 4
    tagged = F.to_json(F.struct("tokens", "activations", F.lit("ActivationRecord").alias("dataclass_name")))
    untagged = F.to_json(F.struct("tokens", "activations"))
    ids = F.to_json(F.struct(F.col("layer").alias("layer_index"), F.col("neuron").alias("neuron_index")))
    some = F.to_json(F.struct(F.col("activations").alias("average_activations")))
    value = F.when(kind == 0, tagged).when(kind == 1, untagged).when(kind == 2, ids).otherwise(some)
    return acts(spark, sf).select(*NEURON, "seq_id", value.alias("value"))


@query(
    "tagged_json",
    f"""WITH {ACTS} SELECT layer, neuron, seq_id, CASE seq_id % 4 WHEN 0 THEN 'ActivationRecord' WHEN 1 THEN 'ActivationRecord'
      WHEN 2 THEN 'NeuronId' ELSE 'TokenLookupTableSummaryOfNeuron' END AS kind, seq_id % 4 = 3 AS partial FROM acts""",
)
def tagged_json(spark, sf):
    """Objects with a tag, with all fields of a type, and with only some of them."""
    # Record types and their fields.
    fields = {
        "ActivationRecord": ["tokens", "activations"],
        "NeuronId": ["layer_index", "neuron_index"],
        "TokenLookupTableSummaryOfNeuron": ["tokens", "average_activations"],
    }
    rows = tagged_rows(spark, sf)
    return rows.select(
        *NEURON, "seq_id", texts.resolve_tag(F.col("value"), fields).alias("kind"), (F.size(texts.tagged_fields(F.col("value"))) == 1).alias("partial")
    )


@query(
    "typed_json",
    f"""WITH {ACTS} SELECT layer, neuron, seq_id, CASE seq_id % 4 WHEN 0 THEN 'ActivationRecord' WHEN 1 THEN 'ActivationRecord'
      WHEN 2 THEN 'NeuronId' ELSE 'TokenLookupTableSummaryOfNeuron' END AS kind,
      CASE WHEN seq_id % 4 < 2 THEN array_to_string(tokens, ' ') END AS tokens,
      CASE WHEN seq_id % 4 < 2 THEN round(list_sum(activations), 6) END AS total,
      CASE WHEN seq_id % 4 = 2 THEN layer END AS layer_index, CASE WHEN seq_id % 4 = 2 THEN neuron END AS neuron_index,
      CASE WHEN seq_id % 4 = 3 THEN 0::BIGINT END AS n_listed, CASE WHEN seq_id % 4 = 3 THEN round(list_max(activations), 6) END AS highest FROM acts""",
)
def typed_json(spark, sf):
    """The same objects read as records; tokens that a token table lacks are an empty list."""
    types = {
        "ActivationRecord": "tokens ARRAY<STRING>, activations ARRAY<DOUBLE>",
        "NeuronId": "layer_index INT, neuron_index INT",
        "TokenLookupTableSummaryOfNeuron": "tokens ARRAY<STRING>, average_activations ARRAY<DOUBLE>",
    }
    table_name = "TokenLookupTableSummaryOfNeuron"
    found = texts.typed_objects(tagged_rows(spark, sf), types, {table_name: {"tokens": F.array().cast("array<string>")}})
    total = F.aggregate("ActivationRecord.activations", F.lit(0.0), lambda a, b: a + b)
    listed = F.col(f"{table_name}.tokens")
    return found.select(
        *NEURON, "seq_id", "kind", F.array_join("ActivationRecord.tokens", " ").alias("tokens"), F.round(total, 6).alias("total"),
        "NeuronId.layer_index", "NeuronId.neuron_index", F.when(listed.isNotNull(), F.size(listed)).alias("n_listed"),
        F.round(F.array_max(f"{table_name}.average_activations"), 6).alias("highest"),
    )


@query(
    "chained_splits",
    "SELECT CASE WHEN doc_id % 2 = 0 THEN 0::BIGINT ELSE 1 END AS split_no, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ALL",
)
def chained_splits(spark, sf):
    docs = table(spark, sf, "documents")
    chained = chain_splits([docs.where(F.col("doc_id") % 2 == 0), docs.where(F.col("doc_id") % 2 == 1)])
    return chained.groupBy("split_no").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# Streams: the events, in four files that arrive one after the other.
EVENT_ACTS = """ev AS (SELECT CAST(0 AS BIGINT) AS layer, user_id AS neuron, event_id AS seq_id, value AS score FROM events)"""


def event_stream(spark, sf, folder):
    """Write the events as files in arrival order and open them as a stream, one file per batch."""
    source = f"{folder}/events"
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0]
    for part in range(4):
        inside = F.floor(F.col("event_id") * 4 / (last + 1)) == part
        events.where(inside).write.mode("append").parquet(source)
    schema = events.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def event_acts(stream):
    return stream.select(
        F.lit(0).alias("layer"), F.col("user_id").alias("neuron"), F.col("event_id").alias("seq_id"),
        F.array("event_type").alias("tokens"), F.array("value").alias("activations"),
    )


def finished_stream(spark, sf):
    folder = new_folder(spark)
    stream = event_acts(event_stream(spark, sf, folder))
    running.start_running_summary(stream, f"{folder}/out", f"{folder}/checkpoint", 5, 3).awaitTermination()
    return f"{folder}/out"


@query(
    "events_running_stats",
    f"""WITH {EVENT_ACTS} SELECT layer, neuron, count(*) AS n_values, round(avg(score), 8) AS mean, round(var_samp(score), 6) AS variance FROM ev GROUP BY ALL""",
)
def events_running_stats(spark, sf):
    stats = running.read_stats(spark, finished_stream(spark, sf))
    return stats.select(
        *NEURON, "n_values", F.round("mean", 8).alias("mean"), F.when(~F.isnan("variance"), F.round("variance", 6)).alias("variance")
    )


@query(
    "events_running_records",
    f"""WITH {EVENT_ACTS}, {sql_heap("ev", 5)}, drawn AS (
      SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS rank FROM ev)
    SELECT layer, neuron, 'top' AS kind, rank, seq_id, score FROM heap
    UNION ALL SELECT layer, neuron, 'random', rank, seq_id, score FROM drawn WHERE rank <= 3""",
)
def events_running_records(spark, sf):
    return running.read_records(spark, finished_stream(spark, sf), 5, 3).select(*NEURON, "kind", "rank", "seq_id", "score")


@query("events_per_minute", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL")
def events_per_minute(spark, sf):
    folder = new_folder(spark)
    stream = event_stream(spark, sf, folder)
    running.start_progress(stream, f"{folder}/progress", f"{folder}/checkpoint").awaitTermination()
    return running.read_progress(spark, f"{folder}/progress").withColumn("minute", F.col("minute").cast("timestamp_ntz"))
