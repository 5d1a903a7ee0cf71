"""Readers and writers for one-JSON-file-per-neuron trees.

Readers accept ``<layer>/<neuron>.json`` with or without a ``neurons/`` level, and the
``layer=<l>/neuron=<n>/`` layout the writer produces.  Whole trees are read as one table; a
filter on layer or neuron is turned into a path pattern, so other files are not opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.schemas import (
    EXPLANATIONS,
    NEURON,
    NEURON_RECORD,
    RELATED_NEURONS,
    TOKEN_AVERAGES,
    TOKEN_WEIGHTS,
)

# <layer>/<neuron>.json, or layer=<layer>/neuron=<neuron>/<any file>
_PLAIN = r"/([0-9]+)/([0-9]+)\.jsonl?$"
_KEYED = r"/layer=([0-9]+)/neuron=([0-9]+)/[^/]*$"


def _lines(spark: SparkSession, path: str, pattern: str | None, whole: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    file = F.col("_metadata.file_path")
    part = lambda group: F.concat(F.regexp_extract(file, _PLAIN, group), F.regexp_extract(file, _KEYED, group))
    rows = reader.text(path, wholetext=whole).select(part(1).alias("_l"), part(2).alias("_n"), file.alias("file"), "value")
    return rows.where((F.col("_l") != "") & (F.col("_n") != ""))


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("_l").cast("int").alias("layer"), F.col("_n").cast("int").alias("neuron"), "file", "value")


def read_json(spark: SparkSession, path: str, schema: str, pattern: str | None = None, whole: bool = True) -> DataFrame:
    """layer, neuron and one parsed object ``data`` per file; text that is no object fails."""
    parsed = F.from_json("value", schema)
    message = F.concat(F.lit("cannot read "), F.col("file"))
    keys = F.json_object_keys("value")
    return _keyed(_lines(spark, path, pattern, whole)).select(
        *NEURON, F.when(keys.isNull(), F.raise_error(message)).otherwise(parsed).alias("data"), "value", "file"
    )


def read_neuron_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per neuron; an object without a neuron id and record lists is rejected."""
    rows = read_json(spark, path, NEURON_RECORD)
    valid = F.col("data.neuron_id").isNotNull() & F.coalesce(
        F.col("data.dataclass_name") == "NeuronRecord", F.lit(True)
    )
    wrong = F.raise_error(F.concat(F.lit("not a neuron record: "), F.col("file")))
    return rows.select(*NEURON, F.when(valid, F.col("data")).otherwise(wrong).alias("data")).select(*NEURON, "data.*")


def record_rows(neurons: DataFrame) -> DataFrame:
    """Retained records as rows: kind, bucket, rank, tokens, activations."""
    plain = lambda column, kind: neurons.select(
        *NEURON, F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("bucket"), F.posexplode(column).alias("_p", "r")
    )
    buckets = neurons.select(
        *NEURON, F.lit("quantile").alias("kind"), F.posexplode("random_sample_by_quantile").alias("bucket", "_b")
    ).select(*NEURON, "kind", "bucket", F.posexplode("_b").alias("_p", "r"))
    rows = plain("most_positive_activation_records", "top").unionByName(plain("random_sample", "random")).unionByName(buckets)
    return rows.select(
        *NEURON, "kind", "bucket", (F.col("_p") + 1).alias("rank"), "r.tokens", "r.activations"
    )


def neuron_exists(neurons: DataFrame, layer: int, neuron: int) -> bool:
    return not neurons.where((F.col("layer") == layer) & (F.col("neuron") == neuron)).isEmpty()


def with_presence(wanted: DataFrame, neurons: DataFrame) -> DataFrame:
    """Add ``present``: whether a wanted neuron has a record.  One job for any number of neurons."""
    there = neurons.select(*NEURON, F.lit(True).alias("present")).distinct()
    return wanted.join(there, NEURON, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def read_explanations(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One row per neuron from the first line of its file.

    ``strict`` demands exactly one non-empty line per file.  Join with the wanted neurons from
    the left to get NULL for missing files.
    """
    lines = _keyed(_lines(spark, path, None, True)).select(
        *NEURON, "file", F.filter(F.split("value", "\n"), lambda line: F.length(line) > 0).alias("_lines")
    )
    if strict:
        many = F.raise_error(F.concat(F.lit("expected one line in "), F.col("file")))
        lines = lines.withColumn("_lines", F.when(F.size("_lines") == 1, F.col("_lines")).otherwise(many))
    return lines.select(*NEURON, F.from_json(F.get("_lines", F.lit(0)), EXPLANATIONS).alias("data")).select(
        *NEURON, "data.neuron_id", "data.scored_explanations"
    )


def explanation_rows(results: DataFrame) -> DataFrame:
    """One row per explanation with its pooled scores."""
    return results.select(*NEURON, F.posexplode("scored_explanations").alias("explanation_id", "e")).select(
        *NEURON,
        "explanation_id",
        "e.explanation",
        "e.scored_simulation.ev_correlation_score",
        "e.scored_simulation.rsquared_score",
        "e.scored_simulation.absolute_dev_explained_score",
    )


def _named(row: Column, names: Sequence[str], tag: str, file: str = "file") -> Column:
    """Strict reading: the tag must match and all fields must be there."""
    complete = F.coalesce(row["dataclass_name"] == tag, F.lit(False))
    for name in names:
        complete = complete & row[name].isNotNull()
    return F.when(complete, row).otherwise(F.raise_error(F.concat(F.lit(f"not a {tag}: "), F.col(file))))


def read_token_weights(spark: SparkSession, path: str) -> DataFrame:
    """Long table: direction, sign, rank, token, strength."""
    sides = [(d, s) for d in ("input", "output") for s in ("positive", "negative")]
    rows = read_json(spark, path, TOKEN_WEIGHTS)
    checked = rows.select(*NEURON, _named(F.col("data"), [f"{d}_{s}" for d, s in sides], "WeightBasedSummaryOfNeuron").alias("d"))
    lists = F.array(*[
        F.struct(F.lit(d).alias("direction"), F.lit(s).alias("sign"),
                 F.col(f"d.{d}_{s}.tokens").alias("tokens"), F.col(f"d.{d}_{s}.strengths").alias("strengths"))
        for d, s in sides
    ])
    return (
        checked.select(*NEURON, F.inline(lists))
        .select(*NEURON, "direction", "sign", F.posexplode(F.arrays_zip("tokens", "strengths")).alias("_p", "z"))
        .select(*NEURON, "direction", "sign", (F.col("_p") + 1).alias("rank"), F.col("z.tokens").alias("token"), F.col("z.strengths").alias("strength"))
    )


def read_token_averages(spark: SparkSession, path: str) -> DataFrame:
    """Long table: rank, token, avg_activation."""
    rows = read_json(spark, path, TOKEN_AVERAGES)
    checked = rows.select(
        *NEURON, _named(F.col("data"), ["tokens", "average_activations"], "TokenLookupTableSummaryOfNeuron").alias("d")
    )
    zipped = F.arrays_zip(F.col("d.tokens").alias("token"), F.col("d.average_activations").alias("avg_activation"))
    return checked.select(*NEURON, F.posexplode(zipped).alias("_p", "z")).select(
        *NEURON, (F.col("_p") + 1).alias("rank"), "z.token", "z.avg_activation"
    )


def related_rows(objects: DataFrame) -> DataFrame:
    """Connection lists as rows: direction, sign, rank, to_layer, to_neuron, weight.

    ``objects`` has layer, neuron, data; a direction may be NULL and gives no rows.
    """
    from axonframe.operators.page import parse_neuron_name

    # The weight matrix behind each direction.
    matrices = {"input": "c_fc", "output": "c_proj"}
    lists = F.array(*[
        F.struct(
            F.lit(d).alias("direction"), F.lit(s).alias("sign"),
            F.col(f"data.{m}.top_{s}_neurons").alias("names"), F.col(f"data.{m}.top_{s}_weights").alias("weights"),
        )
        for d, m in matrices.items() for s in ("positive", "negative")
    ])
    return (
        objects.select(*NEURON, F.inline(lists))
        .select(*NEURON, "direction", "sign", F.posexplode(F.arrays_zip("names", "weights")).alias("_p", "z"))
        .select(*NEURON, "direction", "sign", (F.col("_p") + 1).alias("rank"),
                parse_neuron_name(F.col("z.names")).alias("to"), F.col("z.weights").alias("weight"))
        .select(*NEURON, "direction", "sign", "rank", "to.to_layer", "to.to_neuron", "weight")
    )


def read_related(spark: SparkSession, path: str) -> DataFrame:
    return related_rows(read_json(spark, path, RELATED_NEURONS))


def to_neuron_records(records: DataFrame, stats: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Nest retained records and moments into one row per neuron, ready for export.

    A neuron's retained lists are bounded by their sizes, so a row stays small.  Quantile
    lists lie at their bucket's position; empty buckets give empty lists.
    """
    item = F.struct("rank", "tokens", "activations")
    lists = records.groupBy(*NEURON, "kind", "bucket").agg(
        F.transform(
            F.array_sort(F.collect_list(item)),
            lambda r: F.struct(r["tokens"].alias("tokens"), r["activations"].alias("activations")),
        ).alias("items")
    )
    only = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("items")), ignorenulls=True)
    # A list for every bucket up to the last one there may be; readers go by the position.
    none = F.array().cast("array<struct<tokens:array<string>,activations:array<double>>>")
    found = F.map_from_entries(F.collect_list(F.when(F.col("kind") == "quantile", F.struct("bucket", "items"))))
    by_bucket = F.struct(found.alias("lists"), F.max(F.when(F.col("kind") == "quantile", F.col("bucket"))).alias("last"))
    wide = lists.groupBy(*NEURON).agg(only("top").alias("_top"), only("random").alias("_random"), by_bucket.alias("_buckets"))
    joined = stats.join(wide, NEURON, "left")
    if boundaries is not None:
        joined = joined.join(boundaries, NEURON, "left")
    else:
        joined = joined.withColumn("quantile_boundaries", F.lit(None).cast("array<double>"))
    empty = F.array().cast("array<struct<tokens:array<string>,activations:array<double>>>")
    defined = lambda c: F.when(~F.isnan(c), F.col(c)) if c in joined.columns else F.lit(None).cast("double")
    return joined.select(
        *NEURON,
        F.struct(F.col("layer").alias("layer_index"), F.col("neuron").alias("neuron_index")).alias("neuron_id"),
        F.coalesce("_random", empty).alias("random_sample"),
        F.when(F.col("_buckets.last").isNotNull(), F.transform(
            F.sequence(F.lit(0), F.coalesce(F.size("quantile_boundaries"), F.col("_buckets.last"))),
            lambda b: F.coalesce(F.try_element_at("_buckets.lists", b), none),
        )).alias("random_sample_by_quantile"),
        "quantile_boundaries",
        *[defined(c).alias(c) for c in ("mean", "variance", "skewness", "kurtosis")],
        F.coalesce("_top", empty).alias("most_positive_activation_records"),
        F.lit("NeuronRecord").alias("dataclass_name"),
    )


def write_neuron_records(neurons: DataFrame, path: str, one_file_each: bool = True) -> None:
    """Write one JSON object per neuron below ``<path>/neurons``.

    The default gives one folder and file per neuron, ``layer=<l>/neuron=<n>/``.  For many
    neurons use ``one_file_each=False``: JSON lines per layer, as many files as there are
    tasks.  Undefined moments are NULL in the rows and are written as JSON null.
    """
    fields = [c for c in neurons.columns if c not in NEURON]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    folders = NEURON if one_file_each else ["layer"]
    rows = neurons.select(*folders, text.alias("value"))
    rows.write.partitionBy(*folders).mode("overwrite").text(f"{path}/neurons")


def read_neuron_lines(spark: SparkSession, path: str) -> DataFrame:
    """Neuron records from JSON lines; the key comes from the record itself."""
    wrong = F.raise_error(F.concat(F.lit("not a neuron record: "), F.col("_metadata.file_path")))
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    data = F.from_json("value", NEURON_RECORD)
    valid = F.when(data["neuron_id"].isNotNull(), data).otherwise(wrong).alias("data")
    return lines.select(valid).select(
        F.col("data.neuron_id.layer_index").alias("layer"), F.col("data.neuron_id.neuron_index").alias("neuron"), "data.*"
    )
