"""Corpora: labelled TSV files, generic text tables, taxonomies, puzzles, tagged JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.functions.text import is_blank, strip
from axonframe.operators.scale import join_sized
from axonframe.session import cut_lineage

# The splits of the labelled argument corpus and its default text column.
ARGUMENT_SPLITS = (
    "arguments-training.tsv",
    "arguments-validation.tsv",
    "arguments-validation-zhihu.tsv",
    "arguments-test.tsv",
    "arguments-test-nahjalbalagha.tsv",
)
ARGUMENT_TEXT = "Premise"
ARCHIVE_STAMP = "yyyyMMddHHmmss"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated UTF-8 text with a header; all columns are strings.

    Quoted fields may hold line breaks.  A line break then does not show where a row ends, so a
    file is read by one task; large corpora should come in several files.
    """
    return (
        spark.read.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"')
        .option("multiLine", "true").option("encoding", "UTF-8").csv(path)
    )


def _require_file(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)


def read_labelled_texts(
    spark: SparkSession, folder: str, splits: Sequence[str] = ARGUMENT_SPLITS, column: str = ARGUMENT_TEXT
) -> DataFrame:
    """Stripped, non-blank texts of the listed files: split_no, row_no, text.

    Files keep their list order; ``row_no`` is the position in the split (its files by name), with
    gaps where texts are blank.  A missing
    file or column is an error before anything is read.
    """
    parts = None
    for number, split in enumerate(splits):
        path = f"{folder}/{split}"
        _require_file(spark, path)
        table = read_tsv(spark, path)
        if column not in table.columns:
            raise ValueError(f"expected column {column!r} in {path}, found {table.columns}")
        text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
        part = cut_lineage(
            table.select(
                F.lit(number).alias("split_no"),
                F.col("_metadata.file_path").alias("_file"),
                F.monotonically_increasing_id().alias("_id"),
                strip(text).alias("text"),
            )
        )
        # One row per file of the split.
        files = part.groupBy("_file").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
        before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        files = files.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
        part = (
            join_sized(part, files, ["_file"])
            .select("split_no", (F.col("_offset") + F.col("_id") - F.col("_first")).alias("row_no"), "text")
            .where(F.col("text") != "")
        )
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("at least one split is needed")
    return parts


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", column: str = "text") -> DataFrame:
    """Texts of a Parquet, JSON-lines or plain text corpus; blank ones are dropped, none stripped."""
    table = spark.read.format(fmt).load(path)
    name = "value" if fmt == "text" else column
    if name not in table.columns:
        raise ValueError(f"expected column {name!r} in {path}, found {table.columns}")
    if not isinstance(table.schema[name].dataType, T.StringType):
        raise ValueError(f"column {name!r} holds no text")
    return table.withColumnRenamed(name, "text").where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def stream_texts(spark: SparkSession, path: str, fmt: str, schema: str, column: str = "text") -> DataFrame:
    """The same as an unbounded stream of new files; row ranges are refused on it."""
    table = spark.readStream.format(fmt).schema(schema).load(path)
    return table.withColumnRenamed(column, "text").where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file, of any shape, as VARIANT; more than one line fails the job."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.filter(F.split("value", "\n"), lambda line: F.length(line) > 0)
    many = F.raise_error(F.concat(F.lit("expected one line in "), F.col("file"))).cast("string")
    return rows.select("file", F.parse_json(F.when(F.size(lines) == 1, F.get(lines, F.lit(0))).otherwise(many)).alias("data"))


def read_labels(spark: SparkSession, path: str, key: str = "Argument ID") -> DataFrame:
    """Zero/one label columns as integers, keyed by ``argument_id``."""
    table = read_tsv(spark, path)
    return table.select(
        F.col(f"`{key}`").alias("argument_id"),
        *[F.col(f"`{c}`").cast("int").alias(c) for c in table.columns if c != key],
    )


def read_metadata(spark: SparkSession, path: str, key: str = "Argument ID", stamp: str | None = None) -> DataFrame:
    """Metadata columns as strings; ``stamp`` names a column that holds an archive time."""
    table = read_tsv(spark, path).withColumnRenamed(key, "argument_id")
    return table if stamp is None else table.withColumn(stamp, archive_time(F.col(f"`{stamp}`")))


def archive_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(ARCHIVE_STAMP))


def taxonomy_rows(objects: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects {level2: {level1: [phrase, ...]}} as rows level2, level1, phrase."""
    parsed = F.from_json(column, T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StringType()))))
    return (
        objects.select(F.explode(parsed).alias("level2", "inner"))
        .select("level2", F.explode("inner").alias("level1", "phrases"))
        .select("level2", "level1", F.explode("phrases").alias("phrase"))
    )


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy_rows(spark.read.text(path, wholetext=True))


def puzzle_rows(objects: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects {name: {name, explanation, sentences, false_explanations}}, one row per sentence.

    A sentence item is a token with activation 0, or a pair of a token and its activation; a
    token that is no string fails the job.  Columns: name, explanation, false_explanations,
    sentence_no, tokens, activations.
    """
    puzzles = objects.select(F.explode(F.parse_json(column).cast("map<string, variant>")).alias("key", "puzzle"))
    field = lambda name, kind: F.variant_get("puzzle", f"$.{name}", kind).alias(name)
    sentences = puzzles.select(
        field("name", "string"),
        field("explanation", "string"),
        field("false_explanations", "array<string>"),
        F.posexplode(F.variant_get("puzzle", "$.sentences", "array<array<variant>>")).alias("sentence_no", "_items"),
    )

    def item(value: Column) -> Column:
        plain = F.schema_of_variant(value) == "STRING"
        name = F.when(plain, value).otherwise(F.variant_get(value, "$[0]", "variant"))
        token = F.when(F.schema_of_variant(name) == "STRING", name.cast("string")).otherwise(
            F.raise_error(F.lit("a token of a puzzle is no string")).cast("string")
        )
        activation = F.when(plain, F.lit(0.0)).otherwise(F.variant_get(value, "$[1]", "double"))
        return F.struct(token.alias("token"), activation.alias("activation"))

    return sentences.withColumn("_items", F.transform("_items", item)).select(
        "name", "explanation", "false_explanations", "sentence_no",
        F.col("_items.token").alias("tokens"), F.col("_items.activation").alias("activations"),
    )


def tagged_fields(text: Column) -> Column:
    """Field names of a JSON object without its tag."""
    return F.array_remove(F.json_object_keys(text), "dataclass_name")


def resolve_tag(text: Column, fields: Mapping[str, Sequence[str]], strict: bool = False) -> Column:
    """Name of the record type of a JSON object.

    The tag decides if it is known.  Without a tag, unless ``strict``, the type whose field
    set equals the object's, else the first type whose field set contains it.  NULL: no type.
    """
    tag = F.get_json_object(text, "$.dataclass_name")
    names = F.array(*[F.lit(n) for n in fields])
    known = F.when(tag.isin(*fields), tag)
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown record type: "), tag)).cast("string")
        return F.when(tag.isNotNull(), F.coalesce(known, unknown))
    present = tagged_fields(text)
    same = lambda n: (F.size(F.array_except(present, _names(fields[n]))) == 0) & (F.size(present) == len(fields[n]))
    inside = lambda n: (F.size(F.array_except(present, _names(fields[n]))) == 0) & (F.size(present) > 0)
    candidates = [F.when(same(n), F.lit(n)) for n in fields] + [F.when(inside(n), F.lit(n)) for n in fields]
    return F.when(tag.isNotNull(), known).otherwise(F.coalesce(*candidates))


def _names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def check_fields(text: Column, allowed: Sequence[str], required: Sequence[str]) -> Column:
    """The text itself; an unknown or a missing field fails the job."""
    present = tagged_fields(text)
    extra = F.array_except(present, _names(allowed))
    missing = F.array_except(_names(required), present)
    problem = lambda kind, names: F.raise_error(F.concat(F.lit(f"{kind} fields: "), F.array_join(names, ", "))).cast("string")
    return (
        F.when(F.size(extra) > 0, problem("unknown", extra))
        .when(F.size(missing) > 0, problem("missing", missing))
        .otherwise(text)
    )


def typed_objects(
    objects: DataFrame, types: Mapping[str, str], defaults: Mapping[str, Mapping[str, Column]] | None = None,
    column: str = "value", strict: bool = False,
) -> DataFrame:
    """JSON objects as records of their types.

    ``types`` gives the fields of each type as DDL.  The type is found as in ``resolve_tag``.  Every
    type has a struct column, which is NULL in rows of other types; ``kind`` names the type; objects
    of no type stay as VARIANT in ``other``.  Fields that an object lacks take their default, which
    ``defaults`` holds by type and field.  A field that the type does not have, one that is missing
    without default, and a value that does not fit its field fail.
    """
    defaults = defaults or {}
    shapes = {name: T.StructType.fromDDL(ddl) for name, ddl in types.items()}
    names = {name: shape.fieldNames() for name, shape in shapes.items()}
    keep = [F.col(f"`{c}`") for c in objects.columns if c != column]
    kinds = objects.withColumn("kind", resolve_tag(F.col(column), names, strict))

    def checked(name: str) -> Column:
        needed = [f for f in names[name] if f not in defaults.get(name, {})]
        return F.parse_json(check_fields(F.col(column), names[name], needed))

    parsed = F.lit(None).cast("variant")
    for name in types:
        parsed = F.when(F.col("kind") == name, checked(name)).otherwise(parsed)
    parsed = F.when(F.col("kind").isNull(), F.parse_json(column)).otherwise(parsed)
    rows = kinds.withColumns({"_object": parsed, "_present": tagged_fields(F.col(column))})

    def record(name: str) -> Column:
        def value(field: T.StructField) -> Column:
            found = F.variant_get("_object", f"$['{field.name}']", field.dataType.simpleString())
            default = defaults.get(name, {}).get(field.name)
            if default is None:
                return found
            return F.when(F.array_contains("_present", field.name), found).otherwise(default.cast(field.dataType))

        return F.when(F.col("kind") == name, F.struct(*[value(f).alias(f.name) for f in shapes[name]])).alias(name)

    other = F.when(F.col("kind").isNull(), F.col("_object")).alias("other")
    return rows.select(*keep, "kind", *[record(name) for name in types], other)
