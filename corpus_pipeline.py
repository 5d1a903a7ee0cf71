"""The corpus pipeline: toxicity, near copies, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm.ngram_join import ngram_join
from axonframe.llm.packing import pack
from axonframe.llm.pii import masked, pii_spans
from axonframe.llm.queries import REJECTED, vocabulary
from axonframe.llm.substring_dedup import substring_dedup
from axonframe.llm.tables import Scratch
from axonframe.llm.toxicity import accepted, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not more likely toxic than not.

    Every row is judged by itself, so repeated rows and ids share their fate.  Null and empty texts
    have no toxic words and stay, as does everything where the labels teach nothing.
    """
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return accepted(docs, model, REJECTED)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that with the smallest id (a missing id comes last).

    Rows are told apart by id and text together, so rows that repeat an id with another text are
    documents of their own; of equal rows one stays.  Rows without words are copies of nothing and
    all stay.  An empty table stays empty.
    """
    scratch = Scratch(spark, "near-copies")
    key = "key of row"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = ngram_join(keyed.select(key, "text"), id_col=key).where("n_shingles > 0")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component"), F.max("component_id").alias("other"))
    # Two rows of one key but different components would be a collision of hashes: they all stay.
    rows = rows.where("component = other").select(F.col("doc_id").alias(key), "n", "component")
    ids = keyed.select(key, F.col("doc_id").alias("id")).join(rows, key).groupBy(key).agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.min("id").alias("id")
    )
    ids = scratch.write(ids, "rows")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col(key))
    first = ids.groupBy("component").agg(F.min(order).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    fate = scratch.write(
        ids.join(first, "component").select(key, (F.col(f"first.`{key}`") == F.col(key)).alias("stays"), "n").where("not stays or n > 1"), "fate"
    )
    kept = keyed.join(fate.select(key).hint("shuffle_hash"), key, "left_anti")
    equal = fate.where("stays")
    if not equal.isEmpty():
        kept = kept.unionByName(keyed.join(equal.select(key), key, "left_semi").dropDuplicates([key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 20 words that start earlier in the corpus; other texts unchanged.

    All rows stay, null, empty and short texts as they are.  Rows that repeat an id keep what only
    they share; rows without id come after all others and count as one document.
    """
    found = substring_dedup(docs)
    changed = F.col("n_removed") > 0
    new = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("rest.n_chars")),
    }
    return found.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind.

    All rows stay, each masked by itself; null and empty texts stay as they are.
    """
    spans = docs.withColumn("pii spans", pii_spans(F.coalesce("text", F.lit(""))))
    hidden = spans.withColumn("text", masked(F.col("text"), F.col("pii spans")))
    changed = F.size("pii spans") > 0
    new = {"n_chars": F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))}
    return hidden.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    Each row is a document with a closing token, also null and empty texts, rows without id and
    rows that repeat one; an empty table gives no pieces.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"), 1024, 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack_tokens),
]

#: The stages learn a model, search near copies and tokenise: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
