"""One query per operator: opN_<name>, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.ngram_join import ngram_join

    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.substring_dedup import substring_dedup

    found = substring_dedup(documents(spark, sf_dir))
    return found.select(F.col("row_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 1024, 0)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.bpe import bpe_decode, bpe_encode

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    found = bpe_decode(bpe_encode(documents(spark, sf_dir), ranks, PATTERN), ranks)
    return found.select(
        F.col("row_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.pii import BASE, find_pii, spans_text

    found = find_pii(documents(spark, sf_dir)).select(F.col("row_id").alias("doc_id"), "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("highest_score"),
    )


@query
def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.vafile import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


SQL["op10_va_file"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM whole),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""


@query
def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.spotsigs import edited_fingerprints

    return edited_fingerprints(documents(spark, sf_dir)).withColumnRenamed("row_id", "doc_id")


# Fingerprints cannot be written in SQL, but the edited texts can: the tests compare these columns.
OP6_EDITED_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents)
SELECT doc_id, length(text) AS n_chars,
  sha256(substr(text, 1, length(text) - length(text) // 4) || substr(following, 1, length(text) // 4)) AS edited_sha256
FROM d
"""


#: Documents are rejected when they are more likely toxic than not.
REJECTED = 0.5


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.toxicity import severity, toxicity_model

    docs = documents(spark, sf_dir)
    found = severity(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(
        F.col("row_id").alias("doc_id"), "expected_severity", F.col("grade").cast("bigint").alias("grade"), "p_toxic",
        (F.col("p_toxic") >= REJECTED).cast("bigint").alias("toxic"),
    )


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.license_scan import license_scan

    return license_scan(documents(spark, sf_dir)).withColumnRenamed("row_id", "doc_id")


@query
def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as response records against a replica with planted faults: one flipped character, a cut, lost records."""
    from axonframe.llm.merkle import audit, manifest, warc_record

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    block = warc_record(F.col("url"), F.col("html"))
    kept = pages.where("page_id % 499 <> 17")
    harmed = (
        F.when(F.expr("page_id % 487 = 5"), F.concat(F.lit("#"), F.expr("substring(html, 2)")))
        .when(F.expr("page_id % 491 = 11"), F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    )
    replica = manifest(kept.withColumn("html", harmed), "page_id", block)
    return audit(manifest(pages, "page_id", block), replica).withColumnRenamed("id", "page_id")


_RECORD = "'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || url || '\r\nContent-Length: ' || strlen(html) || '\r\n\r\n' || html || '\r\n\r\n'"
_ENTRIES = f"""SELECT page_id, page_id // 4096 AS file, CAST(strlen(block) AS BIGINT) AS size, sha256(block) AS digest,
    CAST(coalesce(sum(strlen(block)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT page_id, {_RECORD} AS block FROM"""
SQL["op2_merkle_audit"] = f"""
WITH a AS ({_ENTRIES} pages)),
harmed AS (
  SELECT page_id, url, CASE WHEN page_id % 487 = 5 THEN '#' || substr(html, 2) WHEN page_id % 491 = 11 THEN substr(html, 1, length(html) // 2) ELSE html END AS html
  FROM pages WHERE page_id % 499 <> 17),
b AS ({_ENTRIES} harmed))
SELECT page_id, a.file, a.start, a.start + a.size AS stop,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'changed' ELSE 'moved' END AS kind,
  a.digest AS expected, b.digest AS found
FROM a LEFT JOIN b USING (page_id) WHERE b.digest IS NULL OR a.digest <> b.digest OR a.start <> b.start
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as leaves; a replica in which every third text (by the id's checksum) has lost its capitals."""
    from axonframe.llm.butterfly import dataset_manifest, folded, siblings_text

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    claimed = [*map(F.col, ("doc_id", "source", "lang", "n_chars")), tampered]
    found = dataset_manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], claimed=claimed)
    found = found.withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
    return found.select(
        F.col("row_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _op12_sql(inside: int = 8, between: int = 3) -> str:
    """Levels inside a language and between languages; 8 and 3 suffice for 16 million documents in each of 512 languages."""
    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def levels(name: str, first: str, count: int) -> list[str]:
        parts, nodes = [], first
        for k in range(count):
            parts.append(f"""{name}{k} AS MATERIALIZED (SELECT g, i // 8 AS run, any_value(n) AS n, list(h ORDER BY i) AS hs
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({nodes})) GROUP BY g, i // 8)""")
            nodes = f"SELECT g, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}{k}"
        return [*parts, f"{name}_top AS MATERIALIZED ({nodes})"]

    def climb(name: str, at: str, first: str, count: int, group: str) -> list[str]:
        parts, before = [], first
        for k in range(count):
            o = f"({at} // {8**k} % 8)"
            left, right = f"array_to_string(hs[1:{o}], '')", f"array_to_string(hs[{o} + 2:], '')"
            parts.append(f"""{name}_at{k} AS (SELECT d.* EXCLUDE (folded, siblings),
  CASE WHEN n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded,
  CASE WHEN n = 1 THEN siblings ELSE siblings || {left} || {right} END AS siblings
  FROM {before} d JOIN {name}{k} r ON r.g = {group} AND r.run = {at} // {8 ** (k + 1)})""")
            before = f"{name}_at{k}"
        return parts

    parts = [
        """crc AS (SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))""",
        """sums AS (SELECT documents.*, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS sum FROM documents, crc)""",
        f"""hashed AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf('claim')} AS claimed
  FROM (SELECT *, CASE WHEN sum % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS claim FROM sums))""",
        """d AS MATERIALIZED (SELECT doc_id, leaf, claimed AS folded, '' AS siblings, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed)""",
        *levels("a", "SELECT g, pos AS i, leaf AS h FROM d", inside),
        *levels("b", "SELECT 0 AS g, g AS i, h FROM a_top", between),
        *climb("a", "pos", "d", inside, "d.g"),
        *climb("b", "d.g", f"a_at{inside - 1}", between, "0"),
    ]
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, a_top.h AS subroot, b_top.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = b_top.h AS verified
FROM b_at{between - 1} d JOIN a_top ON a_top.g = d.g CROSS JOIN b_top"""


SQL["op12_manifest"] = _op12_sql()


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.llm.langid import held_out, identify, prototypes

    docs = documents(spark, sf_dir)
    model = prototypes(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return identify(docs, model).select(F.col("row_id").alias("doc_id"), held_out(F.col("row_id")).alias("held_out"), "lang_pred", "score")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved on by one, so that wrong labels are among the negatives."""
    from axonframe.llm.hard_negatives import hard_negatives

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


SQL["op13_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM whole),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
  n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scores n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score QUALIFY rank <= 10
"""
