"""Named queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query.  Its integer columns are reported as 64-bit, like those of the SQL twin."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = function(spark, sf_dir)
            return found.select(*[
                F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c)
                for c, kind in found.dtypes
            ])

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# Building blocks of the SQL twins.  Floats are rounded to 6 digits on both sides.
ACTS = """acts AS (
  SELECT i // 32 AS layer, i % 32 AS neuron, vec_id // 16 AS seq_id,
         list('t' || label ORDER BY vec_id) AS tokens,
         list(CAST(embedding[i + 1] AS DOUBLE) ORDER BY vec_id) AS activations
  FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY ALL)"""

COARSE = """coarse AS (
  SELECT layer, neuron, seq_id, tokens,
         list_transform(activations, lambda x: floor(x * 10.0 + 0.5) / 10.0) AS activations FROM acts)"""

VALS = """vals AS (
  SELECT layer, neuron, seq_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token, unnest(activations) AS a FROM acts)"""

TOPS = """tops AS (
  SELECT layer, neuron, greatest(0.0, max(list_max(activations))) AS relu_max FROM acts GROUP BY ALL)"""

LEVELS = """levels AS (
  SELECT layer, neuron, seq_id, tokens, activations, relu_max,
         CASE WHEN relu_max <= 0 THEN list_transform(activations, lambda x: 0)
              ELSE list_transform(activations, lambda x: CAST(least(10, floor(10.0 * greatest(0.0, x) / relu_max)) AS INT)) END AS levels
  FROM acts JOIN tops USING (layer, neuron))"""

SIMS = """sims AS (
  SELECT layer, neuron, CAST(0 AS BIGINT) AS explanation_id, seq_id, tokens, list_transform(levels, lambda v: CAST(v AS DOUBLE)) AS expected FROM levels
  UNION ALL
  SELECT layer, (neuron + 31) % 32, 1, seq_id, tokens, list_transform(levels, lambda v: CAST(v AS DOUBLE)) FROM levels)"""

PAIRS = """pairs AS (
  SELECT layer, neuron, explanation_id, seq_id, unnest(range(len(expected))) AS pos, unnest(activations) AS r, unnest(expected) AS p
  FROM sims JOIN acts USING (layer, neuron, seq_id))"""


def sql_draw(seed: int, *columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 1, 15) AS BIGINT)"


def sql_heap(source: str, k: int, arrival: str = "seq_id", keep: str = "seq_id, score") -> str:
    """CTE chain: what a heap of k keeps of ``source`` (layer, neuron, score, arrival columns)."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY score DESC, {arrival}) AS best FROM {source}),
limits AS (SELECT layer, neuron, min(score) FILTER (WHERE best <= {k}) AS t FROM ranked GROUP BY ALL),
above AS (
  SELECT ranked.*, t, row_number() OVER (PARTITION BY layer, neuron ORDER BY {arrival}) AS early
  FROM ranked JOIN limits USING (layer, neuron) WHERE score >= t),
held AS (
  SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY score DESC, {arrival} DESC) AS late
  FROM above WHERE score > t OR early <= {k}),
heap AS (
  SELECT layer, neuron, {keep}, row_number() OVER (PARTITION BY layer, neuron ORDER BY score DESC, {arrival}) AS rank
  FROM held WHERE late <= {k})"""
