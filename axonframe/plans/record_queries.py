"""Queries over per-neuron summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from axonframe.functions.arrays import record_score
from axonframe.operators import merge, records, splits, tokens
from axonframe.operators.scoring import run_differences
from axonframe.operators.scale import exact_percentiles
from axonframe.plans.fixtures import acts, coarse
from axonframe.plans.registry import ACTS, COARSE, LEVELS, TOPS, VALS, query, sql_draw, sql_heap
from axonframe.schemas import NEURON
from axonframe.session import cut_lineage, shared_dir
from axonframe.sources import neurons
from axonframe.sources.neuron_files import write_neuron_files

K, N = 12, 8
SCORED = "scored AS (SELECT *, list_max(activations) AS score FROM coarse)"


def rounded(name: str):
    return F.round(name, 6).alias(name)


@query("record_score", f"WITH {ACTS} SELECT layer, neuron, seq_id, list_max(activations) AS score FROM acts")
def record_scores(spark, sf):
    return acts(spark, sf).select(*NEURON, "seq_id", record_score(F.col("activations")).alias("score"))


def fetched(spark, sf, kind, **sizes):
    table = coarse(acts(spark, sf))
    found = records.neuron_records(table, **sizes).where(F.col("kind") == kind)
    return found.select(
        *NEURON, "rank", "seq_id", "score", F.array_join("tokens", " ").alias("tokens"),
        (F.round(F.aggregate("activations", F.lit(0.0), lambda a, b: a + b), 6) + 0.0).alias("total"), "bucket",
    )


@query(
    "topk_records",
    f"""WITH {ACTS}, {COARSE}, {SCORED}, {sql_heap("scored", K, keep="seq_id, score, tokens, activations")}
    SELECT layer, neuron, rank, seq_id, score, array_to_string(tokens, ' ') AS tokens,
           round(list_sum(activations), 6) + 0.0 AS total FROM heap""",
)
def topk_records(spark, sf):
    return fetched(spark, sf, "top", k=K, sample_size=0, quantiles=None).drop("bucket")


@query(
    "hash_sample",
    f"""WITH {ACTS}, {COARSE}, {SCORED}, drawn AS (
      SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS rank FROM scored)
    SELECT layer, neuron, rank, seq_id, score, array_to_string(tokens, ' ') AS tokens,
           round(list_sum(activations), 6) + 0.0 AS total FROM drawn WHERE rank <= {N}""",
)
def hash_sample(spark, sf):
    return fetched(spark, sf, "random", k=0, sample_size=N, quantiles=None).drop("bucket")


BOUNDS = """bounds AS (
  SELECT layer, neuron, quantile_disc(score, 0.5) AS q50, quantile_disc(score, 0.9) AS q90,
         quantile_disc(score, 0.99) AS q99, quantile_disc(score, 0.999) AS q999 FROM scored GROUP BY ALL)"""
BUCKETS = """buckets AS (
  SELECT layer, neuron, seq_id, score, tokens, activations, CAST((score >= q50)::INT + (score >= q90)::INT + (score >= q99)::INT + (score >= q999)::INT AS BIGINT) AS bucket
  FROM scored JOIN bounds USING (layer, neuron))"""


@query("quantile_boundaries", f"WITH {ACTS}, {COARSE}, {SCORED}, {BOUNDS} SELECT * FROM bounds")
def boundaries(spark, sf):
    found = records.quantile_boundaries(records.record_index(coarse(acts(spark, sf))))
    names = ["q50", "q90", "q99", "q999"]
    return found.select(*NEURON, *[F.get("quantile_boundaries", F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("quantile_buckets", f"WITH {ACTS}, {COARSE}, {SCORED}, {BOUNDS}, {BUCKETS} SELECT layer, neuron, seq_id, score, bucket FROM buckets")
def buckets(spark, sf):
    index = records.record_index(coarse(acts(spark, sf)))
    return records.bucketed(index, records.quantile_boundaries(index)).select(*NEURON, "seq_id", "score", "bucket")


@query(
    "quantile_sample",
    f"""WITH {ACTS}, {COARSE}, {SCORED}, {BOUNDS}, {BUCKETS}, drawn AS (
      SELECT *, row_number() OVER (PARTITION BY layer, neuron, bucket ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS rank FROM buckets)
    SELECT layer, neuron, bucket, rank, seq_id, score, array_to_string(tokens, ' ') AS tokens,
           round(list_sum(activations), 6) + 0.0 AS total FROM drawn WHERE rank <= 3""",
)
def quantile_sample(spark, sf):
    return fetched(spark, sf, "quantile", k=0, sample_size=0, per_quantile=3)


@query(
    "moments",
    f"""WITH {ACTS}, {VALS} SELECT layer, neuron, count(a) AS n_values, round(avg(a), 6) AS mean,
    round(var_samp(a), 6) AS variance, round(var_pop(a) * count(a), 6) AS m2 FROM vals GROUP BY ALL""",
)
def moments(spark, sf):
    return records.moments(acts(spark, sf)).select(*NEURON, "n_values", rounded("mean"), rounded("variance"), rounded("m2"))


@query(
    "higher_moments",
    f"""WITH {ACTS}, {VALS} SELECT layer, neuron,
      round(skewness(a) * (count(a) - 2) / sqrt(CAST(count(a) AS DOUBLE) * (count(a) - 1)), 6) AS skewness,
      round(kurtosis_pop(a), 6) AS kurtosis FROM vals GROUP BY layer, neuron""",
)
def higher_moments(spark, sf):
    return records.moments(acts(spark, sf)).select(*NEURON, rounded("skewness"), rounded("kurtosis"))


@query(
    "relu_max",
    f"WITH {ACTS} SELECT layer, neuron, max(list_max(activations)) AS max_activation, greatest(0.0, max(list_max(activations))) AS relu_max FROM acts GROUP BY ALL",
)
def relu_max(spark, sf):
    return records.max_activations(acts(spark, sf))


@query(
    "normalize_0_10",
    f"WITH {ACTS}, {TOPS}, {LEVELS} SELECT layer, neuron, seq_id, array_to_string(levels, ',') AS levels FROM levels",
)
def normalize(spark, sf):
    return records.with_levels(acts(spark, sf)).select(
        *NEURON, "seq_id", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels")
    )


@query(
    "nonzero_share",
    f"""WITH {ACTS}, {TOPS}, {LEVELS} SELECT layer, neuron,
    round(sum(len(list_filter(levels, lambda v: v <> 0))) / CAST(sum(len(levels)) AS DOUBLE), 6) AS nonzero_share FROM levels GROUP BY ALL""",
)
def nonzero(spark, sf):
    return records.nonzero_share(acts(spark, sf)).select(*NEURON, rounded("nonzero_share"))


@query(
    "unit_scale",
    f"""WITH {ACTS}, {TOPS}, {VALS} SELECT layer, neuron, seq_id, pos, token, a AS activation,
    round(CASE WHEN relu_max = 0 THEN 0.0 ELSE a / relu_max END, 6) AS unit FROM vals JOIN tops USING (layer, neuron)""",
)
def unit_scale(spark, sf):
    zipped = F.arrays_zip("tokens", "activations", "unit_activations")
    return records.with_unit_scale(acts(spark, sf)).select(*NEURON, "seq_id", F.posexplode(zipped).alias("pos", "z")).select(
        *NEURON, "seq_id", "pos", F.col("z.tokens").alias("token"), F.col("z.activations").alias("activation"),
        F.round("z.unit_activations", 6).alias("unit"),
    )


TOKEN_TABLE = """means AS (SELECT layer, neuron, token, avg(a) AS avg_activation, count(a) AS n FROM vals GROUP BY ALL),
listed AS (SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY avg_activation DESC, token) AS rank FROM means)"""


@query(
    "token_mean_activation",
    f"WITH {ACTS}, {VALS}, {TOKEN_TABLE} SELECT layer, neuron, rank, token, round(avg_activation, 6) AS avg_activation, n FROM listed WHERE rank <= 8",
)
def token_mean_activation(spark, sf):
    return tokens.token_averages(acts(spark, sf), 8).select(*NEURON, "rank", "token", rounded("avg_activation"), "n")


@query(
    "shown_tokens",
    f"""WITH {ACTS}, {VALS}, {TOKEN_TABLE}, picked AS (
      SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(0, "layer", "neuron", "token")}, token) AS pick FROM listed WHERE rank <= 8)
    SELECT layer, neuron, rank, token FROM picked WHERE pick <= 4""",
)
def shown_tokens(spark, sf):
    return tokens.shown_tokens(tokens.token_averages(acts(spark, sf), 8), 4).select(*NEURON, "rank", "token")


@query(
    "run_summary",
    f"""WITH {ACTS} SELECT count(DISTINCT (layer, neuron)) AS neurons, count(DISTINCT layer) AS layers,
    count(*) AS records, count(DISTINCT seq_id) AS sequences FROM acts""",
)
def run_summary(spark, sf):
    return records.run_summary(acts(spark, sf))


@query(
    "run_diff_percentiles",
    f"""WITH {ACTS}, {VALS}, gaps AS (SELECT abs(a - floor(a * 10.0 + 0.5) / 10.0) AS gap FROM vals)
    SELECT round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.9), 6) AS p90,
           round(quantile_cont(gap, 0.99), 6) AS p99, round(quantile_cont(gap, 0.999), 6) AS p999 FROM gaps""",
)
def run_diff_percentiles(spark, sf):
    base = acts(spark, sf)
    gaps = cut_lineage(run_differences(base, coarse(base)))
    found = exact_percentiles(gaps, "gap", [0.5, 0.9, 0.99, 0.999])
    return spark.createDataFrame([tuple(round(x, 6) for x in found)], "p50 DOUBLE, p90 DOUBLE, p99 DOUBLE, p999 DOUBLE")


@query(
    "layer_neuron_select",
    f"WITH {ACTS} SELECT layer, neuron, seq_id, len(activations) AS n_values FROM acts WHERE layer = 1 AND neuron IN (0, 3, 31)",
)
def layer_neuron_select(spark, sf):
    chosen = records.check_neurons(32, [31, 3, 0, 3])
    return records.select_neurons(acts(spark, sf), records.check_layers(2, [1]), chosen).select(
        *NEURON, "seq_id", F.size("activations").cast("bigint").alias("n_values")
    )


@query(
    "neuron_keys",
    """SELECT DISTINCT CAST(label AS BIGINT) AS layer, vec_id AS neuron FROM embeddings WHERE vec_id % 7 <> 0""",
)
def neuron_keys(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    name = F.when(F.col("vec_id") % 7 == 0, F.lit("README")).otherwise(F.col("vec_id").cast("string"))
    return records.neuron_keys(table.select(F.col("label").alias("layer"), name.alias("neuron")))


def retained(spark, sf):
    """Top and random lists of every neuron; the random list is a hash sample."""
    return records.neuron_records(coarse(acts(spark, sf)), K, N, None)


SPLIT_SQL = f"""WITH {ACTS}, {COARSE}, {SCORED}, {sql_heap("scored", K)},
drawn AS (
  SELECT layer, neuron, seq_id, score, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS rank FROM scored),
lists AS (
  SELECT 'top' AS kind, layer, neuron, seq_id, rank - 1 AS p, 4 AS stride FROM heap
  UNION ALL SELECT 'random', layer, neuron, seq_id, rank - 1, 3 FROM drawn WHERE rank <= {N}),
sized AS (SELECT *, count(*) OVER (PARTITION BY layer, neuron, kind) // stride AS each FROM lists),
dealt AS (
  SELECT *, CASE WHEN kind = 'top' THEN (['train', 'calibration', 'valid', 'test'])[p % 4 + 1]
                 ELSE (['calibration', 'valid', 'test'])[p % 3 + 1] END AS split FROM sized WHERE p < each * stride),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY layer, neuron, split ORDER BY kind DESC, p) - 1 AS position FROM dealt)
SELECT layer, neuron, kind, seq_id, position FROM placed WHERE split = """


def _split(name):
    @query(f"split_{name}", f"{SPLIT_SQL}'{name}'")
    def run(spark, sf):
        return splits.one_split(retained(spark, sf), name).select(*NEURON, "kind", "seq_id", F.col("position").cast("bigint").alias("position"))

    return run


for _name in splits.TOP_SPLITS:
    _split(_name)


def shard_records(spark, sf, k, n):
    """Retained records and moments of four shards."""
    table = acts(spark, sf).withColumn("shard", F.expr("cast(seq_id % 4 as int)"))
    parts = [table.where(F.col("shard") == s).drop("shard") for s in range(4)]
    kept = None
    stats = None
    for number, part in enumerate(parts):
        found = records.neuron_records(part, k, n, None).withColumn("shard", F.lit(number))
        own = records.moments(part).withColumn("shard", F.lit(number))
        kept = found if kept is None else kept.unionByName(found)
        stats = own if stats is None else stats.unionByName(own)
    return kept, stats


PLAIN_SCORED = "scored AS (SELECT *, list_max(activations) AS score, seq_id % 4 AS shard FROM acts)"


@query(
    "merge_exact",
    f"""WITH {ACTS}, {PLAIN_SCORED}, {sql_heap("scored", 5)},
    drawn AS (SELECT layer, neuron, seq_id, score, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS rank FROM scored)
    SELECT 'top' AS kind, layer, neuron, rank, seq_id, score FROM heap
    UNION ALL SELECT 'random', layer, neuron, rank, seq_id, score FROM drawn WHERE rank <= 4""",
)
def merge_exact(spark, sf):
    merged, _ = merge.merge_exact(*shard_records(spark, sf, 5, 4), k=5, sample_size=4)
    return merged.select("kind", *NEURON, F.col("rank").cast("bigint").alias("rank"), "seq_id", "score")


@query(
    "merge_exact_moments",
    f"""WITH {ACTS}, {VALS} SELECT layer, neuron, count(a) AS n_values, round(avg(a), 6) AS mean,
    round(var_samp(a), 6) AS variance FROM vals GROUP BY ALL""",
)
def merge_exact_moments(spark, sf):
    table = acts(spark, sf).withColumn("shard", F.expr("cast(seq_id % 4 as int)"))
    stats = records.moments(table, [*NEURON, "shard"])
    return records.merge_moments(stats).select(*NEURON, "n_values", rounded("mean"), rounded("variance"))


RETAINED_SQL = f"""WITH {ACTS}, {PLAIN_SCORED},
listed AS (
  SELECT *, row_number() OVER (PARTITION BY layer, neuron, shard ORDER BY score DESC, seq_id) AS by_score,
         row_number() OVER (PARTITION BY layer, neuron, shard ORDER BY {sql_draw(1234, "layer", "neuron", "seq_id")}, seq_id) AS by_draw FROM scored),
fed AS (
  SELECT layer, neuron, seq_id, score, activations, shard * 1000 + by_score AS arrival, shard, 0 AS kind_no, 0 AS bucket, by_score AS place FROM listed WHERE by_score <= 5
  UNION ALL SELECT layer, neuron, seq_id, score, activations, shard * 1000 + 500 + by_draw, shard, 1, 0, by_draw FROM listed WHERE by_draw <= 4)"""


@query(
    "merge_retained",
    f"""{RETAINED_SQL}, {sql_heap("fed", 5, arrival="arrival")},
    drawn AS (SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(1234, "layer", "neuron", "shard", "kind_no", "bucket", "place")}, arrival) AS rank FROM fed)
    SELECT layer, neuron, 'top' AS kind, rank, seq_id, score FROM heap
    UNION ALL SELECT layer, neuron, 'random', rank, seq_id, score FROM drawn WHERE rank <= 4""",
)
def merge_retained(spark, sf):
    kept, _ = shard_records(spark, sf, 5, 4)
    merged, _ = merge.merge_retained(kept, 5, 4)
    return merged.select(*NEURON, "kind", F.col("rank").cast("bigint").alias("rank"), "seq_id", "score")


@query(
    "merge_retained_moments",
    f"""{RETAINED_SQL}, v AS (SELECT layer, neuron, unnest(activations) AS a FROM fed)
    SELECT layer, neuron, count(a) AS n_values, round(avg(a), 6) AS mean, round(var_samp(a), 6) AS variance FROM v GROUP BY ALL""",
)
def merge_retained_moments(spark, sf):
    kept, _ = shard_records(spark, sf, 5, 4)
    _, stats = merge.merge_retained(kept, 5, 4)
    return stats.select(*NEURON, "n_values", rounded("mean"), rounded("variance"))


@query(
    "merge_json_trees",
    f"""{RETAINED_SQL}, {sql_heap("fed", 5, arrival="arrival")},
    drawn AS (SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY {sql_draw(1234, "layer", "neuron", "shard", "kind_no", "bucket", "place")}, arrival) AS rank FROM fed),
    merged AS (SELECT layer, neuron, 'top' AS kind, rank, seq_id FROM heap UNION ALL SELECT layer, neuron, 'random', rank, seq_id FROM drawn WHERE rank <= 4),
    v AS (SELECT layer, neuron, unnest(activations) AS a FROM fed),
    m AS (SELECT layer, neuron, round(avg(a), 6) + 0.0 AS mean, round(var_samp(a), 6) AS variance FROM v GROUP BY ALL)
    SELECT layer, neuron, kind, rank, array_to_string(tokens, ' ') AS tokens, round(list_sum(activations), 6) + 0.0 AS total, mean, variance
    FROM merged JOIN acts USING (layer, neuron, seq_id) JOIN m USING (layer, neuron)""",
)
def merge_json_trees(spark, sf):
    """Four trees are written as <layer>/<neuron>.json and read, merged, written and read again."""
    table = acts(spark, sf).withColumn("shard", F.expr("cast(seq_id % 4 as int)"))
    folder = f"{shared_dir(spark)}/axonframe-trees-{uuid.uuid4().hex}"
    trees = []
    for shard in range(4):
        part = table.where(F.col("shard") == shard).drop("shard")
        nested = neurons.to_neuron_records(records.neuron_records(part, 5, 4, None), records.moments(part))
        write_neuron_files(nested, f"{folder}/{shard}")
        trees.append(neurons.read_neuron_records(spark, f"{folder}/{shard}/neurons"))
    write_neuron_files(merge.merge_neuron_trees(trees, 5, 4), f"{folder}/merged")
    found = neurons.read_neuron_records(spark, f"{folder}/merged/neurons")
    total = F.aggregate("activations", F.lit(0.0), lambda a, b: a + b)
    stats = found.select(*NEURON, (F.round("mean", 6) + 0.0).alias("mean"), F.round("variance", 6).alias("variance"))
    return neurons.record_rows(found).join(stats, NEURON).select(
        *NEURON, "kind", "rank", F.array_join("tokens", " ").alias("tokens"), (F.round(total, 6) + 0.0).alias("total"), "mean", "variance"
    )
