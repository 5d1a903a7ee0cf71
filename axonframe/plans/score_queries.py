"""Queries over scores, calibrations and connection weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from axonframe.operators import calibration, page, scoring, weights
from axonframe.plans.fixtures import acts, sims, table
from axonframe.plans.registry import ACTS, LEVELS, PAIRS, SIMS, TOPS, query
from axonframe.schemas import NEURON

BASE = f"WITH {ACTS}, {TOPS}, {LEVELS}, {SIMS}, {PAIRS}"
EXPLANATION = scoring.EXPLANATION
NAMES = list(scoring.SCORES)

# NaN is shown as NULL on both sides.
SCORE_SQL = """
  CASE WHEN max(r) > min(r) AND max(p) > min(p) THEN round(covar_pop(r, p) / (stddev_pop(r) * stddev_pop(p)), 6) END AS ev_correlation_score,
  CASE WHEN avg(r * r) > 0 THEN round(1 - avg((r - p) * (r - p)) / avg(r * r), 6) END AS rsquared_score,
  CASE WHEN avg(abs(r)) > 0 THEN round(1 - avg(abs(r - p)) / avg(abs(r)), 6) END AS absolute_dev_explained_score"""


def shown(name):
    return F.when(~F.isnan(name), F.round(name, 6)).alias(name)


def paired(spark, sf):
    base = acts(spark, sf)
    return scoring.pair_sequences(base, sims(base))


@query("seq_scores", f"{BASE} SELECT layer, neuron, explanation_id, seq_id, {SCORE_SQL} FROM pairs GROUP BY layer, neuron, explanation_id, seq_id")
def seq_scores(spark, sf):
    return scoring.score_sequences(paired(spark, sf)).select(*EXPLANATION, "seq_id", *map(shown, NAMES))


@query("pooled_scores", f"{BASE} SELECT layer, neuron, explanation_id, {SCORE_SQL} FROM pairs GROUP BY layer, neuron, explanation_id")
def pooled_scores(spark, sf):
    return scoring.score_explanations(paired(spark, sf)).select(*EXPLANATION, *map(shown, NAMES))


@query(
    "both_scores",
    f"""{BASE} SELECT layer, neuron, explanation_id, seq_id, grouping(seq_id) = 1 AS pooled, {SCORE_SQL} FROM pairs
    GROUP BY GROUPING SETS ((layer, neuron, explanation_id, seq_id), (layer, neuron, explanation_id))""",
)
def both_scores(spark, sf):
    return scoring.score_both(paired(spark, sf)).select(*EXPLANATION, "seq_id", "pooled", *map(shown, NAMES))


BEST = f"""pooled AS (SELECT layer, neuron, explanation_id, {SCORE_SQL} FROM pairs GROUP BY layer, neuron, explanation_id),
best AS (
  SELECT layer, neuron, arg_max(explanation_id, (coalesce(ev_correlation_score, '-inf'::DOUBLE), -explanation_id)) AS explanation_id,
         max(ev_correlation_score) AS ev_correlation_score FROM pooled GROUP BY ALL)"""


@query("best_explanation", f"{BASE}, {BEST} SELECT * FROM best")
def best_explanation(spark, sf):
    best = scoring.best_explanations(scoring.score_explanations(paired(spark, sf)))
    return best.select(*NEURON, "explanation_id", shown("ev_correlation_score"))


FIT = """fit AS (
  SELECT layer, neuron, explanation_id,
         CASE WHEN max(p) > min(p) THEN covar_pop(r, p) / var_pop(p) ELSE 0.0 END AS slope,
         CASE WHEN max(p) > min(p) THEN avg(r) - covar_pop(r, p) / var_pop(p) * avg(p) ELSE avg(r) END AS intercept
  FROM pairs GROUP BY ALL)"""


@query("linear_calibration", f"{BASE}, {FIT} SELECT layer, neuron, explanation_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit")
def linear_calibration(spark, sf):
    return calibration.fit_linear(paired(spark, sf)).select(*EXPLANATION, F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    "custom_score",
    f"{BASE} SELECT layer, neuron, explanation_id, round(max(abs(r - p / 10)), 6) AS worst, round(avg(p - r), 6) AS bias FROM pairs GROUP BY layer, neuron, explanation_id",
)
def custom_score(spark, sf):
    """A caller's own score functions."""
    own = {"worst": lambda r, p: F.max(F.abs(r - p / 10)), "bias": lambda r, p: F.avg(p - r)}
    return scoring.score_explanations(paired(spark, sf), own).select(*EXPLANATION, *[F.round(c, 6).alias(c) for c in own])



@query(
    "numpy_score",
    f"""{BASE} SELECT layer, neuron, explanation_id, seq_id, round(median(abs(r - p / 10)), 6) AS middle,
    round(1 - avg(abs(r - p)) / avg(abs(r)), 6) AS explained FROM pairs GROUP BY layer, neuron, explanation_id, seq_id""",
)
def numpy_score(spark, sf):
    """A caller's own score functions of whole arrays."""
    own = {
        "middle": lambda r, p: np.median(np.abs(r - p / 10)),
        "explained": lambda r, p: 1 - np.abs(r - p).mean() / np.abs(r).mean(),
    }
    return scoring.score_arrays(paired(spark, sf), own).select(*EXPLANATION, "seq_id", *[F.round(c, 6).alias(c) for c in own])


def flat(calibrated):
    zipped = F.arrays_zip("uncalibrated", "expected")
    return calibrated.select(*EXPLANATION, "seq_id", "scale", F.posexplode(zipped).alias("pos", "z")).select(
        *EXPLANATION, "seq_id", "scale", F.col("pos").cast("bigint").alias("pos"),
        F.col("z.uncalibrated").alias("simulated"), F.round("z.expected", 6).alias("calibrated"),
    )


@query(
    "linear_applied",
    f"""{BASE}, {FIT} SELECT layer, neuron, explanation_id, seq_id, 'neuron_activations' AS scale, pos, p AS simulated,
    round(slope * p + intercept, 6) AS calibrated FROM pairs JOIN fit USING (layer, neuron, explanation_id)""",
)
def linear_applied(spark, sf):
    pairs = paired(spark, sf)
    return flat(calibration.calibrate(pairs, pairs, "linear"))


@query(
    "no_calibration",
    f"{BASE} SELECT layer, neuron, explanation_id, seq_id, 'neuron_activations' AS scale, pos, p AS simulated, round(p, 6) AS calibrated FROM pairs",
)
def no_calibration(spark, sf):
    base = acts(spark, sf)
    return flat(calibration.calibrate(sims(base), None, "none"))


@query(
    "distribution_calibration",
    f"""{BASE}, {FIT}, spread AS (
      SELECT layer, neuron, explanation_id, seq_id, pos, unnest([0::BIGINT, 1]) AS item, unnest([p, p + 0.5]) AS v FROM pairs)
    SELECT layer, neuron, explanation_id, seq_id, pos, item, round(slope * v + intercept, 6) AS calibrated
    FROM spread JOIN fit USING (layer, neuron, explanation_id)""",
)
def distribution_calibration(spark, sf):
    pairs = paired(spark, sf)
    spread = pairs.withColumn("dist_values", F.transform("expected", lambda v: F.array(v, v + 0.5)))
    out = calibration.calibrate(spread, pairs, "linear")
    rows = out.select(*EXPLANATION, "seq_id", F.posexplode("dist_values").alias("pos", "d"))
    return rows.select(*EXPLANATION, "seq_id", F.col("pos").cast("bigint").alias("pos"), F.posexplode("d").alias("item", "v")).select(
        *EXPLANATION, "seq_id", "pos", "item", F.round("v", 6).alias("calibrated")
    )


# Calibration records are even sequences here; all sequences are mapped.
KNOTS = """xs AS (SELECT layer, neuron, explanation_id, p AS v, row_number() OVER (PARTITION BY layer, neuron, explanation_id ORDER BY p) AS i FROM pairs WHERE seq_id % 2 = 0),
ys AS (SELECT layer, neuron, explanation_id, r AS v, row_number() OVER (PARTITION BY layer, neuron, explanation_id ORDER BY r) AS i FROM pairs WHERE seq_id % 2 = 0),
both_sides AS (SELECT layer, neuron, explanation_id, i, xs.v AS x, ys.v AS y FROM xs JOIN ys USING (layer, neuron, explanation_id, i)),
knots AS (SELECT layer, neuron, explanation_id, x, arg_min(y, i) AS y_first, arg_max(y, i) AS y_last FROM both_sides GROUP BY ALL)"""


def calibration_half(pairs):
    return pairs.where(F.col("seq_id") % 2 == 0)


@query(
    "percentile_calibration",
    f"{BASE}, {KNOTS} SELECT layer, neuron, explanation_id, x, round(y_first, 6) AS y_first, round(y_last, 6) AS y_last FROM knots",
)
def percentile_calibration(spark, sf):
    knots = calibration.fit_percentiles(calibration_half(paired(spark, sf)))
    return knots.select(*EXPLANATION, "x", F.round("y_first", 6).alias("y_first"), F.round("y_last", 6).alias("y_last"))


@query(
    "percentile_applied",
    f"""{BASE}, {KNOTS}, wanted AS (SELECT layer, neuron, explanation_id, seq_id, pos, p + 0.25 * (pos % 3) - 0.25 AS p FROM pairs),
    placed AS (
      SELECT w.*, (SELECT max(x) FROM knots k WHERE k.layer = w.layer AND k.neuron = w.neuron AND k.explanation_id = w.explanation_id AND k.x <= w.p) AS u,
             (SELECT min(x) FROM knots k WHERE k.layer = w.layer AND k.neuron = w.neuron AND k.explanation_id = w.explanation_id AND k.x > w.p) AS o FROM wanted w)
    SELECT layer, neuron, explanation_id, seq_id, 'neuron_activations' AS scale, pos, p AS simulated,
      round(CASE WHEN u IS NULL THEN ok.y_first WHEN o IS NULL OR u = p THEN uk.y_last
                 ELSE uk.y_last + (ok.y_first - uk.y_last) / (o - u) * (p - u) END, 6) AS calibrated
    FROM placed LEFT JOIN (SELECT layer, neuron, explanation_id, x AS u, y_last FROM knots) uk USING (layer, neuron, explanation_id, u)
    LEFT JOIN (SELECT layer, neuron, explanation_id, x AS o, y_first FROM knots) ok USING (layer, neuron, explanation_id, o)""",
)
def percentile_applied(spark, sf):
    pairs = paired(spark, sf)
    moved = pairs.withColumn("expected", F.transform("expected", lambda v, i: v + F.lit(0.25) * (i % 3) - 0.25))
    return flat(calibration.calibrate_percentiles(moved, calibration_half(pairs)))


# Connections: the label of a vector plays the layer, its id the neuron.
EDGES = """n AS (SELECT CAST(label AS BIGINT) AS layer, vec_id AS neuron, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings),
gained AS (SELECT layer, neuron, list_transform(vector, lambda x: x * (1.0 + layer / 10.0::DOUBLE)) AS vector FROM n),
edges AS (
  SELECT a.layer AS l1, a.neuron AS n1, b.layer AS l2, b.neuron AS n2, list_dot_product(a.vector, b.vector) AS weight
  FROM n a JOIN gained b ON a.layer < b.layer),
ends AS (
  SELECT 'output' AS direction, l1 AS layer, n1 AS neuron, l2 AS to_layer, n2 AS to_neuron, weight FROM edges
  UNION ALL SELECT 'input', l2, n2, l1, n1, weight FROM edges),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY layer, neuron, direction ORDER BY weight DESC, to_layer, to_neuron) AS up,
         row_number() OVER (PARTITION BY layer, neuron, direction ORDER BY weight, to_layer, to_neuron) AS down FROM ends),
connections AS (
  SELECT direction, 'positive' AS sign, layer, neuron, to_layer, to_neuron, weight, up AS rank FROM ranked WHERE up <= 10
  UNION ALL SELECT direction, 'negative', layer, neuron, to_layer, to_neuron, weight, down FROM ranked WHERE down <= 10)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("int").alias("layer"), F.col("vec_id").alias("neuron"), F.col("embedding").cast("array<double>").alias("vector")
    )


def gains(spark, sf):
    layers = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("layer")).distinct()
    return layers.withColumn("gain", F.array_repeat(1.0 + F.col("layer") / 10.0, 64))


def connections(spark, sf, signs=weights.SIGNS):
    rows = vectors(spark, sf)
    return weights.strongest_connections(rows, rows, gains(spark, sf), 10, signs=signs)


CONNECTION_COLUMNS = ["direction", *NEURON, "rank", "to_layer", "to_neuron"]


def _side(sign):
    @query(
        f"dot_top_{sign}",
        f"WITH {EDGES} SELECT direction, layer, neuron, rank, to_layer, to_neuron, round(weight, 6) AS weight FROM connections WHERE sign = '{sign}'",
    )
    def run(spark, sf):
        return connections(spark, sf, (sign,)).where(F.col("sign") == sign).select(*CONNECTION_COLUMNS, F.round("weight", 6).alias("weight"))

    return run


for _sign in ("positive", "negative"):
    _side(_sign)


SPARSE = """sparse AS (SELECT layer, neuron, d, x FROM (SELECT layer, neuron, unnest(vector) AS x, unnest(range(len(vector))) AS d FROM n) WHERE abs(x) > 0.15),
sparse_dots AS (
  SELECT a.layer AS l1, a.neuron AS n1, b.layer AS l2, b.neuron AS n2, sum(a.x * b.x * (1.0 + b.layer / 10.0::DOUBLE)) AS weight
  FROM sparse a JOIN sparse b ON a.d = b.d AND a.layer < b.layer GROUP BY ALL)"""


@query(
    "dot_top_sparse",
    f"""WITH {EDGES}, {SPARSE}, both_ends AS (
      SELECT *, row_number() OVER (PARTITION BY l1, n1 ORDER BY weight DESC, l2, n2) AS up,
             row_number() OVER (PARTITION BY l1, n1 ORDER BY weight, l2, n2) AS down FROM sparse_dots)
    SELECT 'positive' AS sign, l1 AS layer, n1 AS neuron, up AS rank, l2 AS to_layer, n2 AS to_neuron, round(weight, 6) AS weight FROM both_ends WHERE up <= 5
    UNION ALL SELECT 'negative', l1, n1, down, l2, n2, round(weight, 6) FROM both_ends WHERE down <= 5""",
)
def dot_top_sparse(spark, sf):
    """Vectors of which small components are left out, as rows of components."""
    rows = vectors(spark, sf).select(*NEURON, F.posexplode("vector").alias("d", "value")).where(F.abs("value") > 0.15)
    layers = gains(spark, sf).select("layer", F.posexplode("gain").alias("d", "gain"))
    found = weights.sparse_connections(rows, rows, layers, 5, directions=("output",))
    return found.select("sign", *CONNECTION_COLUMNS[1:], F.round("weight", 6).alias("weight"))


@query(
    "token_weights",
    f"""WITH {EDGES}, dots AS (
      SELECT g.layer, g.neuron, 'v' || v.neuron AS token, v.neuron AS token_id, list_dot_product(g.vector, v.vector) AS weight FROM gained g, n v),
    both_ends AS (
      SELECT *, row_number() OVER (PARTITION BY layer, neuron ORDER BY weight DESC, token_id) AS up,
             row_number() OVER (PARTITION BY layer, neuron ORDER BY weight, token_id) AS down FROM dots)
    SELECT layer, neuron, 'positive' AS sign, up AS rank, token, round(weight, 6) AS weight FROM both_ends WHERE up <= 5
    UNION ALL SELECT layer, neuron, 'negative', down, token, round(weight, 6) FROM both_ends WHERE down <= 5""",
)
def token_weights(spark, sf):
    rows = vectors(spark, sf)
    words = rows.select(F.col("neuron").alias("token_id"), F.concat(F.lit("v"), F.col("neuron").cast("string")).alias("token"), "vector")
    found = weights.token_connections(rows, words, gains(spark, sf), 5)
    return found.select(*NEURON, "sign", "rank", "token", F.round("weight", 6).alias("weight"))


RELATED = """related AS (SELECT direction, layer, neuron, rank, to_layer, to_neuron, weight FROM connections WHERE sign = 'positive' AND rank <= 10)"""
TEXTS = "texts AS (SELECT layer, neuron, 'explained by ' || neuron AS explanation, vector[1] AS score FROM n WHERE neuron % 3 <> 0)"


def explanation_texts(spark, sf):
    rows = vectors(spark, sf).where(F.col("neuron") % 3 != 0)
    return rows.select(
        *NEURON, F.concat(F.lit("explained by "), F.col("neuron").cast("string")).alias("explanation"), F.get("vector", F.lit(0)).alias("score")
    )


@query("related_top10", f"WITH {EDGES}, {RELATED} SELECT direction, layer, neuron, rank, to_layer, to_neuron, round(weight, 6) AS weight FROM related")
def related_top10(spark, sf):
    return page.listed_related(connections(spark, sf, ("positive",))).select(*CONNECTION_COLUMNS, F.round("weight", 6).alias("weight"))


@query(
    "related_explanations",
    f"""WITH {EDGES}, {RELATED}, {TEXTS} SELECT r.direction, r.layer, r.neuron, r.rank, r.to_layer, r.to_neuron,
    t.explanation AS to_explanation, round(t.score, 6) AS to_score
    FROM related r LEFT JOIN texts t ON t.layer = r.to_layer AND t.neuron = r.to_neuron WHERE r.rank <= 3""",
)
def related_explanations(spark, sf):
    related = page.listed_related(connections(spark, sf, ("positive",)))
    joined = page.related_explanations(related, explanation_texts(spark, sf))
    return joined.select(*CONNECTION_COLUMNS, "to_explanation", F.round("to_score", 6).alias("to_score"))


@query(
    "neuron_page",
    f"""WITH {EDGES}, {RELATED}, {TEXTS}, counted AS (
      SELECT layer, neuron, count(*) AS n_related, round(max(weight), 6) AS strongest FROM related GROUP BY ALL),
    stats AS (SELECT layer, neuron, round(list_max(vector), 6) AS top_value FROM n WHERE neuron % 5 <> 0)
    SELECT layer, neuron, explanation, top_value, n_related, strongest
    FROM n LEFT JOIN texts USING (layer, neuron) LEFT JOIN stats USING (layer, neuron) LEFT JOIN counted USING (layer, neuron)""",
)
def neuron_page(spark, sf):
    rows = vectors(spark, sf)
    related = page.listed_related(connections(spark, sf, ("positive",))).groupBy(*NEURON).agg(
        F.count("*").alias("n_related"), F.round(F.max("weight"), 6).alias("strongest")
    )
    stats = rows.where(F.col("neuron") % 5 != 0).select(*NEURON, F.round(F.array_max("vector"), 6).alias("top_value"))
    texts = explanation_texts(spark, sf).select(*NEURON, "explanation")
    return page.neuron_page(rows.select(*NEURON), texts, stats, related=related)
