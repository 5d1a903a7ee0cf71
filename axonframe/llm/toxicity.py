"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

For grades 0..K-1 the model is P(grade > k) = 1 / (1 + exp(threshold_k - x.w)): one weight vector
for all thresholds, which ascend; the fit maximises the likelihood of the grades, differences of
neighbouring probabilities.  The expected severity is the sum of these probabilities.

Features are words and their five-letter heads (which catch inflected and compounded forms),
weighted by log(1 + count).  The model is fitted on at most ``SAMPLE`` labelled documents, and
holds at most ``FEATURES`` features, chosen there by how unevenly they are spread over the
grades.  The two sides are sampled at their own rates; each row weighs as many labels as it
stands for, so the probabilities are those of the whole table.  Every document is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.tables import Scratch, map_batches, text_rows, utf8_rows
from axonframe.llm.words import WordHashes, Words, mix, shingle_sets

#: Labelled documents (about half of them from each side) and features, at most.
SAMPLE = 16_000
FEATURES = 4_096

#: A feature needs so many documents of the sample, and a z-score of its spread.
SUPPORT = 8
SPREAD = 5.0

#: Numbers of marked words from which a toxic document is graded 2 and 3.
MARKED = (3, 7)

#: Letters of a head.
HEAD = 5

#: Words remembered per task; beyond it the memory of words starts afresh.
KNOWN_WORDS = 150_000

_SEEN = "feature BIGINT, n BIGINT, n_above BIGINT"


def _hash(text: str) -> int:
    key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return key - (1 << 64) if key >> 63 else key


class _Features(dict):
    """Words to slots; each slot holds the word's features, -1 for none.  Words without known features share slot 0."""

    def __init__(self, known: dict[int, int] | None):
        self.known, self.pairs = known, [(-1, -1)] if known is not None else []

    def __missing__(self, word: str) -> int:
        bare = "".join(filter(str.isalpha, word.lower()))
        names = (_hash("w" + bare), _hash("h" + bare[:HEAD]) if len(bare) > HEAD else 0) if bare else (0, 0)
        if self.known is not None:
            names = tuple(self.known.get(name, -1) if name else -1 for name in names)
            if names == (-1, -1):
                self[word] = 0
                return 0
        self[word] = slot = len(self.pairs)
        self.pairs.append(names)
        return slot


class Reader:
    """Texts to (feature, count) arrays: all features by their hash, or known ones by their number."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known, self.slots = known, _Features(known)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > KNOWN_WORDS:
            self.slots = _Features(self.known)
        words = text.split()
        at, counts = np.unique(np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words)), return_counts=True)
        pairs = np.array([self.slots.pairs[i] for i in at.tolist()], np.int64).reshape(-1, 2)
        found, counts = pairs.ravel(), np.repeat(counts, 2)
        real = found >= 0 if self.known is not None else found != 0
        names, at = np.unique(found[real], return_inverse=True)
        return names, np.bincount(at, weights=counts[real], minlength=len(names)).astype(np.int64) if len(names) else np.zeros(0, np.int64)


    def marked(self, text: str) -> int:
        """How many words of a text have a known feature."""
        words = text.split()
        if len(self.slots) > KNOWN_WORDS:
            self.slots = _Features(self.known)
        return sum(self.slots[word] > 0 for word in words)


@dataclass
class OrdinalModel:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _seen(batches):
    """(text, above) to how many documents hold each feature, in all and above grade 0."""
    reader = Reader()
    for batch in batches:
        names, flags = [], []
        for text, above in zip(text_rows(batch.column(0)), batch.column(1).to_pylist()):
            found, _ = reader.of(text)
            names.append(found)
            flags.append(np.full(len(found), above, np.int64))
        names, at = np.unique(np.concatenate([*names, np.zeros(0, np.int64)]), return_inverse=True)
        flags = np.concatenate([*flags, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([
            pa.array(names), pa.array(np.bincount(at, minlength=len(names)).astype(np.int64)),
            pa.array(np.bincount(at, weights=flags, minlength=len(names)).astype(np.int64)),
        ], ["feature", "n", "n_above"])


def _counted(known: dict[int, int]):
    def run(batches):
        reader = Reader(known)
        for batch in batches:
            rows = [reader.of(text) for text in text_rows(batch.column(0))]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(2), pa.array([f.astype("<i4").tobytes() for f, _ in rows], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in rows], pa.binary()),
            ], ["grade", "weight", "at", "counts"])

    return run


def choose_features(sample: DataFrame, most: int = FEATURES) -> np.ndarray:
    """At most ``most`` features of (text, grade) whose share above grade 0 differs most from the sample's."""
    total = sample.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("bigint")).alias("above")).first()
    n, above = total["n"], total["above"] or 0
    if not 0 < above < n:
        return np.zeros(0, np.int64)
    share = above / n
    counts = map_batches(sample.select("text", (F.col("grade") > 0).cast("bigint").alias("above")), _seen, _SEEN)
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_above").alias("n_above")).where(F.col("n") >= SUPPORT)
    z = (F.col("n_above") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counts.withColumn("z", F.abs(z)).where(F.col("z") >= SPREAD).orderBy(F.desc("z"), "feature").limit(most)
    return np.array(sorted(r["feature"] for r in best.select("feature").collect()), np.int64)


def fit_ordinal(sample: DataFrame, features: np.ndarray | None = None, steps: int = 800, rate: float = 0.1, penalty: float = 1e-4) -> OrdinalModel:
    """Fit on (text, grade) with grades 0, 1, 2, ...; the caller bounds the sample.

    A column ``weight``, if there is one, says how many documents each row stands for.  Only the chosen features of the sample reach the driver.  Grades are renumbered without
    gaps.  With fewer than two grades the model has no features and predicts grade 0.
    """
    features = choose_features(sample) if features is None else features
    known = {int(f): i for i, f in enumerate(features)}
    weight = F.col("weight").cast("double") if "weight" in sample.columns else F.lit(1.0).alias("weight")
    rows = map_batches(sample.select("text", "grade", weight), _counted(known), "grade INT, weight DOUBLE, at BINARY, counts BINARY").collect() if known else []
    grades = np.array([r["grade"] for r in rows], np.int64)
    levels, y = np.unique(grades, return_inverse=True)
    if len(levels) < 2:
        return OrdinalModel(features[:0], np.zeros(0), np.array([20.0]))
    at = np.concatenate([np.frombuffer(r["at"], "<i4") for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) // 4 for r in rows])
    value = np.log1p(np.concatenate([np.frombuffer(r["counts"], "<i4") for r in rows]).astype(np.float64))
    # Parameters: weights, the first threshold, logarithms of the steps between thresholds.
    w, base, gaps = np.zeros(len(features)), 0.0, np.zeros(len(levels) - 2)
    n = len(rows)
    one, at_y = np.ones((n, 1)), (np.arange(n), y)
    share = np.array([r["weight"] for r in rows], np.float64)
    share = share / share.sum()
    moment = [np.zeros(len(w) + 1 + len(gaps)) for _ in range(2)]
    for step in range(1, steps + 1):
        thresholds = base + np.append(0, np.cumsum(np.exp(gaps)))
        score = np.bincount(row, weights=value * w[at], minlength=n)
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -50, 50)))
        # Likelihood of a grade: P(grade > y - 1) - P(grade > y), which is reached * (1 - passed) * apart.
        reached, passed = np.append(one, p, axis=1)[at_y], np.append(p, 0 * one, axis=1)[at_y]
        apart = np.concatenate([[1.0], -np.expm1(-np.diff(thresholds)), [1.0]])[y]
        by_row = (reached + passed - 1) * share
        grad_w = np.bincount(at, weights=value * by_row[row], minlength=len(w)) + penalty * w
        up, down = share * (1 - reached) / ((1 - passed) * apart), share * passed / (reached * apart)
        by_level = np.bincount(y, weights=up, minlength=len(levels))[1:] - np.bincount(y, weights=down, minlength=len(levels))[:-1]
        grad_gaps = np.exp(gaps) * np.cumsum(by_level[::-1])[::-1][1:]
        grad = np.concatenate([grad_w, [by_level.sum()], grad_gaps])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.999 * moment[1] + 0.001 * grad**2
        move = rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        w, base, gaps = w - move[: len(w)], base - move[len(w)], gaps - move[len(w) + 1 :]
    return OrdinalModel(features, w, base + np.append(0, np.cumsum(np.exp(gaps))))


def _scored(model: OrdinalModel):
    known = {int(f): i for i, f in enumerate(model.features)}

    def run(batches):
        reader = Reader(known)
        for batch in batches:
            score = np.array([
                float(np.log1p(counts) @ model.weights[at]) for at, counts in map(reader.of, text_rows(batch.column(1)))
            ], np.float64)
            above = model.above(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array((above > 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0])],
                ["row_id", "expected_severity", "grade", "p_toxic"],
            )

    return run


def accepted(docs: DataFrame, model: OrdinalModel, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are above grade 0 with a probability below ``limit``."""
    known = {int(f): i for i, f in enumerate(model.features)}
    at = docs.columns.index(text_col)

    def run(batches):
        reader = Reader(known)
        for batch in batches:
            score = [float(np.log1p(counts) @ model.weights[found]) for found, counts in map(reader.of, text_rows(batch.column(at)))]
            yield batch.filter(pa.array(model.above(np.array(score, np.float64))[:, 0] < limit))

    return map_batches(docs, run, docs.schema)


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, expected_severity, grade, p_toxic (above grade 0), one row per input row, no shuffle.

    A null or empty text has no features.  Repeated rows and null ids are kept; other columns
    are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, _scored(model), "row_id BIGINT, expected_severity DOUBLE, grade INT, p_toxic DOUBLE")


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(text, toxic, weight) of at most ``bound`` labelled documents, picked by a hash of their id.

    Up to half are toxic, up to half are not.  The weight is the number of labels of the row's side
    over the number picked of them, 1 if all are.  Documents without text, and labels that are null or
    contradict each other, are left out.  Copies would make any word of their text look telling,
    so of documents that share one of two smallest hashes of word triples one is kept.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high"))
    marks = marks.where("toxic = high").drop("high").withColumn("draw", F.xxhash64("doc_id"))
    sides = marks.agg(F.count_if(F.expr("toxic > 0")).alias("toxic"), F.count_if(F.expr("toxic = 0")).alias("other")).first()
    picked, most = None, bound // 2
    for side, labelled in ((marks.where("toxic > 0"), sides["toxic"]), (marks.where("toxic = 0"), sides["other"])):
        weight = F.lit(labelled / most if labelled > most > 0 else 1.0)
        part = side.orderBy("draw", "doc_id").limit(most).select(F.col("doc_id").alias("label_id"), "toxic", "draw", weight.alias("weight"))
        picked = part if picked is None else picked.unionByName(part)
    # At most ``bound`` rows of four numbers.
    met = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).where("text is not null")
    found = map_batches(met.select("text", F.col("toxic").cast("int").alias("toxic"), "draw", "weight"), _smallest, "text STRING, toxic INT, draw BIGINT, weight DOUBLE, m0 BIGINT, m1 BIGINT")
    for name in ("m0", "m1"):
        order = Window.partitionBy(name).orderBy("draw", "text")
        found = found.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")
    return found.select("text", "toxic", "weight")


def _smallest(batches):
    """Adds the smallest of two hashes of each text's word triples."""
    hashes = WordHashes()
    for batch in batches:
        words = Words([text.lower() for text in utf8_rows(batch.column(0))], hashes)
        sets = shingle_sets(words, 3)
        least = [[int(mix(s + np.uint64(seed)).min().view(np.int64)) if len(s) else seed for s in sets] for seed in range(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least[0], pa.int64()), pa.array(least[1], pa.int64())], ["text", "toxic", "draw", "weight", "m0", "m1"])


def graded(sample: DataFrame, scratch: Scratch, most: int = FEATURES) -> tuple[DataFrame, np.ndarray]:
    """Severity grades from yes/no labels, with the features chosen for them.

    The labels say whether a document is toxic, not how much.  Grade 0 is not toxic; toxic
    documents are graded 1, 2 or 3 by how many of their words have a feature which the labels mark as
    toxic: fewer than the first of ``MARKED``, than the second, or more.  It is a proxy, by which longer texts
    are graded higher; grades by the share of such words do not follow the features, and the fit then rejects fewer toxic
    documents.
    """
    stored = scratch.write(sample.withColumnRenamed("toxic", "grade"), "sample")
    features = choose_features(stored, most)
    one_sided = _toxic_side(stored, features)
    counted = map_batches(stored.select("text", "grade", "weight"), _hits(one_sided), "text STRING, grade INT, weight DOUBLE")
    return counted, features


def _toxic_side(sample: DataFrame, features: np.ndarray) -> set[int]:
    """Features with more documents above grade 0 than not, each row weighed."""
    known = {int(f): i for i, f in enumerate(features)}
    if not known:
        return set()
    counts = map_batches(sample.select("text", (F.col("grade") > 0).cast("bigint").alias("above")), _seen, _SEEN)
    wanted = sample.sparkSession.createDataFrame([(f,) for f in known], "feature BIGINT")
    counts = counts.join(F.broadcast(wanted), "feature").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_above").alias("n_above"))
    # All rows of a side weigh the same.
    above, other = sample.agg(F.max(F.when(F.col("grade") > 0, F.col("weight"))), F.max(F.when(F.col("grade") == 0, F.col("weight")))).first()
    return {r["feature"] for r in counts.where(F.col("n_above") * above > (F.col("n") - F.col("n_above")) * other).collect()}


def _hits(toxic: set[int]):
    known = {f: i for i, f in enumerate(sorted(toxic))}

    def run(batches):
        reader = Reader(known)
        for batch in batches:
            texts = text_rows(batch.column(0))
            marked = [reader.marked(text) for text in texts]
            grades = [0 if not grade else 1 + sum(n >= least for least in MARKED) for grade, n in zip(batch.column(1).to_pylist(), marked)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(grades, pa.int32()), batch.column(2)], ["text", "grade", "weight"])

    return run


def toxicity_model(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, most: int = FEATURES) -> OrdinalModel:
    """The model of ``docs``' labels, fitted on at most ``bound`` labelled documents and ``most`` features."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample, features = graded(labelled_sample(docs, labels, bound), scratch, most)
    model = fit_ordinal(sample, features)
    scratch.clear("sample")
    return model
