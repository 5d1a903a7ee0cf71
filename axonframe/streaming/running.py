"""Per-neuron summaries and progress counts over a stream of activation records.

A stream has the columns of an activation table (layer, neuron, seq_id, tokens, activations),
with seq_id growing in arrival order.  Each batch writes its own partial results below its
batch number, so its cost follows the batch and a replayed batch replaces itself.  Readers
merge the partial results with the operators that merge shards.  Older results are folded into
one, so reading does not grow with the number of batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from axonframe.functions.arrays import record_score
from axonframe.functions.draws import draw
from axonframe.operators.merge import merge_lists
from axonframe.operators.records import SEED, merge_moments, moments
from axonframe.operators.scale import top_rows
from axonframe.schemas import NEURON


#: Batches between two foldings of the partial results.
FOLD_EVERY = 16


def write_batch(batch: DataFrame, path: str, batch_id: int, k: int, sample_size: int, seed: int = SEED) -> None:
    """The strongest records, sample and moments of one batch, in place of what the batch wrote before.

    The 2k strongest are kept, the earliest first: from these of all batches the bounded heap of
    one pass follows exactly, ties included.
    """
    kept = batch.persist()
    fresh = kept.select(*NEURON, "seq_id", record_score(F.col("activations")).alias("score"), "tokens", "activations")
    both = _kept_rows(fresh.where(F.size("activations") > 0), fresh, k, sample_size, seed)
    both.write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
    moments(kept).select(*NEURON, "n_values", "mean", "m2").write.mode("overwrite").parquet(f"{path}/stats/batch={batch_id}")
    kept.unpersist()


def _kept_rows(scored: DataFrame, drawn: DataFrame, k: int, sample_size: int, seed: int) -> DataFrame:
    """What stays of a batch or of several: strongest and sampled records, with the numbers asked for."""
    strongest = top_rows(scored, NEURON, [F.col("score").desc(), F.col("seq_id")], 2 * k)
    drawn = drawn.withColumn("_draw", draw(seed, *NEURON, "seq_id"))
    sampled = top_rows(drawn, NEURON, [F.col("_draw"), F.col("seq_id")], sample_size).drop("_draw")
    both = strongest.withColumn("kind", F.lit("top")).unionByName(sampled.withColumn("kind", F.lit("random")))
    return both.withColumns({"kept_k": F.lit(k), "kept_sample": F.lit(sample_size), "seed": F.lit(seed)})


def _folded_upto(spark: SparkSession, path: str) -> int | None:
    """The last batch that is part of a finished folding."""
    try:
        return spark.read.parquet(f"{path}/folded/done").agg(F.max("upto")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _parts(spark: SparkSession, path: str, name: str, upto: int | None = None) -> DataFrame:
    """The last finished folding and the batches after it, up to batch ``upto`` if that is given."""
    done = _folded_upto(spark, path)
    rows = spark.read.parquet(f"{path}/{name}")
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    if done is None:
        return rows.drop("batch")
    later = rows.where(F.col("batch") > done).drop("batch")
    return later.unionByName(spark.read.parquet(f"{path}/folded/{name}/upto={done}"))


def _limits(rows: DataFrame) -> tuple[int, int, int] | None:
    """The smallest k and sample size that any part was kept with, and the seed; NULL without rows."""
    found = rows.agg(F.min("kept_k"), F.min("kept_sample"), F.min("seed")).first()
    return None if found[0] is None else tuple(found)


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Merge the partial results of all batches up to ``upto`` into one, so that readers skip them.

    The result has a folder of its own; a mark that is written last makes it valid at once for
    records and moments.  A folding that was cut short has no mark and is done again.  Folders of
    folded batches are not read any more and may be deleted.
    """
    if (done := _folded_upto(spark, path)) is not None and done >= upto:
        return
    rows = _parts(spark, path, "records", upto)
    limits = _limits(rows)
    if limits is not None:
        side = lambda kind: rows.where(F.col("kind") == kind).drop("kind", "rank", "kept_k", "kept_sample", "seed")
        rows = _kept_rows(side("top"), side("random"), *limits)
    rows.write.mode("overwrite").parquet(f"{path}/folded/records/upto={upto}")
    merged = merge_moments(_parts(spark, path, "stats", upto)).select(*NEURON, "n_values", "mean", "m2")
    merged.write.mode("overwrite").parquet(f"{path}/folded/stats/upto={upto}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/folded/done/upto={upto}")


def start_running_summary(
    stream: DataFrame, path: str, checkpoint_path: str, k: int = 100, sample_size: int = 50,
    fold_every: int = FOLD_EVERY, **trigger
) -> StreamingQuery:
    """Keep moments, top records and a uniform sample per neuron up to date.

    Every ``fold_every`` batches those before the current one, which are committed and never
    replayed, are folded into one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id, k, sample_size)
        if batch_id and batch_id % fold_every == 0:
            fold(batch.sparkSession, path, batch_id - 1)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint_path)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_records(spark: SparkSession, path: str, k: int = 100, sample_size: int = 50) -> DataFrame:
    """Top records and sample over all batches; asking for more than a batch kept fails."""
    rows = _parts(spark, path, "records")
    limits = _limits(rows)
    if limits is not None and (k > limits[0] or sample_size > limits[1]):
        raise ValueError(f"the batches kept {limits[0]} top records and {limits[1]} sampled ones, not {k} and {sample_size}")
    side = lambda kind: rows.where(F.col("kind") == kind).drop("kind", "rank", "kept_k", "kept_sample", "seed")
    return merge_lists(side("top"), side("random"), k, sample_size)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Moments over all batches."""
    return merge_moments(_parts(spark, path, "stats"))


def start_progress(
    stream: DataFrame, out_path: str, checkpoint_path: str, time: str = "ts", every: str = "1 minute", **trigger
) -> StreamingQuery:
    """Records per time window.  Each batch writes its own counts, so no row is too late."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window(time, every).alias("w")).agg(F.count("*").alias("n"))
        counts.select(F.col("w.start").alias("minute"), "n").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (
        timed.writeStream.option("checkpointLocation", checkpoint_path)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_progress(spark: SparkSession, out_path: str) -> DataFrame:
    """The count of every window over all batches."""
    return spark.read.parquet(out_path).groupBy("minute").agg(F.sum("n").alias("n"))
