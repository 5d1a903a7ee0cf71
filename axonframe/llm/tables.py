"""Intermediate tables in the shared folder, and Arrow batches of documents."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from axonframe.session import shared_dir

#: Arrow batches that Python tasks read: bounded by bytes, so that narrow rows come in many and long texts in few.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 65_536

#: Text whose words are in memory at once, where a batch is worked off in pieces.
PIECE_BYTES = 1 << 20


class Scratch:
    """Tables written once to the shared folder and read back.

    A written table cuts the lineage: a lost executor costs only its own tasks, and nothing is
    computed twice.  ``clear`` replaces tables that nothing needs any more by empty ones.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/axonframe-llm-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *names: str) -> None:
        for name in names:
            path = f"{self.folder}/{name}"
            schema = self.spark.read.parquet(path).schema
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the user has chosen other sizes than Spark's."""
    for key, default, chosen in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(BATCH_BYTES)),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
    ):
        if spark.conf.get(key) == default:
            spark.conf.set(key, chosen)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and wait with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # Only some C libraries have it.
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    bounded_batches(df.sparkSession)

    def run_and_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(run_and_give_back, schema)


def text_pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a text column with about ``PIECE_BYTES`` each; a longer text is one by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(texts):
        reach = (ends[start - 1] if start else 0) + PIECE_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, reach, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def utf8_rows(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; a null text is empty."""
    return [b"" if text is None else text for text in column.cast(pa.binary()).to_pylist()]


def text_rows(column: pa.Array) -> list[str]:
    return ["" if text is None else text for text in column.to_pylist()]
