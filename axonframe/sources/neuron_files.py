"""A Spark data source that writes one named file per neuron: ``<layer>/<neuron>.json``.

Spark's own writers choose file names.  Here every task writes the files of its rows under a
hidden name and moves each to its place when it is complete, so a task that is lost or runs
twice leaves whole files with equal content.  ``_SUCCESS`` follows when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from axonframe.schemas import NEURON

FORMAT = "neuron_files"


def _place(path: str):
    """The file system and folder of a path or address."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class NeuronFileWriter(DataSourceArrowWriter):
    """Rows (layer, neuron, value), sorted by their key, to files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = _place(self.path)
        layers: set[int] = set()
        last = None
        for batch in iterator:
            for layer, neuron, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (layer, neuron) == last:
                    raise ValueError(f"two records of neuron {neuron} in layer {layer}")
                last = layer, neuron
                if layer not in layers:
                    files.create_dir(f"{folder}/{layer}", recursive=True)
                    layers.add(layer)
                hidden = f"{folder}/{layer}/.{neuron}.{uuid.uuid4().hex}"
                with files.open_output_stream(hidden) as out:
                    out.write(value.encode())
                files.move(hidden, f"{folder}/{layer}/{neuron}.json")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _place(self.path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/_SUCCESS"):
            pass


class NeuronFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "layer INT, neuron INT, value STRING"

    def writer(self, schema: StructType, overwrite: bool) -> NeuronFileWriter:
        return NeuronFileWriter(self.options["path"])


def write_neuron_files(neurons: DataFrame, path: str) -> None:
    """Write each neuron's record to ``<path>/neurons/<layer>/<neuron>.json``.

    ``path`` is a folder that all executors reach.  Rows need layer and neuron; two rows of one
    neuron fail.  Undefined moments are written as JSON null.  Files of other neurons that are
    there already stay.
    """
    neurons.sparkSession.dataSource.register(NeuronFiles)
    fields = [c for c in neurons.columns if c not in NEURON]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    rows = neurons.select(*[F.col(c).cast("int") for c in NEURON], text)
    # Equal keys meet in one task, where the second is noticed.
    rows.repartition(*NEURON).sortWithinPartitions(*NEURON).write.format(FORMAT).mode("append").save(f"{path}/neurons")
