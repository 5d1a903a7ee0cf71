"""Places where a caller's own Python function joins a job, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: sequence ids and tokens of a batch -> rows (layer, neuron, seq_id, tokens, activations)
ActivationSource = Callable[[pd.DataFrame], pd.DataFrame]


def activations_with(sequences: DataFrame, source: ActivationSource) -> DataFrame:
    """An activation table from a function that scores sequences (seq_id, tokens)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield source(batch)

    return sequences.select("seq_id", "tokens").mapInPandas(
        run, "layer INT, neuron INT, seq_id BIGINT, tokens ARRAY<STRING>, activations ARRAY<DOUBLE>"
    )
