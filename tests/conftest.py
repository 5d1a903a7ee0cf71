import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from axonframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           # Small data would end up in one partition and hide partitioning mistakes.
           "spark.sql.adaptive.coalescePartitions.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ACTS = "layer INT, neuron INT, seq_id BIGINT, tokens ARRAY<STRING>, activations ARRAY<DOUBLE>"


@pytest.fixture(scope="session")
def make_acts(spark):
    """Activation table from {(layer, neuron): [activations, ...]}; sequence numbers follow list order."""

    def build(lists, partitions=5):
        rows = [
            (layer, neuron, i, [f"t{j}" for j in range(len(a))], [float(x) for x in a])
            for (layer, neuron), arrays in lists.items()
            for i, a in enumerate(arrays)
        ]
        return spark.createDataFrame(rows, ACTS).repartition(partitions)

    return build
