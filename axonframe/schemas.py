"""Row shapes of the engine's tables and of the JSON files it reads and writes."""

from __future__ import annotations

#: One text sequence seen by one neuron.
RECORD = "STRUCT<tokens: ARRAY<STRING>, activations: ARRAY<DOUBLE>>"

#: One file per neuron.
NEURON_RECORD = f"""
    neuron_id STRUCT<layer_index: INT, neuron_index: INT>,
    random_sample ARRAY<{RECORD}>,
    random_sample_by_quantile ARRAY<ARRAY<{RECORD}>>,
    quantile_boundaries ARRAY<DOUBLE>,
    mean DOUBLE, variance DOUBLE, skewness DOUBLE, kurtosis DOUBLE,
    most_positive_activation_records ARRAY<{RECORD}>,
    dataclass_name STRING
"""

_SIMULATION = """tokens: ARRAY<STRING>, expected_activations: ARRAY<DOUBLE>, activation_scale: STRING,
    distribution_values: ARRAY<ARRAY<DOUBLE>>, distribution_probabilities: ARRAY<ARRAY<DOUBLE>>"""

#: A simulated sequence, after and (one level down) before calibration.
SIMULATION = f"STRUCT<{_SIMULATION}, uncalibrated_simulation: STRUCT<{_SIMULATION}>>"

#: One line per neuron with all its scored explanations.
EXPLANATIONS = f"""
    neuron_id STRUCT<layer_index: INT, neuron_index: INT>,
    scored_explanations ARRAY<STRUCT<
        explanation: STRING,
        scored_simulation: STRUCT<
            scored_sequence_simulations: ARRAY<STRUCT<
                simulation: {SIMULATION},
                true_activations: ARRAY<DOUBLE>,
                ev_correlation_score: DOUBLE, rsquared_score: DOUBLE, absolute_dev_explained_score: DOUBLE>>,
            ev_correlation_score: DOUBLE, rsquared_score: DOUBLE, absolute_dev_explained_score: DOUBLE>>>,
    dataclass_name STRING
"""

_WEIGHTS = "STRUCT<tokens: ARRAY<STRING>, strengths: ARRAY<DOUBLE>>"

#: Tokens with the largest input and output weights of one neuron.
TOKEN_WEIGHTS = f"""
    input_positive {_WEIGHTS}, input_negative {_WEIGHTS},
    output_positive {_WEIGHTS}, output_negative {_WEIGHTS}, dataclass_name STRING
"""

#: Tokens with the highest average activation of one neuron, highest first.
TOKEN_AVERAGES = "tokens ARRAY<STRING>, average_activations ARRAY<DOUBLE>, dataclass_name STRING"

_RELATED = """STRUCT<top_positive_neurons: ARRAY<STRING>, top_positive_weights: ARRAY<DOUBLE>,
    top_negative_neurons: ARRAY<STRING>, top_negative_weights: ARRAY<DOUBLE>>"""

#: Connected neurons: ``c_fc`` is the input direction, ``c_proj`` the output direction.
RELATED_NEURONS = f"c_proj {_RELATED}, c_fc {_RELATED}"

#: A chat-style prompt.
MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"

#: A completion with per-token log probabilities.
RESPONSE = """STRUCT<choices: ARRAY<STRUCT<
    text: STRING,
    message: STRUCT<content: STRING>,
    logprobs: STRUCT<tokens: ARRAY<STRING>, top_logprobs: ARRAY<MAP<STRING, DOUBLE>>, text_offset: ARRAY<INT>>>>>"""

# Names of the two activation units.
NEURON_SCALE = "neuron_activations"
SIMULATED_SCALE = "simulated_normalized_activations"
ACTIVATION_SCALES = (NEURON_SCALE, SIMULATED_SCALE)

#: Key of one neuron in every table.
NEURON = ["layer", "neuron"]


def check_choice(name: str, value: str, allowed: tuple[str, ...]) -> str:
    """Reject an option before any plan is built."""
    if value not in allowed:
        raise ValueError(f"{value!r} is not a valid {name}; expected one of {', '.join(allowed)}")
    return value
