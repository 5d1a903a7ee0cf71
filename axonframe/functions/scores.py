"""Score functions as aggregate expressions over (real, predicted) value columns.

``SCORES`` maps a name to ``f(real, predicted) -> aggregate Column``; callers may pass their
own mapping to add or replace scores.  Undefined scores are NaN, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def correlation(real: Column, predicted: Column) -> Column:
    """Pearson correlation; NaN when either side is constant, NULL when there are no values."""
    varies = (F.max(real) > F.min(real)) & (F.max(predicted) > F.min(predicted))
    ratio = F.try_divide(
        F.covar_pop(real, predicted), F.stddev_pop(real) * F.stddev_pop(predicted)
    )
    return F.when(F.count(real) == 0, F.lit(None).cast("double")).when(varies, F.coalesce(ratio, F.lit(NAN))).otherwise(NAN)


def explained(error: Column, scale: Column) -> Column:
    """1 - error / scale, with the limits of floating-point division by zero."""
    undefined = F.coalesce(error, F.lit(0.0)) == 0
    return (
        F.when(F.coalesce(scale, F.lit(0.0)) > 0, F.lit(1.0) - F.try_divide(error, scale))
        .when(undefined, F.lit(NAN))
        .otherwise(F.lit(float("-inf")))
    )


def rsquared(real: Column, predicted: Column) -> Column:
    """1 - mean squared error / mean square of the real values (not centred)."""
    error = real - predicted
    return explained(F.avg(error * error), F.avg(real * real))


def absolute_dev_explained(real: Column, predicted: Column) -> Column:
    """1 - mean absolute error / mean absolute real value."""
    return explained(F.avg(F.abs(real - predicted)), F.avg(F.abs(real)))


SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "ev_correlation_score": correlation,
    "rsquared_score": rsquared,
    "absolute_dev_explained_score": absolute_dev_explained,
}
