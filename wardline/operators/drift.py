"""Drift of a predictor: recent against longer-run error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.rounding import exact_round
from wardline.operators.slices import HOUR, halo, in_slice, numbered, own_rows

# Window sizes, error margin.
BASELINE_ROWS, RECENT_ROWS, MARGIN = 100, 25, 0.20


def drift(
    df: DataFrame,
    expected: str = "label",
    predicted: str = "predicted",
    keys: tuple[str, ...] = (),
    at: str = "at",
    tie: str = "seq",
    baseline: int = BASELINE_ROWS,
    recent: int = RECENT_ROWS,
    margin: float = MARGIN,
    width: int = HOUR,
    rows_per_slice: int = 100_000,
) -> DataFrame:
    """Adds ``baseline_error``, ``recent_error`` and ``drift_detected`` per row in time order."""
    keys = list(keys)
    wrong = F.when(F.col(expected) == F.col(predicted), 0.0).otherwise(1.0)
    ordered = numbered(df.withColumn("_wrong", wrong), keys, at, [tie], "_row", width)
    wide = halo(ordered, "_row", baseline, max(rows_per_slice, baseline))
    order = in_slice(keys, "_row")
    errors = wide.withColumns(
        {
            "_base": F.avg("_wrong").over(order.rowsBetween(-(baseline - 1), 0)),
            "_late": F.avg("_wrong").over(order.rowsBetween(-(recent - 1), 0)),
        }
    )
    enough = (F.least(F.col("_row"), F.lit(baseline)) >= max(10, baseline // 2)) & (
        F.least(F.col("_row"), F.lit(recent)) >= max(5, recent // 2)
    )
    flagged = errors.withColumns(
        {
            "drift_detected": enough & (F.col("_late") > F.col("_base") + margin),
            "baseline_error": exact_round(F.col("_base"), 4),
            "recent_error": exact_round(F.col("_late"), 4),
        }
    )
    return own_rows(flagged).drop("_row", "_wrong", "_base", "_late")
