"""Rounding to a number of decimals by the exact binary value, ties to even.

Spark's ``bround`` and DuckDB's ``round_even`` round the shortest decimal text of a
double or its scaled product; scores that are halves of four-digit numbers then differ
in the last digit.  Here the double is split in two parts whose products with the scale
are exact, so the comparison with the midpoint is exact too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2^27 + 1


def exact_round(value: Column, digits: int) -> Column:
    """``value`` rounded half to even on its binary value.  Pass a plain column: it is used often."""
    scale = float(10**digits)
    low = F.floor(value * scale).cast("double")
    wide = value * _SPLITTER
    head = wide - (wide - value)
    over = (head * (2 * scale) - (low * 2.0 + 1.0)) + (value - head) * (2 * scale)
    up = (over > 0) | ((over == 0) & (low % 2 != 0))
    return F.when(up, low + 1.0).otherwise(low) / scale


def fixed_text(value: Column, digits: int) -> Column:
    """``value`` as text with that many decimals, rounded on its binary value."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))


def exact_round_sql(value: str, digits: int) -> str:
    """The same in SQL text, for the twins."""
    scale = 10**digits
    x = f"({value})"
    low = f"floor({x} * {scale}e0)"
    head = f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    over = f"(({head} * {2 * scale}e0 - ({low} * 2e0 + 1e0)) + ({x} - {head}) * {2 * scale}e0)"
    return (
        f"(CASE WHEN {over} > 0 OR ({over} = 0 AND {low} % 2 <> 0) THEN {low} + 1e0 ELSE {low} END / {scale}e0)"
    )
