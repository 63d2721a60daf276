"""Total casts: a bad value becomes a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as true, and the default of each type.
TRUE_WORDS = ["1", "true", "yes", "y", "on"]
TYPE_DEFAULTS = {"string": "", "int": 0, "bigint": 0, "double": 0.0, "boolean": False}


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: str | Column) -> Column:
    """Text or number to double; null when it is no number."""
    return as_column(value).try_cast("double")


def safe_cast(value: str | Column, kind: str) -> Column:
    """Cast to ``kind`` with that type's default for null and unreadable values."""
    source = as_column(value)
    default = F.lit(TYPE_DEFAULTS[kind])
    if kind == "boolean":
        return F.coalesce(F.lower(F.trim(source.cast("string"))).isin(TRUE_WORDS), default)
    if kind in ("int", "bigint"):
        # 2^53 and larger stay exact through the integer cast; "3.7" goes through double.
        return F.coalesce(source.try_cast(kind), number(source).try_cast(kind), default.cast(kind))
    return F.coalesce(source.try_cast(kind), default)


def instant(value: str | Column) -> Column:
    """ISO text (``Z`` or offset allowed) to timestamp, null when unreadable."""
    return F.try_to_timestamp(F.trim(as_column(value).cast("string")))


def micros(value: str | Column) -> Column:
    return F.unix_micros(as_column(value))


def seconds_to_micros(value: float) -> int:
    return int(round(value * 1_000_000))
