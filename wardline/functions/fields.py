"""Optional input columns, decided when the plan is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {bool: "boolean", str: "string", int: "int", float: "double"}


def field(df: DataFrame, name: str, default) -> Column:
    """Column ``name`` with ``default`` for nulls, or the default alone when there is no such column."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).try_cast(_KINDS[type(default)]), F.lit(default))


def first_field(df: DataFrame, names: list[str], default=None) -> Column:
    """The first column of ``names`` the frame has (whatever it holds), else the default."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(default)


def coalesce_fields(df: DataFrame, names: list[str], default=None) -> Column:
    """First non-null value among the columns of ``names`` the frame has."""
    present = [F.col(name).cast("string") for name in names if name in df.columns]
    return F.coalesce(*present, F.lit(default)) if present else F.lit(default).cast("string")


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def beside(df: DataFrame, single: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row frame: a scalar subquery, evaluated once, and no join."""
    names = single.columns
    value = single.select(F.struct(*names).alias("_one")).scalar()
    added = df.withColumn("_one", value)
    return added.select(*df.columns, *[F.col("_one")[name].alias(name) for name in names])
