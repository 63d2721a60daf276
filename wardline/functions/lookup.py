"""Small fixed tables as map literals, so a lookup needs no join."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.casts import as_column


def map_literal(table: Mapping) -> Column:
    return F.create_map(*[F.lit(item) for item in chain.from_iterable(table.items())])


def lookup(table: Mapping, key: str | Column, default=None) -> Column:
    """Value of ``key`` in ``table``; ``default`` when the key is null or absent."""
    found = F.try_element_at(map_literal(table), as_column(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def reasons(*tests: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    texts = [
        F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in tests
    ]
    return F.array_compact(F.array(*texts))


def points(*tests: tuple[Column, float]) -> Column:
    """Sum of the weights whose condition holds, added from left to right."""
    total = F.lit(0.0)
    for test, weight in tests:
        total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def capped(value: Column, top: float = 1.0) -> Column:
    return F.least(value, F.lit(float(top)))
