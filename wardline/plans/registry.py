"""Named queries over the test tables, each with its plain-SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
TWINS: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(function: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"two plans are named {name}")
        PLANS[name] = function
        if sql is not None:
            TWINS[name] = sql
        return function

    return keep
