"""Severity bands, weights and clamps used by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.casts import as_column
from wardline.functions.lookup import lookup

# Lower bounds of critical, high and medium, one set per operator family.
EVENT_BANDS = (85.0, 60.0, 30.0)
SCORING_BANDS = (80.0, 60.0, 30.0)

# Severity and attack weights of the stream, scoring, feature,
# chain and heat-map operators.
STREAM_SEVERITY = {"low": 0.25, "medium": 0.5, "high": 0.8, "critical": 1.0}
FEATURE_SEVERITY = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
CHAIN_SEVERITY = {"low": 2.0, "medium": 8.0, "high": 15.0, "critical": 25.0}
STREAM_ATTACK = {"brute_force": 0.5, "ddos": 0.75, "insider_threat": 1.0, "insider": 1.0}
SCORING_ATTACK = {"brute_force": 2.0, "ddos": 3.0, "insider_threat": 4.0, "insider": 4.0}
SEVERITIES = ["low", "medium", "high", "critical"]


def severity_band(score: str | Column, bands: tuple[float, float, float] = EVENT_BANDS) -> Column:
    value = as_column(score)
    critical, high, medium = bands
    return (
        F.when(value >= critical, "critical")
        .when(value >= high, "high")
        .when(value >= medium, "medium")
        .otherwise("low")
    )


def severity_rank(severity: str | Column) -> Column:
    """0 low .. 3 critical; null for other words."""
    return lookup({word: rank for rank, word in enumerate(SEVERITIES)}, severity)


def severity_of_rank(rank: str | Column, default: str = "low") -> Column:
    return lookup(dict(enumerate(SEVERITIES)), as_column(rank).cast("int"), default)


def severity_weight(severity: str | Column, table=STREAM_SEVERITY, default: float = 0.25) -> Column:
    return lookup(table, F.lower(as_column(severity)), default)


def attack_weight(attack: str | Column, table=STREAM_ATTACK) -> Column:
    return lookup(table, F.lower(as_column(attack)), 0.0)


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(value, F.lit(float(high))))
