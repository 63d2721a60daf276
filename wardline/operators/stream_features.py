"""Per-user features over trailing windows (login frequency, request rate, address changes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import risk
from wardline.functions.casts import seconds_to_micros
from wardline.functions.rounding import exact_round
from wardline.operators.slices import count_back, halo, halo_numbers, in_slice, numbered, own_rows

# Window lengths in seconds, saturation counts and the address ring size.
LOGIN_SPAN, LOGIN_FULL = 900, 15
REQUEST_SPAN, REQUEST_FULL = 60, 10
ADDRESS_RING = 20
FEATURE_ORDER = [
    "login_frequency",
    "ip_change_frequency",
    "request_rate",
    "severity_score",
    "hour_fraction",
    "minute_fraction",
    "is_after_hours",
    "source_auth",
    "source_network",
    "attack_weight",
]


def _named(df: DataFrame, user: str) -> DataFrame:
    return df.withColumn(user, F.coalesce(F.col(user), F.lit("unknown")))


def _saturating(count, full: int):
    return F.when(count.isNotNull(), F.bround(F.least(count / F.lit(float(full)), F.lit(1.0)), 4))


def activity_rates(
    df: DataFrame,
    user: str = "user_name",
    at: str = "at",
    tie: str = "seq",
    login_span: float = LOGIN_SPAN,
    request_span: float = REQUEST_SPAN,
    number: str | None = None,
) -> DataFrame:
    """Adds ``login_frequency`` and ``request_rate``: trailing event counts per user, saturating at 1.

    With ``number`` the user's row numbers come along under that name, at no further shuffle.
    """
    df = _named(df, user)
    login, request = seconds_to_micros(login_span), seconds_to_micros(request_span)
    width = 8 * max(login, request)
    wide = halo(df, at, max(login, request), width)
    if number:
        wide = halo_numbers(wide, df, [user], at, [tie], number, width)
    return own_rows(
        wide.withColumns(
            {
                "login_frequency": _saturating(count_back([user], at, [tie], login), LOGIN_FULL),
                "request_rate": _saturating(count_back([user], at, [tie], request), REQUEST_FULL),
            }
        )
    )


def ip_change_frequency(
    df: DataFrame,
    user: str = "user_name",
    address: str = "ip_address",
    at: str = "at",
    tie: str = "seq",
    ring: int = ADDRESS_RING,
    width: int = 3_600_000_000,
    rows_per_slice: int = 100_000,
    number: str | None = None,
) -> DataFrame:
    """Adds ``ip_change_frequency``: changes among the last ``ring`` addresses / (addresses - 1).

    Rows are numbered per user, then cut into runs of ``rows_per_slice`` rows, so that the
    ring of a busy user needs no single task.  ``number`` names a column that holds the numbers.
    """
    df = _named(df, user)
    ordered = df.withColumnRenamed(number, "_row") if number else numbered(df, [user], at, [tie], "_row", width)
    wide = halo(ordered, "_row", ring, max(rows_per_slice, ring))
    order = in_slice([user], "_row")
    known = F.coalesce(F.col(address), F.lit("unknown"))
    changed = wide.withColumn("_changed", F.when(known != F.lag(known).over(order), 1).otherwise(0))
    changes = F.sum("_changed").over(order.rowsBetween(-(ring - 2), 0))
    steps = F.least(F.col("_row"), F.lit(ring)) - 1
    # The first of the ring's rows has no earlier row inside the ring, hence ring - 1 flags.
    frequency = F.when(steps < 1, F.lit(0.0)).otherwise(F.bround(F.least(changes / steps, F.lit(1.0)), 4))
    return own_rows(changed.withColumn("ip_change_frequency", frequency)).drop("_row", "_changed")


def stream_features(
    df: DataFrame,
    user: str = "user_name",
    address: str = "ip_address",
    at: str = "at",
    tie: str = "seq",
    login_span: float = LOGIN_SPAN,
    request_span: float = REQUEST_SPAN,
) -> DataFrame:
    """Adds the ten online features of ``FEATURE_ORDER``."""
    rated = activity_rates(df, user, at, tie, login_span, request_span, number="_nth")
    moved = ip_change_frequency(rated, user, address, at, tie, number="_nth")
    clock = F.timestamp_micros(F.col(at))
    hour, minute = F.hour(clock), F.minute(clock)
    source = F.lower(F.coalesce(F.col("source"), F.lit("")))
    return moved.withColumns(
        {
            "severity_score": risk.severity_weight("severity"),
            "hour_fraction": F.bround(hour / F.lit(23.0), 4),
            "minute_fraction": F.bround(minute / F.lit(59.0), 4),
            "is_after_hours": F.when((hour < 6) | (hour > 20), 1.0).otherwise(0.0),
            "source_auth": (source == "auth").cast("double"),
            "source_network": (source == "network").cast("double"),
            "attack_weight": risk.attack_weight("attack_type"),
        }
    )


def user_behavior_score(login=None, change=None):
    """Half the login frequency plus half the address-change frequency, capped at 1."""
    login = F.col("login_frequency") if login is None else login
    change = F.col("ip_change_frequency") if change is None else change
    return exact_round(F.least(login * 0.5 + change * 0.5, F.lit(1.0)), 4)


def cold_start_score(severity="severity_score", rate="request_rate", attack="attack_weight"):
    """Score used before any online model exists."""
    raw = F.col(severity) * 0.35 + F.col(rate) * 0.25 + F.col(attack) * 0.40
    return F.bround(risk.clamp(raw, 0.0, 1.0), 4)
