"""Incidents: risky events of one key, at most a gap apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import risk
from wardline.functions.casts import seconds_to_micros
from wardline.functions.fields import coalesce_fields, field
from wardline.functions.rounding import exact_round, fixed_text
from wardline.functions.times import iso_text
from wardline.operators.slices import sessions

# The gap that closes an incident, and the score that makes an event risky.
GAP_SECONDS = 600
RISKY = 30.0


def incident_attack_type(df: DataFrame) -> Column:
    """Attack word from type, message, triggers and anomaly score; the first match counts."""
    kind = F.lower(field(df, "event_type", ""))
    message = F.lower(field(df, "message", ""))
    triggers = F.lower(F.array_join("triggers", " ")) if "triggers" in df.columns else F.lit("")

    def has(text: Column, words: str) -> Column:
        return F.coalesce(F.contains(text, F.lit(words)), F.lit(False))

    return (
        F.when(has(kind, "login_failure") | has(message, "failed login"), "bruteforce")
        .when(has(message, "port") | has(triggers, "suspicious_port"), "port_scan")
        .when(has(kind, "process") | has(triggers, "unknown process"), "suspicious_process")
        .when(has(kind, "network") | has(triggers, "unusual network"), "lateral_movement")
        .when(field(df, "anomaly_score", 0.0) > 0.5, "anomaly")
        .otherwise("unknown")
    )


def incident_parts(df: DataFrame, user: str) -> tuple[Column, Column, Column]:
    """User, source and device that, after the attack type, make the key of an incident."""
    device = F.coalesce(coalesce_fields(df, ["device_id", "device"]), F.lit("unknown"))
    return F.coalesce(F.col(user), F.lit("unknown")), field(df, "source", "unknown"), device


def risky_events(df: DataFrame, user: str = "user_name") -> DataFrame:
    """Events that belong to an incident, with their ``incident_attack`` and ``incident_key``."""
    risky = df.filter(
        (F.coalesce(F.col("risk_score"), F.lit(0.0)) >= RISKY) | F.col("severity").isin("high", "critical")
    )
    attack = incident_attack_type(df)
    return risky.withColumns({"incident_attack": attack, "incident_key": F.concat_ws("|", attack, *incident_parts(df, user))})


def sessionize_incidents(
    df: DataFrame,
    gap: float = GAP_SECONDS,
    user: str = "user_name",
    at: str = "at",
    tie: str = "seq",
    width: int | None = None,
) -> DataFrame:
    """Risky events with ``incident_key``, ``session_start`` and ``incident_id``."""
    keyed = risky_events(df, user)
    cut = sessions(keyed, ["incident_key"], at, [tie], seconds_to_micros(gap), width)
    return cut.withColumn("incident_id", _incident_id())


def _incident_id() -> Column:
    return F.sha2(F.concat_ws("|", "incident_key", F.col("session_start").cast("string")), 256)


def incident_members(sessions_df: DataFrame) -> DataFrame:
    """(incident_id, event_id) pairs: the related-event list as rows, so no list can grow without bound."""
    return sessions_df.select("incident_id", "event_id").filter("event_id <> ''").distinct()


def incident_rollup(sessions_df: DataFrame, user: str = "user_name", at: str = "at") -> DataFrame:
    """One row per incident: span, peak risk, worst severity, counts, type and trigger sets, summary."""
    triggers = F.col("triggers") if "triggers" in sessions_df.columns else F.array().cast("array<string>")
    # Grouped by what the id is made of; the hash is taken once per incident, not per event.
    grouped = sessions_df.groupBy("incident_key", "session_start", "incident_attack").agg(
        F.min(at).alias("start_at"),
        F.max(at).alias("end_at"),
        F.first(user).alias("user"),  # part of the key, so one value
        F.first("source").alias("source"),
        F.max(risk.severity_rank("severity")).alias("_rank"),
        F.max(F.col("risk_score").cast("double")).alias("_peak"),
        F.count_distinct("event_id").alias("event_count"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(triggers)))).alias("triggers"),
    )
    return described(grouped)


def described(grouped: DataFrame, status: Column | None = None, *extra: str) -> DataFrame:
    """Incidents with id, severity, share and summary, from their counts; the columns of ``extra`` beside them."""
    shown = F.initcap(F.replace("incident_attack", F.lit("_"), F.lit(" ")))
    named = F.when(F.size("triggers") > 0, F.array_join("triggers", ", ")).otherwise("correlated anomalies")
    rolled = grouped.withColumns(
        {
            "severity": risk.severity_of_rank("_rank"),
            "_share": F.col("_peak") / 100.0,
        }
    )
    return rolled.select(
        _incident_id().alias("incident_id"),
        "incident_key",
        F.col("incident_attack").alias("attack_type"),
        "start_at",
        "end_at",
        "user",
        "source",
        "severity",
        (F.lit("open") if status is None else status).alias("status"),
        exact_round(F.col("_share"), 4).alias("risk_score"),
        "event_count",
        "event_types",
        "triggers",
        F.concat(
            shown,
            F.lit(" activity correlated for user "), F.col("user"), F.lit(". "),
            F.col("event_count").cast("string"),
            F.lit(" events were grouped between "), iso_text("start_at"),
            F.lit(" and "), iso_text("end_at"),
            F.lit(" with "), F.col("severity"),
            F.lit(" severity and peak risk score "), fixed_text(F.col("_peak"), 1),
            F.lit(". Indicators: "), named, F.lit("."),
        ).alias("summary"),
        *extra,
    )


def incident_events(members: DataFrame, events: DataFrame, incident_id: str) -> DataFrame:
    """The events of one incident."""
    wanted = members.filter(F.col("incident_id") == incident_id).select("event_id")
    return events.join(wanted, "event_id", "left_semi")
