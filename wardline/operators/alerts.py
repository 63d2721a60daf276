"""Alert rows, response decisions and throttled delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import risk
from wardline.functions.fields import beside, coalesce_fields, field
from wardline.functions.rounding import fixed_text
from wardline.operators.throttle import throttle_rate
from wardline.session import stored

# Actions the response engine knows.
RESPONSE_ACTIONS = ["isolate_process", "block_ip", "kill_process"]


def alert_row(df: DataFrame, user: str = "user_name") -> DataFrame:
    """The alert projection of scored events."""
    return df.select(
        "event_id", "risk_score", "severity", "alert", "reason",
        field(df, "event_type", "unknown").alias("event_type"),
        field(df, "source", "unknown").alias("source"),
        F.coalesce(F.col(user), F.lit("unknown")).alias("user"),
        field(df, "attack_type", "none").alias("attack_type"),
    )


def recommended_action(df: DataFrame, severity: Column) -> Column:
    level = F.lower(severity)
    return (
        F.when(level == "critical", "kill_process")
        .when(level == "high", "isolate_host")
        .when(field(df, "attack_type", "").isin("brute_force", "privilege_escalation"), "block_ip")
        .otherwise("monitor")
    )


def alert_payload(df: DataFrame, user: str = "user_name") -> DataFrame:
    """Adds severity, description, action and the dedup key of an alert."""
    score = field(df, "risk_score", 0.0)
    severity = F.coalesce(F.col("severity"), risk.severity_band(score, risk.SCORING_BANDS)) if (
        "severity" in df.columns
    ) else risk.severity_band(score, risk.SCORING_BANDS)
    host = F.coalesce(
        F.nullif(coalesce_fields(df, ["host", "destination_host", "source_host", "remote_ip"]), F.lit("")),
        F.lit("unknown"),
    )
    description = F.concat(
        F.lit("Event type: "), field(df, "event_type", "unknown"),
        F.lit(" | Source: "), field(df, "source", "unknown"),
        F.lit(" | Attack type: "), F.coalesce(F.nullif(field(df, "attack_type", ""), F.lit("")), F.lit("unknown")),
        F.lit(" | MITRE technique: "), F.coalesce(F.nullif(field(df, "mitre_technique", ""), F.lit("")), F.lit("N/A")),
        F.lit(" | Risk score: "), fixed_text(score, 2),
    )
    shaped = df.withColumns(
        {
            "tenant_id": F.coalesce(F.nullif(field(df, "tenant_id", ""), F.lit("")), F.lit("default")),
            "severity": severity,
            "host": host,
            "user": F.coalesce(F.nullif(F.col(user), F.lit("")), F.lit("unknown")),
            "description": description,
        }
    )
    acted = shaped.withColumn("recommended_action", recommended_action(df, F.col("severity")))
    return acted.withColumn(
        "dedup_key", F.concat_ws(":", "tenant_id", "host", "user", "event_type", "recommended_action")
    )


def deliver_alerts(scored: DataFrame, user: str = "user_name", **options) -> DataFrame:
    """Risky rows as alerts with their delivery decision."""
    # The throttle reads its rows twice, and scores are dear to compute.
    risky = stored(scored.filter(F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)) >= 30))
    return throttle_rate(alert_payload(risky, user), **options)


def kill_switch_decision(alerts: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``switch_status`` from tenant policies (tenant_id, allowlist_actions, auto_response_allowed).

    A tenant without a policy uses the one named default; ``approved`` on the alert overrides.
    The policy table has a row per tenant; Spark broadcasts it when its size allows.
    """
    rules = policies.select(
        F.col("tenant_id").alias("_tenant"), F.col("allowlist_actions").alias("_allowed"),
        F.col("auto_response_allowed").alias("_auto"),
    )
    fallback = rules.filter("_tenant = 'default'").agg(
        F.first("_allowed").alias("_default_allowed"), F.first("_auto").alias("_default_auto")
    )
    joined = beside(alerts.join(rules, F.col("tenant_id") == F.col("_tenant"), "left"), fallback)
    allowed = F.coalesce("_allowed", "_default_allowed")
    auto = F.coalesce("_auto", "_default_auto", F.lit(False))
    approved = field(alerts, "approved", False)
    critical = F.lower("severity") == "critical"
    status = (
        F.when(~F.coalesce(F.array_contains(allowed, F.col("recommended_action")), F.lit(False)), "blocked")
        .when(~approved & critical & ~auto, "pending_approval")
        .when(approved | auto, "executed")
        .otherwise("skipped")
    )
    return joined.withColumn("switch_status", status).drop(
        "_tenant", "_allowed", "_auto", "_default_allowed", "_default_auto"
    )


def response_decision(requests: DataFrame, mode: str = "monitor") -> DataFrame:
    """Adds ``status`` to response requests; actions that are not known are left out."""
    known = requests.filter(F.col("action_type").isin(RESPONSE_ACTIONS))
    approved = field(requests, "approved", False)
    status = (
        F.when(approved, "approved_for_execution").otherwise("awaiting_approval")
        if mode == "active"
        else F.lit("logged_only")
    )
    return known.withColumns({"status": status, "execution_mode": F.lit(mode)})


def append_feedback(df: DataFrame) -> DataFrame:
    """Analyst feedback with one of the two allowed labels."""
    return df.filter(F.col("label").isin("false_positive", "confirmed_threat"))
