"""Rules and scores: event columns in, scores, severities and reasons out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import risk
from wardline.functions.casts import seconds_to_micros
from wardline.functions.fields import field, sorted_set
from wardline.functions.lookup import capped, lookup, points, reasons
from wardline.functions.rounding import exact_round, fixed_text
from wardline.operators.slices import count_back, halo, own_rows

# Burst rule.
BURST_SPAN, BURST_SIZE, BURST_SCORE = 900, 5, 0.2

# Points of the request rules, in the order their names are listed.
REQUEST_RULES = {
    "failed_logins>3": 20,
    "unusual_location": 25,
    "unusual_time": 15,
    "sensitive_file_access": 30,
    "bulk_download": 25,
    "privilege_escalation": 40,
}

# Response texts by score.
ASSESS_ACTIONS = ("Block process (simulation only)", "Restrict actions (log only)", "Alert", "Monitor")
ANALYZE_ACTIONS = (
    "Block sensitive actions and downloads",
    "Restrict sensitive actions",
    "Alert SOC analyst",
    "Monitor",
)


def behavioral_reasons(df: DataFrame) -> Column:
    """Reasons from failure counts, address changes and access times."""
    return reasons(
        (field(df, "login_failure_count", 0.0) >= 5, "login_anomaly"),
        (field(df, "ip_change_frequency", 0.0) >= 0.5, "ip_change_detected"),
        (field(df, "access_time_anomaly", False), "access_time_violation"),
    )


def risk_score(df: DataFrame) -> DataFrame:
    """Adds the weighted 0-100 score with severity, alert flag, reasons and components."""
    ml = field(df, "ml_score", 0.0)
    behavior = field(df, "user_behavior_score", 0.0)
    severity = risk.severity_weight(field(df, "severity", "low"))
    attack_name = F.lower(field(df, "attack_type", "none"))
    attack = lookup(risk.SCORING_ATTACK, attack_name, 0.0)
    frequency = field(df, "frequency", 0.0) if "frequency" in df.columns else field(df, "request_rate", 0.0)
    # Truncated to a whole number before the bands are applied.
    score = risk.clamp(ml * 40.0 + behavior * 30.0 + severity * 20.0 + attack * 10.0).cast("int")
    found = F.concat(
        behavioral_reasons(df),
        reasons(
            (ml >= 0.7, "ml_anomaly"),
            (behavior >= 0.5, "ueba_deviation"),
            (attack > 0, F.concat(attack_name, F.lit("_detected"))),
            (frequency >= 0.7, "frequency_spike"),
        ),
    )
    scored = df.withColumns(
        {
            "component_ml": F.bround(ml, 4),
            "component_behavior": F.bround(behavior, 4),
            "component_severity": F.bround(severity, 4),
            "component_attack": F.bround(attack, 4),
            "reason": sorted_set(found),
            "risk_score": score,
        }
    )
    return scored.withColumns(
        {
            "severity": risk.severity_band("risk_score", risk.SCORING_BANDS),
            "alert": F.col("risk_score") >= 30,
        }
    )


def failed_login_burst(
    df: DataFrame,
    user: str = "user_name",
    at: str = "at",
    tie: str = "seq",
    span: float = BURST_SPAN,
    size: int = BURST_SIZE,
) -> DataFrame:
    """Adds ``failures_in_window`` and ``burst`` (on failure rows only).

    Only failure rows are shuffled; all other rows pass straight through.
    """
    back = seconds_to_micros(span)
    df = df.withColumn(user, F.coalesce(F.col(user), F.lit("unknown")))
    failure = F.col("event_type") == "login_failure"
    failures = halo(df.filter(failure), at, back).withColumn(
        "failures_in_window", count_back([user], at, [tie], back)
    )
    counted = own_rows(failures)
    others = df.filter(~F.coalesce(failure, F.lit(False))).withColumn(
        "failures_in_window", F.lit(0).cast("bigint")
    )
    return counted.unionByName(others).withColumn("burst", F.col("failures_in_window") >= size)


def rule_score(df: DataFrame) -> DataFrame:
    """Adds ``rule_score`` and ``rule_reasons`` to rows that carry ``burst``."""
    attack = lookup(risk.SCORING_ATTACK, F.lower(field(df, "attack_type", "none")), 0.0)
    score = points((F.col("burst"), BURST_SCORE)) + F.least(attack * 0.1, F.lit(0.4))
    found = F.concat(behavioral_reasons(df), reasons((F.col("burst"), "failed login burst")))
    return df.withColumns({"rule_score": capped(score), "rule_reasons": sorted_set(found)})


def response_action(score: str | Column, actions=ASSESS_ACTIONS) -> Column:
    value = F.col(score) if isinstance(score, str) else score
    block, restrict, alert, watch = actions
    return (
        F.when(value >= 85, block).when(value >= 60, restrict).when(value >= 30, alert).otherwise(watch)
    )


def activity_story(df: DataFrame, triggers: Column, action: Column, severity: Column) -> Column:
    """One sentence on what was seen, where, with which indicators and what to do."""
    subject = F.lit(None).cast("string")
    for name in ("process_name", "event_type"):
        if name in df.columns:
            subject = F.coalesce(subject, F.nullif(F.col(name), F.lit("")))
    path, address = field(df, "path", ""), field(df, "remote_ip", "")
    parts = F.concat_ws(
        " ",
        F.concat(F.coalesce(subject, F.lit("activity")), F.lit(" was observed")),
        F.when(path != "", F.concat(F.lit("touching "), path)),
        F.when(address != "", F.concat(F.lit("connecting to "), address)),
        F.when(
            F.size(triggers) > 0,
            F.concat(F.lit("with indicators including "), F.array_join(triggers, ", ")),
        ),
    )
    return F.concat(
        parts,
        F.lit(", leading to a "),
        severity,
        F.lit(" risk classification. Recommended response: "),
        F.lower(action),
        F.lit("."),
    )


def heuristic_scores(df: DataFrame) -> DataFrame:
    """Adds model-free ``heuristic_probability`` and ``heuristic_anomaly``."""
    process, address = field(df, "unknown_process", False), field(df, "unusual_network_ip", False)
    port, file = field(df, "suspicious_port", False), field(df, "sensitive_file_access", False)
    failure = field(df, "event_type", "") == "login_failure"
    probability = points((process, 0.35), (address, 0.25), (file, 0.25), (failure, 0.15))
    anomaly = points((process, 0.30), (port, 0.30), (address, 0.20), (file, 0.20))
    return df.withColumns(
        {"heuristic_probability": capped(probability), "heuristic_anomaly": capped(anomaly)}
    )


def assess(df: DataFrame) -> DataFrame:
    """Full assessment of rows that carry model scores, the rule result and the deviation result.

    Needs ``ml_prediction_score``, ``anomaly_score``, ``rule_score``, ``rule_reasons``,
    ``behavior_score`` and ``behavior_reasons``.
    """
    fed = df.withColumns(
        {
            "ml_score": F.col("ml_prediction_score"),
            "user_behavior_score": F.col("behavior_score"),
            "frequency": F.least(F.col("rule_score") + F.col("anomaly_score"), F.lit(1.0)),
        }
    )
    scored = risk_score(fed)
    triggers = sorted_set(F.concat("rule_reasons", "behavior_reasons", "reason"))
    action = response_action("risk_score")
    return scored.withColumns(
        {
            "triggers": triggers,
            "response_action": action,
            "rule_engine_score": F.bround("rule_score", 4),
            "ml_prediction": F.bround("ml_prediction_score", 4),
        }
    ).withColumn(
        "story", activity_story(df, F.col("triggers"), F.col("response_action"), F.col("severity"))
    )


def analyze(df: DataFrame) -> DataFrame:
    """Request scoring: model scores and behaviour on 0-100, then the rule points."""
    supervised, anomaly = field(df, "supervised_probability", 0.0), field(df, "anomaly_score", 0.0)
    behavior = field(df, "behavior_deviation_score", 0.0)
    held = {
        name: field(df, "failed_logins", 0) > 3 if name.startswith("failed") else field(df, name, False)
        for name in REQUEST_RULES
    }
    adjustment = sum(
        (F.when(held[name], F.lit(weight)).otherwise(F.lit(0)) for name, weight in REQUEST_RULES.items()),
        F.lit(0),
    )
    own = reasons(*[(held[name], name) for name in REQUEST_RULES])
    rules = F.concat(own, F.col("behavior_reasons")) if "behavior_reasons" in df.columns else own
    base = risk.clamp((supervised * 0.6 + anomaly * 0.4 + behavior) * 100.0)
    scored = df.withColumns(
        {
            "rule_adjustment": adjustment,
            "triggered_rules": rules,
            "_score": risk.clamp(base + adjustment),
        }
    )
    listed = F.when(F.size("triggered_rules") > 0, F.array_join("triggered_rules", ", ")).otherwise(
        "no explicit SOC rules triggered"
    )
    return scored.withColumns(
        {
            "risk_score": exact_round(F.col("_score"), 2),
            "severity": risk.severity_band("_score"),
            "response_action": response_action("_score", ANALYZE_ACTIONS),
            "explanation": F.concat(
                F.lit("Supervised model confidence="), fixed_text(supervised, 2),
                F.lit(", anomaly score="), fixed_text(anomaly, 2),
                F.lit(", behavior deviation="), fixed_text(behavior, 2),
                F.lit(", rule adjustment="), F.col("rule_adjustment").cast("string"),
                F.lit(". Triggered indicators: "), listed, F.lit("."),
            ),
        }
    ).withColumn("incident_story", incident_story(df)).drop("_score")


def incident_story(df: DataFrame) -> Column:
    """Two-sentence text for an analysed request."""
    user = field(df, "user_id", "")
    subject = F.when(user != "", F.concat(F.lit("User "), user)).otherwise("Observed entity")
    done = F.coalesce(F.nullif(field(df, "action", ""), F.lit("")), F.lit("performed an anomalous action"))
    response = F.lower(F.col("response_action"))
    with_rules = F.concat(
        subject, F.lit(" "), done, F.lit(", triggering "), F.array_join("triggered_rules", ", "),
        F.lit(". The incident was classified as "), F.col("severity"),
        F.lit(" severity and the recommended response is "), response, F.lit("."),
    )
    without = F.concat(
        subject, F.lit(" "), done, F.lit(". Behavioral and anomaly models marked the activity as "),
        F.col("severity"), F.lit(" severity, so the recommended response is "), response, F.lit("."),
    )
    return F.when(F.size("triggered_rules") > 0, with_rules).otherwise(without)
