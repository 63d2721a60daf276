"""Stream features, scores, rules and labels over the security view."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.rounding import exact_round_sql
from wardline.operators import labels, scoring
from wardline.operators.stream_features import (
    activity_rates,
    cold_start_score,
    ip_change_frequency,
    stream_features,
    user_behavior_score,
)
from wardline.plans.registry import plan
from wardline.plans.tables import DAY, SEC, security_events

# The test events are sparse, so windows are days here and slices are wide.
LOGIN_DAYS, REQUEST_DAYS = 3, 1
WIDTH = 8 * DAY
SPANS = {"login_span": LOGIN_DAYS * 86400, "request_span": REQUEST_DAYS * 86400}

RATES = f"""rates AS (SELECT *,
    round_even(least(count(*) OVER (PARTITION BY user_name ORDER BY ts RANGE BETWEEN INTERVAL {LOGIN_DAYS} DAY PRECEDING AND CURRENT ROW) / 15e0, 1e0), 4) AS login_frequency,
    round_even(least(count(*) OVER (PARTITION BY user_name ORDER BY ts RANGE BETWEEN INTERVAL {REQUEST_DAYS} DAY PRECEDING AND CURRENT ROW) / 10e0, 1e0), 4) AS request_rate
  FROM sec)"""
MOVES = """flags AS (SELECT *,
    CASE WHEN ip_address <> lag(ip_address) OVER (PARTITION BY user_name ORDER BY ts, seq) THEN 1 ELSE 0 END AS moved,
    row_number() OVER (PARTITION BY user_name ORDER BY ts, seq) AS rn
  FROM rates), moves AS (SELECT *,
    CASE WHEN rn = 1 THEN 0e0 ELSE round_even(
      sum(moved) OVER (PARTITION BY user_name ORDER BY ts, seq ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)
      / (least(rn, 20) - 1)::DOUBLE, 4) END AS ip_change_frequency
  FROM flags)"""
FEATURES = """features AS (SELECT *,
    CASE severity WHEN 'critical' THEN 1e0 WHEN 'high' THEN 0.8e0 WHEN 'medium' THEN 0.5e0 ELSE 0.25e0 END AS severity_score,
    round_even(hour(ts) / 23e0, 4) AS hour_fraction, round_even(minute(ts) / 59e0, 4) AS minute_fraction,
    CASE WHEN hour(ts) < 6 OR hour(ts) > 20 THEN 1e0 ELSE 0e0 END AS is_after_hours,
    CASE WHEN source = 'auth' THEN 1e0 ELSE 0e0 END AS source_auth,
    CASE WHEN source = 'network' THEN 1e0 ELSE 0e0 END AS source_network,
    CASE attack_type WHEN 'brute_force' THEN 0.5e0 WHEN 'ddos' THEN 0.75e0 WHEN 'insider_threat' THEN 1e0 ELSE 0e0 END AS attack_weight
  FROM moves)"""
SCORES = f"""modelled AS (SELECT *,
    round_even(greatest(0e0, least(severity_score * 0.35e0 + request_rate * 0.25e0 + attack_weight * 0.40e0, 1e0)), 4) AS ml_score,
    {exact_round_sql('least(login_frequency * 0.5e0 + ip_change_frequency * 0.5e0, 1e0)', 4)} AS user_behavior_score
  FROM features), weighed AS (SELECT *,
    CASE attack_type WHEN 'brute_force' THEN 2e0 WHEN 'ddos' THEN 3e0 WHEN 'insider_threat' THEN 4e0 ELSE 0e0 END AS w
  FROM modelled), scored AS (SELECT *,
    CAST(trunc(greatest(0e0, least(ml_score * 40e0 + user_behavior_score * 30e0 + severity_score * 20e0 + w * 10e0, 100e0))) AS INTEGER) AS risk
  FROM weighed), banded AS (SELECT *,
    CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 30 THEN 'medium' ELSE 'low' END AS band,
    array_to_string(list_sort(list_filter([
      CASE WHEN ip_change_frequency >= 0.5 THEN 'ip_change_detected' END,
      CASE WHEN ml_score >= 0.7 THEN 'ml_anomaly' END,
      CASE WHEN user_behavior_score >= 0.5 THEN 'ueba_deviation' END,
      CASE WHEN w > 0 THEN attack_type || '_detected' END,
      CASE WHEN request_rate >= 0.7 THEN 'frequency_spike' END], lambda x: x IS NOT NULL)), ',') AS reason
  FROM scored)"""
CHAIN = ", ".join([SEC, RATES, MOVES, FEATURES, SCORES])


def featured(spark, sf_dir):
    return stream_features(security_events(spark, sf_dir), **SPANS)


def scored_events(spark, sf_dir):
    """Features, cold-start model score and weighted risk for every event."""
    modelled = featured(spark, sf_dir).withColumns(
        {"ml_score": cold_start_score(), "user_behavior_score": user_behavior_score()}
    )
    return scoring.risk_score(modelled)


@plan("login_and_request_rates", f"WITH {SEC}, {RATES} SELECT event_id, login_frequency, request_rate FROM rates")
def _rates(spark, sf_dir):
    rated = activity_rates(security_events(spark, sf_dir), **SPANS)
    return rated.select("event_id", "login_frequency", "request_rate")


@plan("ip_change_frequency", f"WITH {SEC}, {RATES}, {MOVES} SELECT event_id, ip_change_frequency FROM moves")
def _moves(spark, sf_dir):
    moved = ip_change_frequency(security_events(spark, sf_dir), width=WIDTH)
    return moved.select("event_id", "ip_change_frequency")


@plan(
    "stream_features",
    f"""WITH {SEC}, {RATES}, {MOVES}, {FEATURES} SELECT event_id, login_frequency, ip_change_frequency,
    request_rate, severity_score, hour_fraction, minute_fraction, is_after_hours, source_auth, source_network,
    attack_weight FROM features""",
)
def _features(spark, sf_dir):
    from wardline.operators.stream_features import FEATURE_ORDER

    return featured(spark, sf_dir).select("event_id", *FEATURE_ORDER)


@plan("cold_start_scores", f"WITH {CHAIN} SELECT event_id, ml_score, user_behavior_score FROM modelled")
def _cold(spark, sf_dir):
    return featured(spark, sf_dir).select(
        "event_id",
        cold_start_score().alias("ml_score"),
        user_behavior_score().alias("user_behavior_score"),
    )


@plan(
    "risk_scores",
    f"""WITH {CHAIN} SELECT event_id, risk AS risk_score, band AS severity, risk >= 30 AS alert, reason,
    ml_score AS component_ml, user_behavior_score AS component_behavior, severity_score AS component_severity,
    w AS component_attack FROM banded""",
)
def _risk(spark, sf_dir):
    return scored_events(spark, sf_dir).select(
        "event_id", "risk_score", "severity", "alert", F.array_join("reason", ",").alias("reason"),
        "component_ml", "component_behavior", "component_severity", "component_attack",
    )


@plan(
    "scored_severity_by_host",
    f"""WITH {CHAIN} SELECT host, band AS severity, count(*) AS events, max(risk) AS peak_risk,
    CAST(sum(CASE WHEN risk >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM banded GROUP BY host, band""",
)
def scored_severity_by_host(spark, sf_dir):
    """The flagship: view, windows, model score, risk, alert flag, counts by host."""
    return (
        scored_events(spark, sf_dir)
        .groupBy("host", "severity")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.max("risk_score").alias("peak_risk"),
            F.sum(F.col("alert").cast("bigint")).alias("alerts"),
        )
    )


BURST = f"""fails AS (SELECT *, count(*) OVER (PARTITION BY user_name ORDER BY ts RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND CURRENT ROW) AS n
  FROM sec WHERE event_type = 'login_failure'),
 bursts AS (SELECT sec.*, coalesce(n, 0) AS failures_in_window, coalesce(n, 0) >= 5 AS burst FROM sec LEFT JOIN fails USING (seq))"""


def bursts(spark, sf_dir):
    return scoring.failed_login_burst(security_events(spark, sf_dir), span=15 * 86400)


@plan("failed_login_burst", f"WITH {SEC}, {BURST} SELECT event_id, failures_in_window, burst FROM bursts")
def _burst(spark, sf_dir):
    return bursts(spark, sf_dir).select("event_id", "failures_in_window", "burst")


RULES = """ruled AS (SELECT *, CASE WHEN k >= 95 THEN 6 ELSE 0 END AS login_failure_count, k % 7 = 0 AS odd_hour FROM bursts),
 rule_out AS (SELECT *, least(CASE WHEN burst THEN 0.2e0 ELSE 0e0 END + least(CASE attack_type WHEN 'brute_force' THEN 2e0
    WHEN 'ddos' THEN 3e0 WHEN 'insider_threat' THEN 4e0 ELSE 0e0 END * 0.1e0, 0.4e0), 1e0) AS rule_score,
    list_sort(list_filter([CASE WHEN login_failure_count >= 5 THEN 'login_anomaly' END,
      CASE WHEN odd_hour THEN 'access_time_violation' END, CASE WHEN burst THEN 'failed login burst' END], lambda x: x IS NOT NULL)) AS reasons
  FROM ruled)"""


def with_rules(spark, sf_dir):
    fed = bursts(spark, sf_dir).withColumns(
        {
            "login_failure_count": F.when(F.col("k") >= 95, 6).otherwise(0),
            "access_time_anomaly": F.col("k") % 7 == 0,
        }
    )
    return scoring.rule_score(fed)


@plan(
    "rule_scores",
    f"""WITH {SEC}, {BURST}, {RULES} SELECT event_id, round(rule_score, 6) AS rule_score,
    array_to_string(reasons, ',') AS rule_reasons FROM rule_out""",
)
def _rules(spark, sf_dir):
    return with_rules(spark, sf_dir).select(
        "event_id", F.round("rule_score", 6).alias("rule_score"),
        F.array_join("rule_reasons", ",").alias("rule_reasons"),
    )


@plan(
    "behavioral_reasons",
    f"""WITH {SEC} SELECT event_id, array_to_string(list_filter([CASE WHEN k >= 90 THEN 'login_anomaly' END,
    CASE WHEN k / 100e0 >= 0.5 THEN 'ip_change_detected' END, CASE WHEN k % 7 = 0 THEN 'access_time_violation' END],
    lambda x: x IS NOT NULL), ',') AS reasons FROM sec""",
)
def _reasons(spark, sf_dir):
    df = security_events(spark, sf_dir).withColumns(
        {
            "login_failure_count": F.when(F.col("k") >= 90, 5.0).otherwise(0.0),
            "ip_change_frequency": F.col("k") / 100.0,
            "access_time_anomaly": F.col("k") % 7 == 0,
        }
    )
    return df.select("event_id", F.array_join(scoring.behavioral_reasons(df), ",").alias("reasons"))


FLAGS_SQL = """flagged AS (SELECT *, k % 3 = 0 AS unknown_process, k % 5 = 0 AS unusual_network_ip,
   k % 4 = 0 AS suspicious_port, k % 7 = 0 AS sensitive_file_access FROM sec)"""


def flagged(spark, sf_dir):
    k = F.col("k")
    return security_events(spark, sf_dir).withColumns(
        {
            "unknown_process": k % 3 == 0,
            "unusual_network_ip": k % 5 == 0,
            "suspicious_port": k % 4 == 0,
            "sensitive_file_access": k % 7 == 0,
        }
    )


@plan(
    "heuristic_scores",
    f"""WITH {SEC}, {FLAGS_SQL} SELECT event_id,
    round(least(unknown_process::INT * 0.35e0 + unusual_network_ip::INT * 0.25e0 + sensitive_file_access::INT * 0.25e0
      + (event_type = 'login_failure')::INT * 0.15e0, 1e0), 6) AS heuristic_probability,
    round(least(unknown_process::INT * 0.3e0 + suspicious_port::INT * 0.3e0 + unusual_network_ip::INT * 0.2e0
      + sensitive_file_access::INT * 0.2e0, 1e0), 6) AS heuristic_anomaly FROM flagged""",
)
def _heuristic(spark, sf_dir):
    return scoring.heuristic_scores(flagged(spark, sf_dir)).select(
        "event_id",
        F.round("heuristic_probability", 6).alias("heuristic_probability"),
        F.round("heuristic_anomaly", 6).alias("heuristic_anomaly"),
    )


@plan(
    "event_labels",
    f"""WITH {SEC} SELECT event_id,
    CASE WHEN event_type = 'anomaly' THEN 1 WHEN attack_type IN ('brute_force','ddos','insider_threat') THEN 1
      WHEN severity IN ('high','critical') THEN 1 WHEN value / 100 >= 0.6 THEN 1 ELSE 0 END AS label,
    CASE WHEN event_type = 'anomaly' OR attack_type <> 'none' OR severity IN ('high','critical') OR value / 100 >= 0.6
      THEN 'anomaly' ELSE 'normal' END AS label_name,
    CASE WHEN event_type = 'normal' THEN 0 ELSE 1 END AS stream_label FROM sec""",
)
def _labels(spark, sf_dir):
    df = security_events(spark, sf_dir).withColumn("risk_score", F.col("value") / 100)
    return labels.attach_labels(df).select(
        "event_id", "label", "label_name", labels.stream_label().alias("stream_label")
    )


@plan(
    "binary_labels_and_clean_features",
    f"""WITH {SEC} SELECT event_id, CASE WHEN attack_type IN ('0','normal','benign') THEN 0 ELSE 1 END AS word_label,
    CASE WHEN value - 50 > 0 THEN 1 ELSE 0 END AS number_label,
    coalesce(CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 0e0 ELSE value / k END, 0e0) AS ratio FROM sec""",
)
def _binary(spark, sf_dir):
    df = security_events(spark, sf_dir).withColumns(
        {
            "centred": F.col("value") - 50,
            "ratio": F.when(F.col("k") == 1, F.lit(float("inf"))).otherwise(
                F.try_divide(F.col("value"), F.col("k"))
            ),
        }
    )
    return labels.clean_features(df, ["ratio"]).select(
        "event_id",
        labels.binary_label(df, "attack_type").alias("word_label"),
        labels.binary_label(df, "centred").alias("number_label"),
        "ratio",
    )
