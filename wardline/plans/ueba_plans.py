"""User-behaviour plans: identity events, baselines, deviation, profiles, assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.rounding import exact_round_sql
from wardline.operators import scoring, ueba
from wardline.plans.registry import plan
from wardline.plans.scoring_plans import with_rules
from wardline.plans.tables import SEC, security_events

SPLIT = 1_705_795_200_000_000  # 2024-01-21: baselines before, scoring from here on

AUTH = f"""{SEC}, auth AS (SELECT event_id, seq, ts, us, user_name AS "user", device, ip_address, k, host,
    CASE event_type WHEN 'anomaly' THEN 'logout_event' ELSE event_type END AS event_type,
    CASE k % 5 WHEN 0 THEN 'RemoteInteractive' WHEN 1 THEN 'Network' WHEN 2 THEN 'NetworkCleartext'
      WHEN 3 THEN 'Interactive' ELSE 'unknown' END AS logon_type
  FROM sec)"""
PAST = f"""past AS (SELECT * FROM auth WHERE us < {SPLIT} AND event_type IN ('login_success','login_failure','logout_event')),
 totals AS (SELECT "user", greatest(count(*) FILTER (event_type = 'login_success'), 1) AS s,
   greatest(count(*) FILTER (event_type = 'login_failure'), 1) AS f,
   count(*) FILTER (event_type = 'logout_event') AS logout_count, count(*) AS events_analyzed FROM past GROUP BY "user"),
 wins AS (SELECT * FROM past WHERE event_type = 'login_success'),
 sides AS (SELECT "user", 'hour' AS dimension, CAST(hour(ts) AS VARCHAR) AS v, us FROM wins
   UNION ALL SELECT "user", 'device', device, us FROM wins UNION ALL SELECT "user", 'ip', ip_address, us FROM wins
   UNION ALL SELECT "user", 'logon_type', logon_type, us FROM wins),
 counted AS (SELECT "user", dimension, v, count(*) AS n, min(us) AS f FROM sides GROUP BY ALL),
 ranked AS (SELECT *, CASE WHEN dimension IN ('device','ip') THEN
   row_number() OVER (PARTITION BY "user", dimension ORDER BY n DESC, f, v) ELSE 0 END AS rnk FROM counted),
 known AS (SELECT ranked."user", dimension, v, n, rnk, {exact_round_sql("n / s::DOUBLE", 4)} AS share
   FROM ranked JOIN totals USING ("user") WHERE rnk <= 10)"""


def auth_events(spark, sf_dir):
    k = F.col("k")
    return security_events(spark, sf_dir).withColumnRenamed("user_name", "user").withColumns(
        {
            "event_type": F.when(F.col("event_type") == "anomaly", "logout_event").otherwise(F.col("event_type")),
            "logon_type": F.when(k % 5 == 0, "RemoteInteractive")
            .when(k % 5 == 1, "Network")
            .when(k % 5 == 2, "NetworkCleartext")
            .when(k % 5 == 3, "Interactive")
            .otherwise("unknown"),
        }
    )


def past_auth(spark, sf_dir):
    return auth_events(spark, sf_dir).filter(F.col("at") < SPLIT)


@plan(
    "baseline_shares",
    f"""WITH {AUTH}, {PAST} SELECT "user", dimension, v AS value, n AS "count", share, CAST(rnk AS INTEGER) AS rank FROM known""",
)
def _shares(spark, sf_dir):
    return ueba.baseline_shares(past_auth(spark, sf_dir)).drop("first_at")


@plan(
    "login_baselines",
    f"""WITH {AUTH}, {PAST}, hours AS (SELECT "user", avg(CAST(v AS INTEGER)) AS mean_hour, count(*) AS hours FROM known WHERE dimension = 'hour' GROUP BY 1),
    lists AS (SELECT "user", string_agg(v, ',' ORDER BY rnk) FILTER (dimension = 'device') AS devices,
      string_agg(v, ',' ORDER BY rnk) FILTER (dimension = 'ip') AS ips,
      count(*) FILTER (dimension = 'device') AS device_count, count(*) FILTER (dimension = 'ip') AS ip_count FROM known GROUP BY 1)
    SELECT totals."user", s + f AS total_logins, s AS login_success_count, f AS login_failure_count,
      {exact_round_sql("f / (s + f)::DOUBLE", 4)} AS failed_login_rate, logout_count, events_analyzed,
      CASE WHEN mean_hour IS NULL THEN NULL ELSE {exact_round_sql("mean_hour", 2)} END AS avg_login_hour,
      CAST(coalesce(hours, 0) AS INTEGER) AS active_hours,
      coalesce(devices, '') AS known_devices, CAST(coalesce(device_count, 0) AS INTEGER) AS device_count,
      coalesce(ips, '') AS known_ips, CAST(coalesce(ip_count, 0) AS INTEGER) AS ip_count
    FROM totals LEFT JOIN hours USING ("user") LEFT JOIN lists USING ("user")""",
)
def _baselines(spark, sf_dir):
    return ueba.build_baselines(past_auth(spark, sf_dir)).select(
        "user", "total_logins", "login_success_count", "login_failure_count", "failed_login_rate", "logout_count",
        "events_analyzed", "avg_login_hour", F.size("login_time_distribution").alias("active_hours"),
        F.array_join("known_devices", ",").alias("known_devices"), "device_count",
        F.array_join("known_ips", ",").alias("known_ips"), "ip_count",
    )


DEVIATION = """later AS (SELECT * FROM auth WHERE us >= %d),
 tests AS (SELECT l.*, totals."user" IS NULL AS stranger, l.event_type IN ('login_success','login_failure') AS login,
   coalesce((SELECT max(share) FROM known b WHERE b."user" = l."user" AND dimension = 'hour' AND v = CAST(hour(l.ts) AS VARCHAR)), 0e0) < 0.05 AS rare,
   NOT EXISTS (SELECT 1 FROM known b WHERE b."user" = l."user" AND dimension = 'device' AND v = l.device) AS new_device,
   NOT EXISTS (SELECT 1 FROM known b WHERE b."user" = l."user" AND dimension = 'ip' AND v = l.ip_address) AS new_ip,
   NOT EXISTS (SELECT 1 FROM known b WHERE b."user" = l."user" AND dimension = 'logon_type' AND v = l.logon_type)
     AND l.logon_type IN ('RemoteInteractive','NetworkCleartext') AS odd
  FROM later l LEFT JOIN totals ON totals."user" = l."user"),
 deviation AS (SELECT *, CASE WHEN stranger THEN 0.15e0 WHEN login THEN round(least(rare::INT * 0.15e0 + new_device::INT * 0.2e0
     + new_ip::INT * 0.2e0 + (event_type = 'login_failure')::INT * 0.1e0 + odd::INT * 0.1e0, 1e0), 6) ELSE 0e0 END AS behavior_score,
   CASE WHEN stranger THEN ['new_user_baseline'] WHEN login THEN list_filter([CASE WHEN rare THEN 'unusual_login_time' END,
     CASE WHEN new_device THEN 'new_device' END, CASE WHEN new_ip THEN 'new_ip_address' END,
     CASE WHEN event_type = 'login_failure' THEN 'failed_login' END, CASE WHEN odd THEN 'unusual_logon_type' END], lambda x: x IS NOT NULL)
     ELSE [] END AS behavior_reasons
  FROM tests)""" % SPLIT


def deviations(spark, sf_dir):
    events = auth_events(spark, sf_dir).filter(F.col("at") >= SPLIT)
    return ueba.ueba_score(events, ueba.build_baselines(past_auth(spark, sf_dir)))


@plan(
    "login_deviation",
    f"""WITH {AUTH}, {PAST}, {DEVIATION} SELECT event_id, behavior_score, array_to_string(behavior_reasons, ',') AS behavior_reasons FROM deviation""",
)
def _deviation(spark, sf_dir):
    return deviations(spark, sf_dir).select(
        "event_id", F.round("behavior_score", 6).alias("behavior_score"),
        F.array_join("behavior_reasons", ",").alias("behavior_reasons"),
    )


RAW_AUTH = f"""{SEC}, raw AS (SELECT event_id AS record, CASE k % 6 WHEN 0 THEN 4624 WHEN 1 THEN 4625 WHEN 2 THEN 4634
     WHEN 3 THEN 4647 WHEN 4 THEN 4688 ELSE 4624 END AS code, k,
   CASE WHEN k % 11 = 0 THEN 'unknown' WHEN k % 11 = 1 THEN NULL WHEN k % 11 = 2 THEN 'System' ELSE ' ' || user_name || ' ' END AS u,
   CASE WHEN k % 3 = 0 THEN NULL ELSE host END AS host, device,
   CASE k % 4 WHEN 0 THEN 'NewCredentials' WHEN 1 THEN 'Network' ELSE NULL END AS logon FROM sec)"""


def raw_auth(spark, sf_dir):
    k = F.col("k")
    return security_events(spark, sf_dir).select(
        F.col("seq").cast("int").alias("record_number"),
        F.when(k % 6 == 1, 4625).when(k % 6 == 2, 4634).when(k % 6 == 3, 4647).when(k % 6 == 4, 4688).otherwise(4624).alias("event_id"),
        F.when(k % 11 == 0, "unknown").when(k % 11 == 1, F.lit(None)).when(k % 11 == 2, "System")
        .otherwise(F.concat(F.lit(" "), "user_name", F.lit(" "))).alias("user"),
        F.when(k % 3 != 0, F.col("host")).alias("host"),
        F.col("device").alias("source_device"),
        F.when(k % 4 == 0, "NewCredentials").when(k % 4 == 1, "Network").alias("logon_type"),
        F.col("ts").alias("timestamp"),
    )


UEBA_SQL = """ueba AS (SELECT CAST(record AS INTEGER) AS record_id, trim(u) AS "user", coalesce(host, device) AS device,
   CASE code WHEN 4624 THEN 'login_success' WHEN 4625 THEN 'login_failure' ELSE 'logout_event' END AS event_type,
   code AS auth_event_id, coalesce(logon, 'unknown') AS logon_type, code = 4625 AS failed_login,
   coalesce(logon = 'NewCredentials', false) AS unusual_logon_type
  FROM raw WHERE code <> 4688 AND u IS NOT NULL AND u <> 'unknown')"""


@plan("identity_events", f"WITH {RAW_AUTH}, {UEBA_SQL} SELECT * FROM ueba")
def _to_ueba(spark, sf_dir):
    return ueba.to_ueba(raw_auth(spark, sf_dir)).select(
        "record_id", "user", "device", "event_type", "auth_event_id", "logon_type",
        "risk_signals.failed_login", "risk_signals.unusual_logon_type",
    )


MIXED = f"""{AUTH}, mixed AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'sysmon' ELSE 'windows_auth' END AS src,
   CASE WHEN k % 11 = 2 THEN 'System' WHEN k % 11 = 3 THEN NULL ELSE "user" END AS name FROM auth),
 judged AS (SELECT *, coalesce(src = 'windows_auth' AND event_type IN ('login_success','login_failure','logout_event')
   AND lower(coalesce(name, '')) NOT IN ('', 'unknown', 'system', 'local service'), false) AS ok FROM mixed)"""


def mixed_events(spark, sf_dir):
    k = F.col("k")
    return auth_events(spark, sf_dir).withColumns(
        {
            "source": F.when(k % 13 == 0, "sysmon").otherwise("windows_auth"),
            "user": F.when(k % 11 == 2, "System").when(k % 11 != 3, F.col("user")),
        }
    )


@plan("identity_filter", f'WITH {MIXED} SELECT event_id, name AS "user", event_type FROM judged WHERE ok')
def _filter(spark, sf_dir):
    return ueba.ueba_filter(mixed_events(spark, sf_dir)).select("event_id", "user", "event_type")


@plan(
    "identity_filter_stats",
    f"""WITH {MIXED} SELECT count(*) AS total_events, count(*) FILTER (ok) AS passed_filter, count(*) FILTER (NOT ok) AS rejected,
    round(count(*) FILTER (ok) / count(*)::DOUBLE * 100, 2) AS pass_rate,
    count(*) FILTER (NOT ok AND event_type = 'process_create') AS rejected_process_create,
    count(*) FILTER (NOT ok AND src = 'sysmon') AS rejected_sysmon FROM judged""",
)
def _stats(spark, sf_dir):
    stats = ueba.ueba_filter_stats(mixed_events(spark, sf_dir))
    return stats.select(
        "total_events", "passed_filter", "rejected", F.round("pass_rate", 2).alias("pass_rate"),
        F.col("rejected_by_type")["process_create"].alias("rejected_process_create"),
        F.col("rejected_by_source")["sysmon"].alias("rejected_sysmon"),
    )


FLOWS = f"""{SEC}, flows AS (SELECT seq, ts, us, user_name AS user_id, host AS source_host, device AS destination_host,
   CASE k % 6 WHEN 0 THEN 'Kerberos' WHEN 1 THEN 'NTLM' WHEN 2 THEN 'Negotiate' WHEN 3 THEN 'Digest' WHEN 4 THEN 'Basic' ELSE 'Token' END AS auth_type,
   'a' || CAST(k % 25 AS VARCHAR) AS action, ip_address, CASE WHEN event_type = 'login_failure' THEN 1 ELSE 0 END AS failed_logins FROM sec)"""


def auth_flows(spark, sf_dir):
    k = F.col("k")
    words = ["Kerberos", "NTLM", "Negotiate", "Digest", "Basic"]
    kind = F.lit("Token")
    for i, word in enumerate(words):
        kind = F.when(k % 6 == i, word).otherwise(kind)
    return security_events(spark, sf_dir).select(
        "seq", "at", F.col("user_name").alias("user_id"), F.col("host").alias("source_host"),
        F.col("device").alias("destination_host"), kind.alias("auth_type"),
        F.concat(F.lit("a"), (k % 25).cast("string")).alias("action"), "ip_address",
        F.when(F.col("event_type") == "login_failure", 1).otherwise(0).alias("failed_logins"), "k", "event_id",
    )


def _first_sql(value: str, limit: int, name: str) -> str:
    return f"""(SELECT user_id, string_agg(v, ',' ORDER BY f, v) AS {name}, count(*) AS n_{name} FROM (SELECT user_id, {value} AS v, min(seq) AS f,
      row_number() OVER (PARTITION BY user_id ORDER BY min(us), min(seq)) AS rn FROM flows GROUP BY user_id, {value}) WHERE rn <= {limit} GROUP BY user_id)"""


@plan(
    "flow_profiles",
    f"""WITH {FLOWS} SELECT t.user_id, total_logins, failed_logins, device_fingerprint, auth_methods FROM
    (SELECT user_id, count(*) AS total_logins, CAST(sum(failed_logins) AS BIGINT) AS failed_logins FROM flows GROUP BY 1) t
    JOIN {_first_sql("source_host", 10, "device_fingerprint")} d USING (user_id)
    JOIN {_first_sql("auth_type", 5, "auth_methods")} a USING (user_id)""",
)
def _flow_profiles(spark, sf_dir):
    return ueba.build_profiles_flow(auth_flows(spark, sf_dir)).select(
        "user_id", "total_logins", "failed_logins", F.array_join("device_fingerprint", ",").alias("device_fingerprint"),
        F.array_join("auth_methods", ",").alias("auth_methods"),
    )


@plan(
    "profile_hour_shares",
    f"""WITH {FLOWS}, h AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM flows GROUP BY ALL),
    t AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS x FROM h) SELECT user_id, hour, {exact_round_sql("x", 4)} AS share FROM t""",
)
def _hour_shares(spark, sf_dir):
    return ueba.hour_shares(auth_flows(spark, sf_dir))


ACTION_PROFILES = f"""profiles AS (SELECT t.user_id, total_logins, failed_logins, location_history, n_location_history, device_fingerprint,
    n_device_fingerprint, activity_sequence_model FROM
    (SELECT user_id, count(*) AS total_logins, CAST(sum(failed_logins) AS BIGINT) AS failed_logins FROM flows GROUP BY 1) t
    JOIN {_first_sql("source_host || '->' || destination_host", 10, "location_history")} l USING (user_id)
    JOIN {_first_sql("source_host", 10, "device_fingerprint")} d USING (user_id)
    JOIN {_first_sql("action", 15, "activity_sequence_model")} a USING (user_id))"""


@plan(
    "action_profiles",
    f"""WITH {FLOWS}, {ACTION_PROFILES} SELECT user_id, total_logins, failed_logins, location_history, device_fingerprint,
    activity_sequence_model, array_to_string(list_filter([CASE WHEN total_logins < 5 THEN 'Low activity user (limited baseline)' END,
      CASE WHEN n_device_fingerprint > 10 THEN 'High device diversity' END, CASE WHEN n_location_history > 5 THEN 'Multi-location user' END,
      CASE WHEN failed_logins > 3 THEN 'High auth failure rate' END], lambda x: x IS NOT NULL), '; ') AS risk_factors FROM profiles""",
)
def _action_profiles(spark, sf_dir):
    profiles = ueba.build_profiles_actions(auth_flows(spark, sf_dir))
    return profiles.select(
        "user_id", "total_logins", "failed_logins",
        *[F.array_join(n, ",").alias(n) for n in ("location_history", "device_fingerprint", "activity_sequence_model")],
        F.array_join(ueba.risk_factors(profiles), "; ").alias("risk_factors"),
    )


@plan(
    "profile_lookup",
    f"""WITH {FLOWS}, {ACTION_PROFILES} SELECT user_id, total_logins, CASE WHEN failed_logins > 3 THEN 1 ELSE 0 END AS failing
    FROM profiles WHERE user_id IN (SELECT 'u' || CAST(c_custkey AS VARCHAR) FROM customer)""",
)
def _profile_lookup(spark, sf_dir):
    from wardline.plans.tables import table

    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"))
    found = ueba.profile_lookup(asked, ueba.build_profiles_actions(auth_flows(spark, sf_dir)))
    failing = F.array_contains("risk_factors", "High auth failure rate").cast("int")
    return found.select("user_id", "total_logins", failing.alias("failing"))


REQUESTS = f"""{FLOWS}, hist AS (SELECT * FROM flows WHERE us < {SPLIT}),
 hours AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM hist GROUP BY ALL),
 shares AS (SELECT user_id, h, x, {exact_round_sql("x", 4)} AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS x FROM hours)),
 req AS (SELECT *, hour(ts) AS h, source_host || '->' || destination_host AS place FROM flows WHERE us >= {SPLIT}),
 firsts AS (SELECT user_id, 'place' AS d, v, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rn FROM
     (SELECT user_id, source_host || '->' || destination_host AS v, min(seq) AS f FROM hist GROUP BY ALL)
   UNION ALL SELECT user_id, 'device', v, row_number() OVER (PARTITION BY user_id ORDER BY f) FROM (SELECT user_id, source_host AS v, min(seq) AS f FROM hist GROUP BY ALL)
   UNION ALL SELECT user_id, 'action', v, row_number() OVER (PARTITION BY user_id ORDER BY f) FROM (SELECT user_id, action AS v, min(seq) AS f FROM hist GROUP BY ALL)),
 kept AS (SELECT * FROM firsts WHERE rn <= CASE d WHEN 'action' THEN 15 ELSE 10 END),
 t AS (SELECT r.*, r.user_id NOT IN (SELECT user_id FROM hist) AS stranger,
   coalesce((SELECT max(share) FROM shares s WHERE s.user_id = r.user_id AND s.h = r.h), 0e0) AS p,
   NOT EXISTS (SELECT 1 FROM kept x WHERE x.user_id = r.user_id AND d = 'place' AND v = r.place) AS new_place,
   NOT EXISTS (SELECT 1 FROM kept x WHERE x.user_id = r.user_id AND d = 'device' AND v = r.source_host) AS new_device,
   NOT EXISTS (SELECT 1 FROM kept x WHERE x.user_id = r.user_id AND d = 'action' AND v = r.action) AS new_action FROM req r),
 scored_req AS (SELECT *, CASE WHEN stranger THEN 0.05e0 ELSE least(
     CASE WHEN p < 0.05 THEN 0.15e0 WHEN p < 0.10 THEN 0.08e0 ELSE 0e0 END + new_place::INT * 0.25e0 + new_device::INT * 0.2e0
     + new_action::INT * 0.15e0, 1e0) END AS deviation FROM t)"""


def requests(spark, sf_dir):
    return auth_flows(spark, sf_dir).filter(F.col("at") >= SPLIT)


def request_deviation(spark, sf_dir):
    past = auth_flows(spark, sf_dir).filter(F.col("at") < SPLIT)
    asked = requests(spark, sf_dir).drop("failed_logins")
    return ueba.behavior_score(asked, ueba.build_profiles_actions(past))


@plan(
    "request_deviation",
    f"""WITH {REQUESTS} SELECT event_id, round(deviation, 6) AS behavior_deviation_score,
    CASE WHEN stranger THEN 'new_user_behavior' ELSE array_to_string(list_filter([CASE WHEN p < 0.05 THEN 'behavior_unusual_time' WHEN p < 0.10 THEN 'behavior_atypical_time' END,
      CASE WHEN new_place THEN 'behavior_unusual_location' END, CASE WHEN new_device THEN 'behavior_new_device' END,
      CASE WHEN new_action THEN 'behavior_rare_action' END], lambda x: x IS NOT NULL), ',') END AS behavior_reasons
    FROM (SELECT *, CAST(seq AS VARCHAR) AS event_id FROM scored_req)""",
)
def _request_deviation(spark, sf_dir):
    return request_deviation(spark, sf_dir).select(
        "event_id", F.round("behavior_deviation_score", 6).alias("behavior_deviation_score"),
        F.array_join("behavior_reasons", ",").alias("behavior_reasons"),
    )


ANALYZE = """an AS (SELECT CAST(seq AS VARCHAR) AS event_id, user_id, action, (seq % 97) / 100e0 AS sp, (seq % 89) / 100e0 AS an,
   seq % 7 AS fl, seq % 5 = 0 AS ul, seq % 6 = 0 AS ut, seq % 9 = 0 AS sf, seq % 10 = 0 AS bd, seq % 12 = 0 AS pe FROM flows),
 adj AS (SELECT *, (fl > 3)::INT * 20 + ul::INT * 25 + ut::INT * 15 + sf::INT * 30 + bd::INT * 25 + pe::INT * 40 AS adjustment,
   list_filter([CASE WHEN fl > 3 THEN 'failed_logins>3' END, CASE WHEN ul THEN 'unusual_location' END, CASE WHEN ut THEN 'unusual_time' END,
     CASE WHEN sf THEN 'sensitive_file_access' END, CASE WHEN bd THEN 'bulk_download' END, CASE WHEN pe THEN 'privilege_escalation' END], lambda x: x IS NOT NULL) AS rules,
   greatest(0e0, least((0.6e0 * sp + 0.4e0 * an) * 100, 100e0)) AS base FROM an),
 fin AS (SELECT *, greatest(0e0, least(base + adjustment, 100e0)) AS score FROM adj),
 word AS (SELECT *, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS severity,
   CASE WHEN score >= 85 THEN 'Block sensitive actions and downloads' WHEN score >= 60 THEN 'Restrict sensitive actions'
     WHEN score >= 30 THEN 'Alert SOC analyst' ELSE 'Monitor' END AS response_action FROM fin)"""


def analyzed(spark, sf_dir):
    seq = F.col("seq")
    fed = auth_flows(spark, sf_dir).withColumns(
        {
            "supervised_probability": (seq % 97) / 100.0,
            "anomaly_score": (seq % 89) / 100.0,
            "failed_logins": seq % 7,
            "unusual_location": seq % 5 == 0,
            "unusual_time": seq % 6 == 0,
            "sensitive_file_access": seq % 9 == 0,
            "bulk_download": seq % 10 == 0,
            "privilege_escalation": seq % 12 == 0,
        }
    )
    return scoring.analyze(fed)


@plan(
    "analyzed_requests",
    f"""WITH {FLOWS}, {ANALYZE} SELECT event_id, adjustment AS rule_adjustment, array_to_string(rules, ',') AS triggered_rules,
    round(score, 2) AS risk_score, severity, response_action,
    'User ' || user_id || ' ' || action || CASE WHEN len(rules) > 0 THEN ', triggering ' || array_to_string(rules, ', ') || '. The incident was classified as '
      || severity || ' severity and the recommended response is ' || lower(response_action) || '.'
      ELSE '. Behavioral and anomaly models marked the activity as ' || severity || ' severity, so the recommended response is ' || lower(response_action) || '.' END AS incident_story,
    'Supervised model confidence=' || printf('%.2f', sp) || ', anomaly score=' || printf('%.2f', an) || ', behavior deviation=0.00, rule adjustment=' || CAST(adjustment AS VARCHAR)
      || '. Triggered indicators: ' || CASE WHEN len(rules) > 0 THEN array_to_string(rules, ', ') ELSE 'no explicit SOC rules triggered' END || '.' AS explanation FROM word""",
)
def _analyzed(spark, sf_dir):
    return analyzed(spark, sf_dir).select(
        "event_id", "rule_adjustment", F.array_join("triggered_rules", ",").alias("triggered_rules"),
        F.round("risk_score", 2).alias("risk_score"), "severity", "response_action", "incident_story",
        "explanation",
    )


@plan(
    "assessed_events",
    f"""WITH {SEC}, {{rules}}, picked AS (SELECT *, (k % 50) / 50e0 AS p, (k % 40) / 40e0 AS a, (k % 20) / 20e0 AS b FROM rule_out),
    w AS (SELECT *, CASE attack_type WHEN 'brute_force' THEN 2e0 WHEN 'ddos' THEN 3e0 WHEN 'insider_threat' THEN 4e0 ELSE 0e0 END AS w,
      CASE severity WHEN 'critical' THEN 1e0 WHEN 'high' THEN 0.8e0 WHEN 'medium' THEN 0.5e0 ELSE 0.25e0 END AS sv FROM picked),
    s AS (SELECT *, CAST(trunc(greatest(0e0, least(p * 40e0 + b * 30e0 + sv * 20e0 + w * 10e0, 100e0))) AS INTEGER) AS risk_score,
      list_sort(list_distinct(list_concat(reasons, list_filter([CASE WHEN b >= 0.5 THEN 'odd_behavior' END, CASE WHEN login_failure_count >= 5 THEN 'login_anomaly' END,
        CASE WHEN odd_hour THEN 'access_time_violation' END, CASE WHEN p >= 0.7 THEN 'ml_anomaly' END, CASE WHEN b >= 0.5 THEN 'ueba_deviation' END,
        CASE WHEN w > 0 THEN attack_type || '_detected' END, CASE WHEN least(rule_score + a, 1e0) >= 0.7 THEN 'frequency_spike' END], lambda x: x IS NOT NULL)))) AS triggers FROM w),
    o AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS sev,
      CASE WHEN risk_score >= 85 THEN 'Block process (simulation only)' WHEN risk_score >= 60 THEN 'Restrict actions (log only)' WHEN risk_score >= 30 THEN 'Alert' ELSE 'Monitor' END AS act FROM s)
    SELECT event_id, risk_score, sev AS severity, act AS response_action, array_to_string(triggers, ',') AS triggers,
      event_type || ' was observed' || CASE WHEN len(triggers) > 0 THEN ' with indicators including ' || array_to_string(triggers, ', ') ELSE '' END
      || ', leading to a ' || sev || ' risk classification. Recommended response: ' || lower(act) || '.' AS story FROM o""",
)
def _assessed(spark, sf_dir):
    k = F.col("k")
    fed = with_rules(spark, sf_dir).withColumns(
        {
            "ml_prediction_score": (k % 50) / 50.0,
            "anomaly_score": (k % 40) / 40.0,
            "behavior_score": (k % 20) / 20.0,
            "behavior_reasons": F.when((k % 20) / 20.0 >= 0.5, F.array(F.lit("odd_behavior"))).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )
    return scoring.assess(fed).select(
        "event_id", "risk_score", "severity", "response_action", F.array_join("triggers", ",").alias("triggers"), "story"
    )


def _fill_rules() -> None:
    from wardline.plans.registry import TWINS
    from wardline.plans.scoring_plans import BURST, RULES

    TWINS["assessed_events"] = TWINS["assessed_events"].replace("{rules}", f"{BURST}, {RULES}")


_fill_rules()
