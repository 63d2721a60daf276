"""Raw telemetry plans: canonical events, validation, parsing, flags, routing, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import lexicon
from wardline.functions.casts import safe_cast
from wardline.operators import normalize, quality
from wardline.plans.registry import plan
from wardline.plans.tables import SEC, security_events, table

# Raw records with gaps and faults, derived from every event -----------------------------

RAW = f"""{SEC}, raw AS (SELECT event_id, seq, us, k, value, severity AS sev, ts,
   CASE WHEN k % 4 = 0 THEN NULL ELSE user_name END AS "user", user_name AS user_id,
   CASE WHEN k % 3 = 0 THEN NULL ELSE host END AS hostname, host AS computer_name,
   CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'HIGH' WHEN k % 5 = 2 THEN 'odd' ELSE severity END AS severity,
   CASE WHEN k % 6 = 0 THEN 'n/a' WHEN k % 6 = 1 THEN NULL ELSE CAST(k AS VARCHAR) END AS risk_score,
   CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k * 2 AS VARCHAR) END AS ml_score,
   CASE WHEN k % 9 = 0 THEN NULL ELSE event_type || ' seen' END AS message, event_type, source, device, ip_address, attack_type FROM sec)"""


def raw_records(spark, sf_dir):
    k = F.col("k")
    e = security_events(spark, sf_dir)
    return e.select(
        "event_id", "seq", "k", "value", "ts",
        F.when(k % 4 != 0, F.col("user_name")).alias("user"),
        F.col("user_name").alias("user_id"),
        F.when(k % 3 != 0, F.col("host")).alias("hostname"),
        F.col("host").alias("computer_name"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "HIGH").when(k % 5 == 2, "odd").otherwise(F.col("severity")).alias("severity"),
        F.when(k % 6 == 0, "n/a").when(k % 6 != 1, k.cast("string")).alias("risk_score"),
        F.when(k % 7 != 0, (k * 2).cast("string")).alias("ml_score"),
        F.when(k % 9 != 0, F.concat("event_type", F.lit(" seen"))).alias("message"),
        "event_type", "source", "device", "ip_address", "attack_type",
        F.create_map(F.lit("ip_address"), F.col("ip_address"), F.lit("packet_rate"), (k * 300).cast("string")).alias("parsed_fields"),
        F.create_map(F.lit("tenant_id"), F.col("tenant_id"), F.lit("device"), F.lit("kept")).alias("metadata"),
    )


@plan(
    "canonical_events",
    f"""WITH {RAW}, b AS (SELECT *, coalesce(k % 5 = 1 OR coalesce(risk_score, '0') = 'n/a', false) AS broken,
      CASE WHEN risk_score IS NULL THEN coalesce(TRY_CAST(ml_score AS DOUBLE), 0e0) ELSE TRY_CAST(risk_score AS DOUBLE) END AS r,
      coalesce(TRY_CAST(ml_score AS DOUBLE), TRY_CAST(risk_score AS DOUBLE), 0e0) AS m FROM raw)
    SELECT seq, CASE WHEN broken THEN 'fallback-event' ELSE event_id END AS event_id,
      CASE WHEN broken THEN 'unknown' ELSE coalesce("user", user_id) END AS "user", CASE WHEN broken THEN 'unknown' ELSE coalesce(hostname, computer_name) END AS hostname,
      CASE WHEN broken THEN 'fallback' ELSE event_type END AS event_type, CASE WHEN broken THEN 'middleware' ELSE source END AS source,
      CASE WHEN broken THEN 'low' WHEN severity IN ('low','medium','high','critical') THEN severity
        WHEN r >= 85 THEN 'critical' WHEN r >= 60 THEN 'high' WHEN r >= 30 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN broken THEN 0e0 ELSE r END AS risk_score, CASE WHEN broken THEN 0e0 ELSE m END AS ml_score,
      CASE WHEN broken THEN 'data unavailable' ELSE coalesce(message, 'data unavailable') END AS message,
      CASE WHEN broken THEN 'data unavailable' ELSE coalesce(message, '') END AS raw_log,
      CASE WHEN broken THEN NULL ELSE 'kept' END AS device, CASE WHEN broken THEN NULL ELSE CAST(k AS VARCHAR) END AS extra_k FROM b""",
)
def _canonical(spark, sf_dir):
    raw = raw_records(spark, sf_dir).withColumn("label", F.lit(0)).drop("ts", "value")
    kept = normalize.canonicalize(raw, keep=["seq"])
    columns = [
        "event_id", "user", "hostname", "event_type", "source", "severity", "risk_score", "ml_score", "message", "raw_log",
        F.col("metadata")["device"].alias("device"), F.col("metadata")["k"].alias("extra_k"),
    ]
    return kept.select("seq", *columns)


@plan(
    "safe_casts",
    f"""WITH {RAW} SELECT event_id, coalesce(TRY_CAST(risk_score AS DOUBLE), 0e0) AS as_double,
    CAST(trunc(coalesce(TRY_CAST(risk_score || '.7' AS DOUBLE), 0e0)) AS INTEGER) AS as_int,
    lower(trim(CASE k % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN '1' ELSE 'ON' END)) IN ('1','true','yes','y','on') AS as_bool, coalesce(severity, '') AS as_text FROM raw""",
)
def _casts(spark, sf_dir):
    k = F.col("k")
    word = F.when(k % 4 == 0, " Yes ").when(k % 4 == 1, "off").when(k % 4 == 2, "1").otherwise("ON")
    return raw_records(spark, sf_dir).select(
        "event_id", safe_cast("risk_score", "double").alias("as_double"),
        safe_cast(F.concat("risk_score", F.lit(".7")), "int").alias("as_int"),
        safe_cast(word, "boolean").alias("as_bool"), safe_cast("severity", "string").alias("as_text"),
    )


@plan(
    "filled_and_typed",
    f"""WITH {RAW} SELECT event_id, coalesce("user", 'nobody') AS "user", 'x1' AS zone, coalesce(TRY_CAST(ml_score AS DOUBLE), 0e0) AS ml_score, 0 AS attempts FROM raw""",
)
def _filled(spark, sf_dir):
    filled = normalize.fill_missing(raw_records(spark, sf_dir), {"user": "nobody", "zone": "x1"})
    return normalize.enforce_types(filled, {"ml_score": "double", "attempts": "int"}).select(
        "event_id", "user", "zone", "ml_score", "attempts"
    )


@plan(
    "model_outputs",
    f"""WITH {RAW}, s AS (SELECT *, coalesce(risk_score, ml_score, '0') AS raw_score FROM raw), t AS (SELECT *, TRY_CAST(raw_score AS DOUBLE) IS NULL AS bad FROM s)
    SELECT event_id, CASE WHEN bad THEN 'unknown' ELSE coalesce("user", user_id) END AS "user", CASE WHEN bad THEN 0e0 ELSE TRY_CAST(raw_score AS DOUBLE) END AS risk_score,
    CASE WHEN bad THEN 'safe_fallback' ELSE 'success' END AS status, CASE WHEN bad THEN 'data unavailable' ELSE coalesce(message, 'ml output normalized') END AS message FROM t""",
)
def _outputs(spark, sf_dir):
    return normalize.normalize_ml_output(raw_records(spark, sf_dir)).select("event_id", "user", "risk_score", "status", "message")


@plan(
    "bare_model_outputs",
    f"""WITH {SEC} SELECT event_id, k / 100e0 AS risk_score, CASE WHEN k / 100e0 >= 0.5 THEN 'anomaly' ELSE 'normal' END AS prediction FROM sec""",
)
def _bare(spark, sf_dir):
    pairs = security_events(spark, sf_dir).select(
        "event_id", (F.col("k") / 100.0).alias("probability"), F.lit(0.1).alias("anomaly")
    )
    return normalize.normalize_ml_output(pairs).select("event_id", "risk_score", "prediction")


@plan(
    "enriched_events",
    f"""WITH {RAW} SELECT event_id, ip_address AS remote_ip, least(k * 300 / 10000e0, 1e0) AS request_rate FROM raw""",
)
def _enriched(spark, sf_dir):
    return normalize.enrich(raw_records(spark, sf_dir)).select("event_id", "remote_ip", "request_rate")


# Windows and operating-system telemetry -------------------------------------------------

CODES = [4624, 4625, 4634, 4647, 4672, 4688, 4689, 1, 3, 9999]
CODE_SQL = "[" + ",".join(map(str, CODES)) + "][k % 10 + 1]"
HEX = "lower(sha256(event_id))"
WINDOWS = f"""{SEC}, win AS (SELECT event_id AS record, seq, us, k, {CODE_SQL} AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k % 8 = 0 THEN 'Z' WHEN k % 8 = 1 THEN '+02:00' ELSE '' END AS stamp,
   CASE WHEN k % 17 = 0 THEN '  ' ELSE host END AS host, CASE WHEN k % 19 = 0 THEN NULL ELSE user_name END AS "user",
   CASE WHEN k % 4 = 0 THEN 'login_success' WHEN k % 4 = 1 THEN 'process_creation' WHEN k % 4 = 2 THEN 'dns_query' ELSE event_type END AS event_type,
   CASE WHEN k % 3 = 0 THEN 'sysmon' WHEN k % 3 = 1 THEN 'windows_security' ELSE source END AS source, CASE WHEN k % 23 = 0 THEN 'urgent' ELSE severity END AS severity, tenant_id,
   CASE WHEN k % 29 = 0 THEN 'abc' WHEN k % 29 = 1 THEN upper({HEX}) ELSE {HEX} END AS integrity_hash, {HEX} AS h,
   CASE WHEN k % 13 = 0 THEN '10.0.0.300' WHEN k % 13 = 1 THEN 'fe80::1' WHEN k % 13 = 2 THEN '1:2:3' ELSE ip_address END AS ip_address FROM sec)"""


def windows_records(spark, sf_dir):
    k = F.col("k")
    digest = F.sha2("event_id", 256)
    e = security_events(spark, sf_dir)
    zone = F.when(k % 8 == 0, "Z").when(k % 8 == 1, "+02:00").otherwise("")
    return e.select(
        F.col("event_id").alias("record"), "seq", "k",
        F.get(F.array(*map(F.lit, CODES)), k % 10).alias("event_id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("timestamp"),
        F.when(k % 17 == 0, "  ").otherwise(F.col("host")).alias("host"),
        F.when(k % 19 != 0, F.col("user_name")).alias("user"),
        F.when(k % 4 == 0, "login_success").when(k % 4 == 1, "process_creation").when(k % 4 == 2, "dns_query").otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 3 == 0, "sysmon").when(k % 3 == 1, "windows_security").otherwise(F.col("source")).alias("source"),
        F.when(k % 23 == 0, "urgent").otherwise(F.col("severity")).alias("severity"),
        "tenant_id",
        F.when(k % 29 == 0, "abc").when(k % 29 == 1, F.upper(digest)).otherwise(digest).alias("integrity_hash"),
        F.when(k % 13 == 0, "10.0.0.300").when(k % 13 == 1, "fe80::1").when(k % 13 == 2, "1:2:3").otherwise(F.col("ip_address")).alias("ip_address"),
    )


@plan(
    "windows_events",
    f"""WITH {WINDOWS} SELECT record, coalesce("user", 'unknown') AS "user", CASE event_id WHEN 4624 THEN 'login_success' WHEN 4625 THEN 'login_failure' WHEN 4634 THEN 'logout'
      WHEN 4688 THEN 'process_creation' WHEN 4689 THEN 'process_termination' ELSE 'unknown' END AS event_type,
    CASE event_id WHEN 4624 THEN 'T1078' WHEN 4625 THEN 'T1110' WHEN 4688 THEN 'T1059' ELSE 'T0000' END AS mitre_technique,
    CASE event_id WHEN 4624 THEN 'initial_access' WHEN 4625 THEN 'initial_access' WHEN 4688 THEN 'execution' ELSE 'unknown' END AS attack_stage FROM win""",
)
def _windows(spark, sf_dir):
    # The record number rides in the time column, which is passed through unchanged.
    rows = windows_records(spark, sf_dir).withColumn("timestamp", F.col("record"))
    return normalize.normalize_windows(rows).select(
        F.col("timestamp").alias("record"), "user", "event_type", "mitre_technique", "attack_stage"
    )


_TYPES = ",".join(f"'{t}'" for t in lexicon.VALID_TYPES)
_SOURCES = ",".join(f"'{t}'" for t in lexicon.VALID_SOURCES)
ERRORS = f"""checked AS (SELECT *, CASE WHEN "user" IS NULL THEN ['Required field is null: user'] ELSE list_filter([
   CASE WHEN trim(host) = '' THEN 'host cannot be empty' END,
   CASE WHEN event_type NOT IN ({_TYPES}) THEN 'event_type ''' || event_type || ''' is not valid' END,
   CASE WHEN source NOT IN ({_SOURCES}) THEN 'source ''' || source || ''' is not valid' END,
   CASE WHEN severity = 'urgent' THEN 'severity ''urgent'' is not valid' END,
   CASE WHEN length(integrity_hash) <> 64 THEN 'integrity_hash must be 64 characters (SHA256)' END,
   CASE WHEN length(integrity_hash) = 64 AND NOT regexp_full_match(integrity_hash, '[a-f0-9]{{64}}') THEN 'integrity_hash must be valid hexadecimal' END,
   CASE WHEN ip_address IN ('10.0.0.300', '1:2:3') THEN 'ip_address must be a valid IPv4 or IPv6 address' END], lambda x: x IS NOT NULL) END AS errors FROM win)"""


@plan("validated_telemetry", f"WITH {WINDOWS}, {ERRORS} SELECT record, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors FROM checked")
def _validated(spark, sf_dir):
    checked = quality.validate_telemetry(windows_records(spark, sf_dir))
    return checked.select("record", "valid", F.array_join("errors", "; ").alias("errors"))


@plan("dead_letters", f"WITH {WINDOWS}, {ERRORS} SELECT record, tenant_id, array_to_string(errors, '; ') AS dlq_reason FROM checked WHERE len(errors) > 0")
def _dead(spark, sf_dir):
    _, bad = quality.dead_letter(quality.validate_telemetry(windows_records(spark, sf_dir)))
    return bad.select("record", "tenant_id", "dlq_reason")


@plan(
    "replayed_dead_letters",
    f"""WITH {WINDOWS}, {ERRORS} SELECT count(*) FILTER (len(list_filter(errors, lambda x: x <> 'severity ''urgent'' is not valid')) = 0) AS replayed,
    count(*) FILTER (len(list_filter(errors, lambda x: x <> 'severity ''urgent'' is not valid')) > 0) AS remaining FROM checked WHERE len(errors) > 0""",
)
def _replayed(spark, sf_dir):
    # A repaired vocabulary: urgent events are resent as critical.
    _, bad = quality.dead_letter(quality.validate_telemetry(windows_records(spark, sf_dir)))
    mended = bad.withColumn("severity", F.when(F.col("severity") == "urgent", "critical").otherwise(F.col("severity")))
    return quality.replay_counts(quality.replay_dead_letter(mended))


@plan(
    "integrity_hashes",
    f"""WITH {WINDOWS}, g AS (SELECT *, sha256(stamp || host || CAST(event_id AS VARCHAR) || event_type || coalesce("user", '')) AS expected FROM win)
    SELECT record, CASE WHEN k % 10 = 0 THEN h ELSE expected END = expected AS intact FROM g""",
)
def _integrity(spark, sf_dir):
    signed = windows_records(spark, sf_dir).withColumn(
        "integrity_hash", F.when(F.col("k") % 10 == 0, F.sha2("record", 256)).otherwise(normalize.integrity_hash())
    )
    return normalize.verify_integrity(signed).select("record", "intact")


@plan(
    "event_lexicon_join",
    f"""WITH {WINDOWS}, lex(event_id, source, event_type, severity) AS (VALUES (4624,'auth','login_success','low'),(4625,'auth','login_failure','high'),(4634,'auth','logout','low'),
      (4647,'auth','logout','low'),(4672,'auth','privilege_change','medium'),(4688,'process','process_creation','medium')),
    ep(event_id, event_type) AS (VALUES (4624,'login'),(4625,'login_failure'),(4634,'logout'),(4647,'logout'),(4672,'privilege_escalation_attempt'),(4688,'process_create'))
    SELECT record, l.source, l.event_type, l.severity, e.event_type AS endpoint_type FROM win JOIN lex l USING (event_id) JOIN ep e USING (event_id)""",
)
def _lexicon(spark, sf_dir):
    words = lexicon.event_lexicon(spark)  # some eighty rows
    rows = windows_records(spark, sf_dir).select("record", "event_id")
    own = words.filter("variant = 'collector_security'").select("event_id", "source", "event_type", "severity")
    endpoint = words.filter("variant = 'endpoint'").select("event_id", F.col("event_type").alias("endpoint_type"))
    return rows.join(F.broadcast(own), "event_id").join(F.broadcast(endpoint), "event_id").drop("event_id")


INSERTS = f"""{WINDOWS}, ins AS (SELECT record, event_id, k, list_transform(range(CASE WHEN k % 3 = 0 THEN 3 WHEN k % 3 = 1 THEN 12 ELSE 21 END),
   lambda i: CASE WHEN i IN (18, 19) AND k % 5 = 0 THEN '-' WHEN i IN (8, 10) THEN CAST(k % 14 AS VARCHAR) ELSE ' s' || CAST(i AS VARCHAR) END) AS v FROM win)"""


def insert_rows(spark, sf_dir):
    k = F.col("k")
    size = F.when(k % 3 == 0, 3).when(k % 3 == 1, 12).otherwise(21)
    values = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.when(i.isin(18, 19) & (k % 5 == 0), "-")
        .when(i.isin(8, 10), (k % 14).cast("string"))
        .otherwise(F.concat(F.lit(" s"), i.cast("string"))),
    )
    return windows_records(spark, sf_dir).select(
        "record", "event_id", values.alias("inserts"),
        F.when(k % 2 == 0, "Security").otherwise("Microsoft-Windows-Sysmon/Operational").alias("log_name"),
    )


_LOGON = "MAP {" + ",".join(f"'{c}': '{n}'" for c, n in lexicon.LOGON_TYPES.items()) + "}"


@plan(
    "parsed_inserts_auth",
    f"""WITH {INSERTS} SELECT record, trim(CASE WHEN event_id IN (4624,4634,4647) THEN v[2] WHEN event_id = 4625 THEN v[6] END) AS "user",
    CASE WHEN event_id = 4624 AND trim(v[19]) NOT IN ('', '-', '::') THEN trim(v[19]) WHEN event_id = 4625 AND trim(v[20]) NOT IN ('', '-', '::') THEN trim(v[20]) END AS ip_address,
    CASE WHEN event_id = 4624 THEN coalesce(({_LOGON})[v[11]], 'Type_' || v[11]) END AS logon_type FROM ins""",
)
def _auth_inserts(spark, sf_dir):
    return normalize.parse_inserts(insert_rows(spark, sf_dir), "auth").select("record", "user", "ip_address", "logon_type")


@plan(
    "parsed_inserts_os",
    f"""WITH {INSERTS} SELECT record, trim(CASE WHEN event_id IN (4624,4634,4647,4688,4689) THEN v[2] WHEN event_id = 4625 THEN v[6] END) AS "user",
    CASE WHEN event_id IN (4688, 4689) THEN trim(v[6]) END AS process, CASE WHEN event_id = 4688 THEN trim(v[8]) END AS parent_process,
    CASE WHEN event_id = 4688 THEN v[9] END AS command_line, CASE WHEN event_id = 4689 THEN trim(v[7]) END AS exit_code, CASE WHEN event_id = 4625 THEN v[11] END AS failure_reason,
    CASE WHEN event_id = 4624 THEN coalesce(({_LOGON})[v[9]], 'Type_' || v[9]) END AS logon_type FROM ins""",
)
def _os_inserts(spark, sf_dir):
    return normalize.parse_inserts(insert_rows(spark, sf_dir), "os").select(
        "record", "user", "process", "parent_process", "command_line", "exit_code", "failure_reason", "logon_type"
    )


@plan(
    "parsed_inserts_collector",
    f"""WITH {INSERTS} SELECT record, CASE WHEN event_id IN (4624,4625) THEN v[6] WHEN event_id IN (4634,4647,4672,4688) THEN v[2] ELSE v[1] END AS "user",
    CASE WHEN event_id IN (4624,4625) AND len(v) > 18 THEN v[9] END AS logon_type, CASE WHEN event_id IN (4624,4625) AND len(v) > 18 THEN v[20] END AS source_ip,
    CASE WHEN event_id IN (4624,4625) THEN coalesce(v[11], '') END AS auth_package, CASE WHEN event_id = 4688 THEN coalesce(v[14], '') END AS creator_process_name,
    event_id = 1 AND k % 2 = 1 AS sysmon_process_create FROM ins""",
)
def _collector_inserts(spark, sf_dir):
    return normalize.parse_inserts(insert_rows(spark, sf_dir)).select(
        "record", "user", "logon_type", "source_ip", "auth_package", "creator_process_name", "sysmon_process_create"
    )


OS = f"""{SEC}, os AS (SELECT event_id AS event_key, k, [4624, 4625, 4688, 4720, 4769, 4779, NULL][k % 7 + 1] AS event_id,
   CASE WHEN k % 6 = 0 THEN 'process_creation' WHEN k % 6 = 1 THEN 'custom' END AS event_type, CASE WHEN k % 11 = 0 THEN 'cpu_spike' WHEN k % 11 = 1 THEN 'login_failure' END AS sub_event_type,
   CASE WHEN k % 13 = 0 THEN 'security' END AS category, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'corp\\' || user_name WHEN k % 9 = 2 THEN 'SYSTEM' ELSE ' ' || user_name || ' ' END AS "user",
   CASE WHEN k % 4 = 0 THEN NULL ELSE host || ' ' END AS host, CASE WHEN k % 5 = 0 THEN 'C:\\PowerShell.exe' WHEN k % 5 = 1 THEN 'notepad.exe' END AS process,
   CAST(k AS DOUBLE) AS cpu_percent, value * 4 AS memory_mb,
   CASE k % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END AS stamp, ts FROM sec),
 osr AS (SELECT *, least(CASE WHEN sub_event_type = 'login_failure' THEN 0.8e0 ELSE 0e0 END + CASE WHEN process LIKE '%PowerShell%' THEN 0.4e0 ELSE 0e0 END
   + CASE WHEN cpu_percent > 80 THEN 0.3e0 ELSE 0e0 END + CASE WHEN memory_mb > 500 THEN 0.2e0 ELSE 0e0 END + CASE WHEN "user" = 'SYSTEM' THEN 0.1e0 ELSE 0e0 END, 1e0) AS risk FROM os)"""


def os_records(spark, sf_dir):
    k = F.col("k")
    e = security_events(spark, sf_dir)
    codes = F.array(*[F.lit(c) for c in (4624, 4625, 4688, 4720, 4769, 4779)], F.lit(None).cast("int"))
    return e.select(
        F.col("event_id").alias("event_key"),
        F.get(codes, k % 7).alias("event_id"),
        F.when(k % 6 == 0, "process_creation").when(k % 6 == 1, "custom").alias("event_type"),
        F.when(k % 11 == 0, "cpu_spike").when(k % 11 == 1, "login_failure").alias("sub_event_type"),
        F.when(k % 13 == 0, "security").alias("category"),
        F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.concat(F.lit("corp\\"), "user_name")).when(k % 9 == 2, "SYSTEM")
        .otherwise(F.concat(F.lit(" "), "user_name", F.lit(" "))).alias("user"),
        F.when(k % 4 != 0, F.concat("host", F.lit(" "))).alias("host"),
        F.when(k % 5 == 0, "C:\\PowerShell.exe").when(k % 5 == 1, "notepad.exe").alias("process"),
        k.cast("double").alias("cpu_percent"),
        (F.col("value") * 4).alias("memory_mb"),
        F.when(k % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k % 4 == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(k % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("soon")
        .alias("timestamp"),
    )


@plan(
    "unified_os_telemetry",
    f"""WITH {OS} SELECT event_key, CASE WHEN event_type = 'custom' THEN 'custom' ELSE 'os_telemetry' END AS event_type,
    coalesce(category, CASE event_id WHEN 4624 THEN 'auth' WHEN 4625 THEN 'auth' WHEN 4688 THEN 'process' WHEN 4720 THEN 'user_management' WHEN 4769 THEN 'kerberos' WHEN 4779 THEN 'session' END,
      CASE WHEN sub_event_type = 'cpu_spike' THEN 'process' END, CASE WHEN process IS NOT NULL THEN 'process' WHEN "user" IS NOT NULL THEN 'auth' ELSE 'system' END) AS category,
    coalesce(sub_event_type, CASE event_id WHEN 4624 THEN 'login_success' WHEN 4625 THEN 'login_failure' WHEN 4688 THEN 'process_creation' WHEN 4720 THEN 'user_created'
      WHEN 4769 THEN 'kerberos_service_ticket' WHEN 4779 THEN 'rdp_disconnect' END, category, 'unknown') AS sub_event_type,
    CASE WHEN risk > 0.7 THEN 'high' WHEN risk > 0.4 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN "user" IS NULL THEN 'unknown' WHEN "user" LIKE 'corp%' THEN upper(split_part("user", '\\', 1)) || '\\' || split_part("user", '\\', 2) ELSE trim("user") END AS "user",
    CASE WHEN host IS NULL THEN 'localhost' ELSE trim(upper(host)) END AS host,
    CASE k % 4 WHEN 2 THEN stamp WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS timestamp, round(risk, 6) AS risk_score FROM osr""",
)
def _os(spark, sf_dir):
    unified = normalize.unify_os_telemetry(os_records(spark, sf_dir))
    return unified.select(
        "event_key", "event_type", "category", "sub_event_type", "severity", "user", "host", "timestamp",
        F.round("risk_score", 6).alias("risk_score"),
    )


@plan(
    "os_routing",
    f"""WITH {OS}, c AS (SELECT coalesce(category, CASE event_id WHEN 4624 THEN 'auth' WHEN 4625 THEN 'auth' WHEN 4688 THEN 'process' WHEN 4720 THEN 'user_management' WHEN 4769 THEN 'kerberos' WHEN 4779 THEN 'session' END,
      CASE WHEN sub_event_type = 'cpu_spike' THEN 'process' END, CASE WHEN process IS NOT NULL THEN 'process' WHEN "user" IS NOT NULL THEN 'auth' ELSE 'system' END) AS category FROM osr)
    SELECT category, count(*) AS published, count(*) FILTER (category IN ('auth','process')) AS scored FROM c GROUP BY 1""",
)
def _route(spark, sf_dir):
    routed = normalize.os_batch_route(normalize.unify_os_telemetry(os_records(spark, sf_dir)))
    return routed.groupBy("category").agg(
        F.count_if(F.col("to_stream")).alias("published"), F.count_if(F.col("to_model")).alias("scored")
    )


@plan(
    "process_risk",
    f"""WITH {SEC}, p AS (SELECT event_id, k, CASE WHEN k % 5 = 0 THEN 'MSHTA.exe' ELSE 'vim' END AS name, CASE WHEN k % 4 = 0 THEN 'NT\\SYSTEM' ELSE user_name END AS username, parent_pid,
      value * 4 AS mem, CASE k % 3 WHEN 0 THEN 'process_creation' WHEN 1 THEN 'cpu_spike' ELSE 'process_termination' END AS kind FROM sec),
    b AS (SELECT *, (name = 'MSHTA.exe')::INT * 0.4e0 + (k > 80)::INT * 0.3e0 + (mem > 500)::INT * 0.2e0 + (parent_pid = 0)::INT * 0.1e0 + (username LIKE '%SYSTEM%')::INT * 0.1e0 AS base FROM p),
    r AS (SELECT *, least(CASE kind WHEN 'process_creation' THEN base * 0.7e0 WHEN 'cpu_spike' THEN base * 1.2e0 ELSE base END, 1e0) AS risk FROM b)
    SELECT event_id, round(risk, 6) AS process_risk, CASE WHEN kind = 'cpu_spike' OR risk > 0.7 THEN 'high' WHEN risk > 0.4 THEN 'medium' ELSE 'low' END AS process_severity FROM r""",
)
def _process(spark, sf_dir):
    k = F.col("k")
    rows = security_events(spark, sf_dir).withColumns(
        {
            "name": F.when(k % 5 == 0, "MSHTA.exe").otherwise("vim"),
            "username": F.when(k % 4 == 0, "NT\\SYSTEM").otherwise(F.col("user_name")),
            "cpu_percent": k.cast("double"),
            "memory_mb": F.col("value") * 4,
            "event_type": F.when(k % 3 == 0, "process_creation").when(k % 3 == 1, "cpu_spike").otherwise("process_termination"),
        }
    )
    return normalize.process_risk(rows).select("event_id", F.round("process_risk", 6).alias("process_risk"), "process_severity")


@plan(
    "initial_auth_risk",
    f"""WITH {SEC}, a AS (SELECT event_id, event_type, CASE k % 4 WHEN 0 THEN 'Network' WHEN 1 THEN 'NetworkCleartext' WHEN 2 THEN 'NewCredentials' ELSE 'Batch' END AS t, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE ip_address END AS ip FROM sec)
    SELECT event_id, round((event_type = 'login_failure')::INT * 0.3e0 + (t = 'Network' AND ip = 'unknown')::INT * 0.2e0 + (t IN ('NetworkCleartext','NewCredentials'))::INT * 0.4e0, 6) AS risk FROM a""",
)
def _initial(spark, sf_dir):
    k = F.col("k")
    rows = security_events(spark, sf_dir).withColumns(
        {
            "logon_type": F.when(k % 4 == 0, "Network").when(k % 4 == 1, "NetworkCleartext").when(k % 4 == 2, "NewCredentials").otherwise("Batch"),
            "ip_address": F.when(k % 3 == 0, "unknown").otherwise(F.col("ip_address")),
        }
    )
    return rows.select("event_id", F.round(normalize.initial_auth_risk(rows), 6).alias("risk"))


LINES = f"""{SEC}, lines AS (SELECT event_id, k, user_name, ip_address, CASE k % 8 WHEN 0 THEN 'sshd[1]: Failed password for invalid user ' || user_name || ' from ' || ip_address || ' port 22'
   WHEN 1 THEN 'sshd[2]: Accepted password for ' || user_name || ' from ' || ip_address || ' port 22' WHEN 2 THEN 'systemd: session opened for user ' || user_name
   WHEN 3 THEN 'systemd: session closed for user ' || user_name WHEN 4 THEN 'sudo:   ' || user_name || ' : COMMAND=/bin/ls' WHEN 5 THEN 'audit: type=1400' WHEN 6 THEN 'pam: authentication failure; user=' || user_name ELSE 'cron: job done' END AS value FROM sec)"""


def log_lines(spark, sf_dir):
    k, user, address = F.col("k"), F.col("user_name"), F.col("ip_address")
    line = (
        F.when(k % 8 == 0, F.concat(F.lit("sshd[1]: Failed password for invalid user "), user, F.lit(" from "), address, F.lit(" port 22")))
        .when(k % 8 == 1, F.concat(F.lit("sshd[2]: Accepted password for "), user, F.lit(" from "), address, F.lit(" port 22")))
        .when(k % 8 == 2, F.concat(F.lit("systemd: session opened for user "), user))
        .when(k % 8 == 3, F.concat(F.lit("systemd: session closed for user "), user))
        .when(k % 8 == 4, F.concat(F.lit("sudo:   "), user, F.lit(" : COMMAND=/bin/ls")))
        .when(k % 8 == 5, F.lit("audit: type=1400"))
        .when(k % 8 == 6, F.concat(F.lit("pam: authentication failure; user="), user))
        .otherwise("cron: job done")
    )
    return security_events(spark, sf_dir).select("event_id", line.alias("value"))


@plan(
    "parsed_auth_log",
    f"""WITH {LINES} SELECT event_id, CASE k % 8 WHEN 0 THEN 'login_failure' WHEN 1 THEN 'login_success' WHEN 2 THEN 'login_success' WHEN 3 THEN 'logout' WHEN 4 THEN 'privilege_change' ELSE 'login_failure' END AS event_type,
    CASE WHEN k % 8 IN (0, 6) THEN 'high' WHEN k % 8 = 4 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN k % 8 IN (2, 3) THEN 'user' WHEN k % 8 = 6 THEN 'unknown' ELSE user_name END AS "user", CASE WHEN k % 8 IN (0, 1) THEN ip_address ELSE '' END AS remote_ip FROM lines WHERE k % 8 IN (0,1,2,3,4,6)""",
)
def _auth_log(spark, sf_dir):
    return normalize.parse_linux_auth(log_lines(spark, sf_dir)).select("event_id", "event_type", "severity", "user", "remote_ip")


@plan("audit_lines", f"WITH {LINES} SELECT event_id FROM lines WHERE lower(value) LIKE '%audit%' OR lower(value) LIKE '%failed password%' OR lower(value) LIKE '%sudo%'")
def _audit(spark, sf_dir):
    return normalize.filter_audit_lines(log_lines(spark, sf_dir)).select("event_id")


@plan(
    "audit_documents",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'audit') OR contains(lower(text), 'failed password') OR contains(lower(text), 'sudo')",
)
def _audit_documents(spark, sf_dir):
    return normalize.filter_audit_lines(table(spark, sf_dir, "documents"), "text").select("doc_id")


@plan(
    "host_flags",
    f"""WITH {SEC}, h AS (SELECT event_id, k, CASE k % 4 WHEN 0 THEN 'SVCHOST.exe' WHEN 1 THEN 'evil.exe' ELSE 'tool.exe' END AS name, CASE k % 3 WHEN 0 THEN 'C:\\Windows\\x.exe' WHEN 1 THEN 'D:\\x.exe' ELSE 'c:\\program files\\y' END AS path,
      [22, 80, 4444, 443, 3389][k % 5 + 1] AS port, ['10.1.2.3','8.8.8.8','172.20.0.1','172.32.0.1','127.0.0.1','169.254.1.1','fe80::1','2606:4700::1111','bad',''][k % 10 + 1] AS ip FROM sec)
    SELECT event_id, NOT (name = 'SVCHOST.exe' OR k % 3 <> 1) AS unknown_process, port IN (22, 4444, 3389) OR k IN (21, 23) AS suspicious_port,
    ip IN ('8.8.8.8','172.32.0.1','2606:4700::1111') AS unusual_network_ip, k % 6 = 0 AS sensitive_file FROM h""",
)
def _flags(spark, sf_dir):
    k = F.col("k")
    name = F.when(k % 4 == 0, "SVCHOST.exe").when(k % 4 == 1, "evil.exe").otherwise("tool.exe")
    path = F.when(k % 3 == 0, "C:\\Windows\\x.exe").when(k % 3 == 1, "D:\\x.exe").otherwise("c:\\program files\\y")
    port = F.get(F.array(*map(F.lit, (22, 80, 4444, 443, 3389))), k % 5)
    address = F.get(
        F.array(*map(F.lit, ("10.1.2.3", "8.8.8.8", "172.20.0.1", "172.32.0.1", "127.0.0.1", "169.254.1.1", "fe80::1", "2606:4700::1111", "bad", ""))), k % 10
    )
    file = F.when(k % 6 == 0, "/srv/Payroll/may.xls").otherwise("/tmp/a.log")
    return security_events(spark, sf_dir).select(
        "event_id", normalize.flag_process(name, path).alias("unknown_process"),
        normalize.flag_port(port, k).alias("suspicious_port"),
        normalize.flag_public_ip(address).alias("unusual_network_ip"), normalize.flag_file(file).alias("sensitive_file"),
    )


@plan(
    "endpoint_events",
    f"""WITH {SEC} SELECT event_id, tenant_id, 'unknown' AS agent_id, host, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE user_name END AS "user", event_type, severity, pid, CAST(k AS DOUBLE) AS cpu, CAST(k * 1000 AS BIGINT) AS memory, '' AS process_name FROM sec""",
)
def _endpoint(spark, sf_dir):
    rows = security_events(spark, sf_dir).withColumns(
        {"user": F.when(F.col("k") % 3 == 0, "").otherwise(F.col("user_name")), "cpu": F.col("k"), "memory": F.col("k") * 1000}
    )
    return normalize.agent_event(rows).select(
        "event_id", "tenant_id", "agent_id", "host", "user", "event_type", "severity", "pid", "cpu", "memory", "process_name"
    )


@plan(
    "agent_heartbeats",
    f"""WITH {SEC} SELECT host AS agent_id, 'agent_heartbeat' AS event_type, 'system' AS "user", count(*) AS queue_depth FROM sec GROUP BY host""",
)
def _heartbeats(spark, sf_dir):
    agents = security_events(spark, sf_dir).groupBy(F.col("host").alias("agent_id")).agg(F.count(F.lit(1)).alias("queue_depth"))
    rows = normalize.heartbeat_events(agents)
    return rows.select("agent_id", "event_type", "user", F.get_json_object("raw_data", "$.queue_depth").cast("bigint").alias("queue_depth"))


# Routing, duplicates, watermarks --------------------------------------------------------


@plan(
    "tenant_routing",
    f"""WITH {SEC} SELECT event_id, CASE WHEN k % 4 = 0 THEN tenant_id WHEN k % 4 = 1 THEN 'meta' END AS tenant_id, k % 4 < 2 AS routed FROM sec""",
)
def _routing(spark, sf_dir):
    k = F.col("k")
    rows = security_events(spark, sf_dir).withColumns(
        {
            "tenant_id": F.when(k % 4 == 0, F.col("tenant_id")).otherwise(""),
            "metadata": F.when(k % 4 == 1, F.create_map(F.lit("tenant_id"), F.lit("meta"))),
        }
    )
    return quality.route_by_tenant(rows).select("event_id", "tenant_id", "routed")


@plan(
    "deduplicated_events",
    f"""WITH {SEC}, d AS (SELECT CASE WHEN k % 50 = 0 THEN '' ELSE 'e' || CAST(seq % 4000 AS VARCHAR) END AS event_id, us, host FROM sec)
    SELECT event_id, min(us) AS at, arg_min(host, us) AS host FROM d WHERE event_id <> '' GROUP BY 1 UNION ALL SELECT event_id, us, host FROM d WHERE event_id = ''""",
)
def _dedup(spark, sf_dir):
    rows = security_events(spark, sf_dir).select(
        F.when(F.col("k") % 50 == 0, "").otherwise(F.concat(F.lit("e"), (F.col("seq") % 4000).cast("string"))).alias("event_id"), "at", "host"
    )
    return quality.dedup_events(rows, at="at").select("event_id", "at", "host")


@plan(
    "records_after_watermark",
    f"""WITH {SEC}, s AS (SELECT host AS log_name, max(seq) AS record_number FROM sec WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT host AS log_name, seq AS record_number FROM sec LEFT JOIN s ON s.log_name = host WHERE seq > coalesce(s.record_number, 0)""",
)
def _watermark(spark, sf_dir):
    records = security_events(spark, sf_dir).select(F.col("host").alias("log_name"), F.col("seq").alias("record_number"), "ts")
    state = records.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).groupBy("log_name").agg(F.max("record_number").alias("record_number"))
    fresh, _ = quality.record_watermark(records, state)
    return fresh.select("log_name", "record_number")


@plan(
    "enriched_acceptance",
    f"""WITH {SEC} SELECT event_id, k % 3 <> 0 AND k % 5 <> 0 AS accepted FROM sec""",
)
def _accept(spark, sf_dir):
    k = F.col("k")
    rows = security_events(spark, sf_dir).withColumns(
        {
            "risk_score": F.when(k % 3 != 0, F.col("value")), "anomaly_score": F.lit(0.1),
            "processed_at": F.when(k % 5 != 0, F.col("at")), "processor_version": F.lit("1.0.0"),
        }
    )
    return quality.required_enriched(rows).select("event_id", "accepted")
