"""Features, preparation, sampling, metrics, and round trips through the file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.operators import alerts, features, quality
from wardline.plans.registry import plan
from wardline.plans.scoring_plans import FLAGS_SQL, flagged
from wardline.plans.tables import SEC, security_events, table
from wardline.sources import files
from wardline.streaming.io import stream_sink, stream_source, to_messages
from wardline.session import shared_folder


def bucket_sql(text: str, modulus: int = 1024) -> str:
    """Last five hex digits are enough for a power of two up to 2^20."""
    return f"CAST(('0x' || right(sha256({text}), 5))::BIGINT % {modulus} AS INTEGER)"


@plan(
    "hash_buckets",
    f"""WITH {SEC} SELECT event_id, {bucket_sql("user_name")} AS user_bucket, {bucket_sql("'unknown'")} AS blank_bucket,
    CAST((('0x' || substr(sha256(user_name), 1, 16))::UBIGINT::HUGEINT % 1000 * 551616 + ('0x' || substr(sha256(user_name), 17, 16))::UBIGINT::HUGEINT % 1000) % 1000 AS INTEGER) * 0
      + CAST((((('0x' || substr(sha256(user_name), 1, 16))::UBIGINT::HUGEINT * 616 + ('0x' || substr(sha256(user_name), 17, 16))::UBIGINT::HUGEINT) % 1000 * 616
      + ('0x' || substr(sha256(user_name), 33, 16))::UBIGINT::HUGEINT) % 1000 * 616 + ('0x' || substr(sha256(user_name), 49, 16))::UBIGINT::HUGEINT) % 1000 AS INTEGER) AS odd_bucket FROM sec""",
)
def _buckets(spark, sf_dir):
    return security_events(spark, sf_dir).select(
        "event_id", features.hash_bucket("user_name").alias("user_bucket"),
        features.hash_bucket(F.lit("")).alias("blank_bucket"), features.hash_bucket("user_name", 1000).alias("odd_bucket"),
    )


@plan(
    "event_feature_rows",
    f"""WITH {SEC}, {FLAGS_SQL} SELECT event_id, {bucket_sql("event_type")}::DOUBLE AS event_type_bucket, {bucket_sql("source")}::DOUBLE AS source_bucket, {bucket_sql("user_name")}::DOUBLE AS user_bucket,
    {bucket_sql("'unknown'")}::DOUBLE AS process_bucket, {bucket_sql("ip_address")}::DOUBLE AS remote_ip_bucket, {bucket_sql("'unknown'")}::DOUBLE AS path_bucket, {bucket_sql("attack_type")}::DOUBLE AS attack_type_bucket,
    hour(ts)::DOUBLE AS hour, CASE severity WHEN 'critical' THEN 1e0 WHEN 'high' THEN 0.75e0 WHEN 'medium' THEN 0.5e0 ELSE 0.25e0 END AS severity_score,
    (event_type = 'login_failure')::INT::DOUBLE AS failed_login_flag, 0e0 AS privileged_logon_flag, (event_type = 'anomaly')::INT::DOUBLE AS anomaly_event_flag,
    unknown_process::INT::DOUBLE AS unknown_process_flag, unusual_network_ip::INT::DOUBLE AS unusual_network_ip_flag, suspicious_port::INT::DOUBLE AS suspicious_port_flag, sensitive_file_access::INT::DOUBLE AS sensitive_file_flag,
    k::DOUBLE AS cpu_percent, 0e0 AS memory_rss, 0e0 AS local_port, CASE WHEN k = 0 THEN 0e0 ELSE value / k END AS remote_port, (k % 9)::DOUBLE AS login_failure_count, 0e0 AS packet_rate, 0e0 AS bandwidth_usage,
    (k % 2 = 0)::INT::DOUBLE AS access_time_anomaly, 0e0 AS privilege_level_change, value AS risk_score FROM flagged""",
)
def _event_features(spark, sf_dir):
    k = F.col("k")
    rows = flagged(spark, sf_dir).withColumns(
        {
            "remote_ip": F.col("ip_address"),
            "cpu_percent": k,
            "remote_port": F.when(k == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("value"), k)),
            "login_failure_count": k % 9,
            "access_time_anomaly": k % 2 == 0,
            "risk_score": F.col("value"),
        }
    )
    return features.event_features(rows)


# Line items read as network flows -------------------------------------------------------

FLOW = """raw AS (SELECT l_orderkey, l_linenumber, l_shipdate AS ts, l_extendedprice AS bytes_sent, l_extendedprice * l_discount AS bytes_received,
   CASE WHEN l_linenumber = 1 THEN 0e0 ELSE l_quantity END AS packets, l_tax * 1000 AS duration, CASE l_returnflag WHEN 'R' THEN 'tcp' WHEN 'A' THEN '17' ELSE 'icmp' END AS protocol,
   CAST(l_partkey % 6000 AS INTEGER) AS dst_port, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
 ends AS (SELECT min(duration) AS lo, max(duration) AS hi FROM raw),
 feat AS (SELECT raw.*, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, CASE WHEN packets = 0 THEN 0e0 ELSE (bytes_sent + bytes_received) / packets END AS avg_packet_size,
   bytes_sent / (bytes_received + 1) AS bytes_ratio, (bytes_sent + bytes_received) / (duration + 1) AS bytes_per_second,
   (protocol = 'tcp')::INT AS proto_tcp, (protocol = '17')::INT AS proto_udp, (protocol = 'icmp')::INT AS proto_icmp,
   (dst_port BETWEEN 1 AND 1024 OR dst_port IN (22,23,135,139,445,3389,4444,5985,5986))::INT AS dst_port_risky, ln(1 + duration) AS duration_log, (duration - lo) / (hi - lo + 1e-9) AS duration_norm FROM raw, ends)"""
_EXACT = ["avg_packet_size", "bytes_ratio", "bytes_per_second", "duration_norm", "bytes_received", "duration"]


def network_flows(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("bytes_sent"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("bytes_received"),
        F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity")).alias("packets"),
        (F.col("l_tax") * 1000).alias("duration"),
        F.when(F.col("l_returnflag") == "R", "tcp").when(F.col("l_returnflag") == "A", "17").otherwise("icmp").alias("protocol"),
        (F.col("l_partkey") % 6000).alias("dst_port"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


@plan(
    "network_flow_features",
    f"""WITH {FLOW} SELECT l_orderkey, l_linenumber, hour, day_of_week, proto_tcp, proto_udp, proto_icmp, dst_port_risky, {", ".join(_EXACT)}, round(duration_log, 9) AS duration_log FROM feat""",
)
def _flow_features(spark, sf_dir):
    made = features.flow_features(network_flows(spark, sf_dir))
    return made.select(
        "l_orderkey", "l_linenumber", "hour", "day_of_week", "proto_tcp", "proto_udp", "proto_icmp", "dst_port_risky",
        *_EXACT, F.round("duration_log", 9).alias("duration_log"),
    )


@plan(
    "training_set_summary",
    f"""WITH {FLOW} SELECT label, count(*) AS n, CAST(sum(day_of_week) AS BIGINT) AS weekdays, round(avg(duration_norm), 4) AS duration_norm, round(avg(bytes_ratio), 3) AS bytes_ratio, CAST(sum(dst_port_risky) AS BIGINT) AS risky FROM feat GROUP BY 1""",
)
def _training(spark, sf_dir):
    rows = features.training_set(features.flow_features(network_flows(spark, sf_dir)))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("day_of_week").alias("weekdays"), F.round(F.avg("duration_norm"), 4).alias("duration_norm"),
        F.round(F.avg("bytes_ratio"), 3).alias("bytes_ratio"), F.sum("dst_port_risky").alias("risky"),
    )


@plan(
    "scaled_flows",
    f"""WITH {FLOW}, e AS (SELECT min(bytes_sent) AS a, max(bytes_sent) AS b, min(packets) AS c, max(packets) AS d FROM raw)
    SELECT l_orderkey, l_linenumber, round((bytes_sent - a) / (b - a), 6) AS bytes_sent, round((packets - c) / (d - c), 6) AS packets, 0e0 AS constant FROM raw, e""",
)
def _scaled(spark, sf_dir):
    rows = network_flows(spark, sf_dir).select("l_orderkey", "l_linenumber", "bytes_sent", "packets").withColumn("constant", F.lit(7.0))
    scaled = features.minmax_scale(rows, ["bytes_sent", "packets", "constant"])
    return scaled.withColumns({n: F.round(n, 6) for n in ("bytes_sent", "packets")})


@plan(
    "auth_feature_flags",
    f"""WITH {SEC}, a AS (SELECT event_id, ts, CASE k % 4 WHEN 0 THEN 'kerberos5' WHEN 1 THEN 'Ntlm' WHEN 2 THEN 'NEGOTIATE' ELSE NULL END AS t, CASE k % 3 WHEN 0 THEN 'RemoteInteractive' WHEN 1 THEN 'network' ELSE 'Batch' END AS l FROM sec)
    SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, (t = 'kerberos5' AND t IS NOT NULL)::INT AS auth_kerberos, coalesce(t = 'Ntlm', false)::INT AS auth_ntlm, coalesce(t = 'NEGOTIATE', false)::INT AS auth_negotiate,
    (l = 'RemoteInteractive')::INT AS logon_interactive, (l = 'network')::INT AS logon_network, (l = 'Batch')::INT AS logon_batch FROM a""",
)
def _auth_flags(spark, sf_dir):
    k = F.col("k")
    rows = security_events(spark, sf_dir).select(
        "event_id", F.col("ts").alias("timestamp"),
        F.when(k % 4 == 0, "kerberos5").when(k % 4 == 1, "Ntlm").when(k % 4 == 2, "NEGOTIATE").alias("auth_type"),
        F.when(k % 3 == 0, "RemoteInteractive").when(k % 3 == 1, "network").otherwise("Batch").alias("logon_type"),
    )
    made = features.auth_features(rows)
    return made.drop("timestamp", "auth_type", "logon_type", "failed_logins")


# Labels: quality is the class, toxic the prediction --------------------------------------


@plan(
    "balanced_labels",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR))) AS rn FROM labels)
    SELECT doc_id, quality FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def _balanced(spark, sf_dir):
    return features.balance(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality")


@plan(
    "balanced_flows",
    f"""WITH {FLOW}, k AS (SELECT label, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(ts AS DATE)::VARCHAR || '-' || CAST(dst_port AS VARCHAR) AS key FROM raw),
    r AS (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || key)) AS rn FROM k)
    SELECT label, count(*) AS n FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM raw GROUP BY label)) GROUP BY 1""",
)
def _balanced_flows(spark, sf_dir):
    keyed = network_flows(spark, sf_dir).withColumn(
        "key", F.concat_ws("-", "l_orderkey", "l_linenumber", F.to_date("timestamp"), F.col("dst_port"))
    )
    return features.balance(keyed, "key").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "stratified_split",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)
    SELECT doc_id, quality, rn <= ceil(n * 0.25e0) AS is_test FROM r""",
)
def _split(spark, sf_dir):
    return features.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "is_test")


@plan(
    "classification_metrics",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels),
    s AS (SELECT quality, (doc_id * 37 % 1000) / 1000e0 AS s FROM labels),
    a AS (SELECT sum(CASE WHEN p.s > n.s THEN 1e0 WHEN p.s = n.s THEN 0.5e0 ELSE 0e0 END) / count(*) AS auc FROM s p, s n WHERE p.quality = 1 AND n.quality <> 1)
    SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(auc, 6) AS auc FROM c, a""",
)
def _metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("score", (F.col("doc_id") * 37 % 1000) / 1000.0)
    rated = features.classification_metrics(rows, "quality", "toxic", "score")
    return rated.select("tp", "fp", "tn", "fn", *[F.round(n, 6).alias(n) for n in ("accuracy", "precision", "recall", "f1", "auc")])


@plan(
    "flow_score_auc",
    f"""WITH {FLOW}, s AS (SELECT label, (bytes_sent - min(bytes_sent) OVER ()) / (max(bytes_sent) OVER () - min(bytes_sent) OVER ()) AS s FROM raw),
    r AS (SELECT label, avg(rn) OVER (PARTITION BY s) AS rk FROM (SELECT *, row_number() OVER (ORDER BY s) AS rn FROM s)),
    c AS (SELECT sum(rk) FILTER (label = 1) AS w, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r)
    SELECT round((w - p * (p + 1) / 2e0) / (p * q::DOUBLE), 6) AS auc FROM c""",
)
def _flow_auc(spark, sf_dir):
    rows = features.minmax_scale(network_flows(spark, sf_dir).select("label", "bytes_sent"), ["bytes_sent"])
    return features.exact_auc(rows, "label", "bytes_sent").select(F.round("auc", 6).alias("auc"))


@plan(
    "dataset_report",
    f"""WITH {SEC}, t AS (SELECT CASE WHEN k < 15 THEN 'normal' ELSE event_type END AS kind FROM sec WHERE k % 5 <> 0 AND k % 7 <> 0),
    c AS (SELECT count(*) AS t, count(*) FILTER (kind = 'normal') AS n, count(*) FILTER (kind <> 'normal') AS a FROM t)
    SELECT t AS total_events, n AS normal_count, a AS anomaly_count, round(least(n, a) / greatest(n, a)::DOUBLE, 6) AS imbalance_ratio, least(n, a) / greatest(n, a)::DOUBLE >= 0.2 AS valid,
    CASE WHEN least(n, a) / greatest(n, a)::DOUBLE >= 0.2 THEN 'dataset validated' ELSE 'Training blocked: imbalance ratio ' || printf('%.2f', least(n, a) / greatest(n, a)::DOUBLE) || ' is below the threshold of 0.20.' END AS message FROM c""",
)
def _report(spark, sf_dir):
    return quality.dataset_report(eligible_rows(spark, sf_dir)).withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


def eligible_rows(spark, sf_dir):
    k = F.col("k")
    return security_events(spark, sf_dir).withColumns(
        {
            "status": F.when(k % 5 == 0, "failed").otherwise("ok"),
            "source": F.when(k % 7 == 0, "file_monitor").otherwise(F.col("source")),
            "event_type": F.when(k < 15, "normal").otherwise(F.col("event_type")),
        }
    )


@plan("event_type_distribution", f"WITH {SEC} SELECT CASE WHEN k < 15 THEN 'normal' ELSE event_type END AS event_type, count(*) AS n FROM sec WHERE k % 5 <> 0 AND k % 7 <> 0 GROUP BY 1")
def _distribution(spark, sf_dir):
    return quality.event_type_distribution(eligible_rows(spark, sf_dir))


@plan(
    "dataset_check",
    f"""WITH {SEC}, c AS (SELECT count(*) AS t, count(*) FILTER (k < 10) AS a FROM sec) SELECT t AS total_samples, t - a AS normal_count, a AS anomaly_count, 2 AS feature_count, round(a / t::DOUBLE, 6) AS anomaly_ratio,
    true AS valid, CASE WHEN a / t::DOUBLE < 0.2 THEN 'Anomaly ratio ' || printf('%.2f%%', a / t::DOUBLE * 100) || ' is below 20%; rebalancing required before training.' END AS warning FROM c""",
)
def _check(spark, sf_dir):
    rows = security_events(spark, sf_dir).withColumn("label", (F.col("k") < 10).cast("int"))
    checked = quality.dataset_check(rows, ["value", "k"])
    return checked.withColumn("anomaly_ratio", F.round("anomaly_ratio", 6)).drop("error")


@plan("analyst_feedback", f"WITH {SEC} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'false_positive' ELSE 'confirmed_threat' END AS label FROM sec WHERE k % 3 < 2")
def _feedback(spark, sf_dir):
    k = F.col("k")
    word = F.when(k % 3 == 0, "false_positive").when(k % 3 == 1, "confirmed_threat").otherwise("maybe")
    return alerts.append_feedback(security_events(spark, sf_dir).withColumn("label", word)).select("event_id", "label")


# Round trips through files ---------------------------------------------------------------


def scratch(spark, name: str) -> str:
    """A fresh folder below the cluster's shared one."""
    return f"{shared_folder(spark)}/round-trips/{name}-{uuid.uuid4().hex}"


@plan(
    "events_from_json_lines",
    f"WITH {SEC} SELECT event_id, host AS hostname, severity, CAST(k AS VARCHAR) AS risk_score FROM sec WHERE k % 10 <> 0",
)
def _jsonl(spark, sf_dir):
    k = F.col("k")
    body = F.to_json(F.struct("event_id", F.col("host").alias("hostname"), "severity", k.cast("string").alias("risk_score")))
    folder = scratch(spark, "events")
    lines = security_events(spark, sf_dir).select(F.when(k % 20 == 0, F.lit("   ")).when(k % 20 == 10, F.substring(body, 1, 30)).otherwise(body).alias("value"))
    lines.write.text(folder)
    return files.read_events_jsonl(spark, folder).select("event_id", "hostname", "severity", "risk_score")


@plan("event_store_round_trip", f"WITH {SEC} SELECT CAST(ts AS DATE)::VARCHAR AS day, tenant_id, count(*) AS n, max(us) AS last_at FROM sec GROUP BY ALL")
def _store(spark, sf_dir):
    folder = scratch(spark, "store")
    files.append_events(security_events(spark, sf_dir).select("event_id", "at", "tenant_id", "severity"), folder)
    kept = spark.read.parquet(folder)
    return kept.groupBy(F.col("day").cast("string").alias("day"), "tenant_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))


@plan("timeline_round_trip", f"WITH {SEC} SELECT event_id, host AS host_id, 'forensic' AS mode, 0 AS tags FROM sec WHERE tenant_id = 't1'")
def _trip(spark, sf_dir):
    folder = scratch(spark, "timeline")
    events = security_events(spark, sf_dir).withColumnRenamed("host", "host_id").select("event_id", "tenant_id", "host_id", "severity")
    files.timeline_export(events, "t1", folder)
    return files.timeline_import(spark, folder).select("event_id", "host_id", "mode", F.size("tags").alias("tags"))


@plan(
    "cicids_flows",
    f"""WITH {FLOW} SELECT protocol, label, count(*) AS n, round(sum(packets + l_linenumber), 2) AS packets, CAST(sum(dst_port) AS BIGINT) AS ports FROM raw GROUP BY ALL""",
)
def _cicids(spark, sf_dir):
    rows = network_flows(spark, sf_dir).select(
        F.lit("10.0.0.1").alias(" Source IP"), F.col("dst_port").alias("Destination Port"), F.col("protocol").alias(" Protocol"),
        F.col("duration").alias("Flow Duration"), F.col("packets").alias("Total Fwd Packets"),
        F.col("l_linenumber").alias("Total Backward Packets"), F.when(F.col("label") == 1, "DDoS").otherwise("Benign").alias("Label"),
    )
    folder = scratch(spark, "cicids")
    rows.write.csv(folder, header=True)
    flows = files.load_flows_cicids(spark, folder)
    return flows.groupBy("protocol", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("packets"), 2).alias("packets"), F.sum("dst_port").cast("bigint").alias("ports")
    )


@plan(
    "flow_datasets_union",
    f"""WITH {FLOW} SELECT 'CICIDS2017' AS dataset, label, count(*) AS n FROM raw GROUP BY ALL UNION ALL SELECT 'UNSW-NB15', label, count(*) FROM raw GROUP BY ALL""",
)
def _union(spark, sf_dir):
    rows = network_flows(spark, sf_dir)
    first = files.cicids_flows(rows.select(F.when(F.col("label") == 1, "Bot").otherwise("BENIGN").alias("label"), "protocol"))
    folder = scratch(spark, "unsw")
    rows.select(F.col("protocol").alias("proto"), F.col("duration").alias("dur"), F.col("label").alias("Label")).write.csv(folder, header=True)
    whole = files.union_datasets(first, files.load_flows_unsw(spark, folder), None)
    return whole.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "lanl_auth_flows",
    f"""WITH {SEC} SELECT 'Kerberos:Network' AS action, host AS source_host, CAST(sum(CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS failed, CAST(max(us // 1000000) AS BIGINT) AS last_second FROM sec GROUP BY host""",
)
def _lanl(spark, sf_dir):
    k = F.col("k")
    rows = security_events(spark, sf_dir).select(
        F.expr("at div 1000000").alias("time"), F.col("user_name").alias("user"), F.col("host").alias("src"), F.col("device").alias("dst"),
        F.lit("Kerberos").alias("auth_type"), F.lit("Network").alias("logon_type"), F.lit("LogOn").alias("auth_orientation"),
        F.when(k % 3 == 0, "Success").otherwise("Fail").alias("success"),
    )
    folder = scratch(spark, "lanl")
    rows.filter(k % 2 == 0).write.csv(f"{folder}/a", header=True)
    rows.filter(k % 2 == 1).select(F.concat_ws(",", *rows.columns).alias("value")).write.option("compression", "gzip").text(f"{folder}/b")
    flows = files.load_auth_lanl(spark, folder)
    return flows.groupBy("action", "source_host").agg(
        F.sum("failed_logins").alias("failed"), F.unix_seconds(F.max("timestamp")).alias("last_second")
    )


# Artifacts and messages ------------------------------------------------------------------


@plan(
    "artifact_manifest",
    f"""WITH {FLOW} SELECT 'network_features' AS dataset, count(*) AS rows, count(*) AS stored, '1.0' AS pipeline_version, CAST(sum(day_of_week) AS BIGINT) AS checked FROM feat
    UNION ALL SELECT 'training_set', count(*), count(*), '1.0', CAST(sum(label) AS BIGINT) FROM feat
    UNION ALL SELECT 'ueba_profiles', count(*), count(*), '1.0', CAST(sum(n) AS BIGINT) FROM (SELECT protocol, count(*) AS n FROM raw GROUP BY protocol)""",
)
def _artifacts(spark, sf_dir):
    """Tables written with their manifest, and both read back."""
    place = scratch(spark, "artifacts")
    made = features.flow_features(network_flows(spark, sf_dir))
    profiles = made.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))
    files.write_artifacts(place, network=made, training=features.training_set(made), profiles=profiles)
    stored = {
        "network_features": (spark.read.parquet(f"{place}/network_features.parquet"), "day_of_week"),
        "training_set": (spark.read.parquet(f"{place}/training_set.parquet"), "label"),
        "ueba_profiles": (spark.read.schema("protocol string, n bigint").json(f"{place}/ueba_profiles.json"), "n"),
    }
    counted = None
    for name, (df, column) in stored.items():
        row = df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("stored"), F.sum(column).cast("bigint").alias("checked"))
        counted = row if counted is None else counted.unionByName(row)
    return files.read_manifest(spark, place).join(counted, "dataset")


@plan(
    "source_messages",
    f"""WITH {SEC} SELECT CASE WHEN k % 7 = 0 THEN 'default' ELSE tenant_id END AS key, event_id, severity, '1.0.0' AS processor_version FROM sec WHERE k % 5 <> 0""",
)
def _messages(spark, sf_dir):
    """Text files through the stream source to keyed messages; lines that are no records are skipped."""
    k = F.col("k")
    body = F.to_json(F.struct("event_id", F.when(k % 7 != 0, F.col("tenant_id")).alias("tenant_id"), "severity"))
    lines = security_events(spark, sf_dir).select(F.when(k % 5 == 0, F.substring(body, 1, 9)).otherwise(body).alias("value"))
    place = scratch(spark, "messages")
    lines.write.text(f"{place}/lines")
    sent = to_messages(stream_source(spark, path=f"{place}/lines").select("event_id", "tenant_id", "severity"))
    stream_sink(sent, f"{place}/checkpoint", path=f"{place}/rows", once=True).start().awaitTermination()
    value = spark.read.parquet(f"{place}/rows")
    return value.select("key", *[F.get_json_object("value", f"$.{n}").alias(n) for n in ("event_id", "severity", "processor_version")])
