"""Behaviour the operators must show on hand-made rows."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wardline.functions.rounding import exact_round
from wardline.functions.times import iso_text
from wardline.operators import alerts, behavior, chains, features, incidents, labels, normalize, quality, scoring, ueba
from wardline.sources import files

MINUTE = 60_000_000


def test_exact_round_is_pythons(spark):
    values = [k / 20000 for k in range(0, 20000, 7)] + [k / n for n in range(1, 90) for k in range(n)]
    df = spark.createDataFrame([(v, round(v, 4), round(v, 2)) for v in values], "x double, four double, two double")
    off = df.filter((exact_round(F.col("x"), 4) != F.col("four")) | (exact_round(F.col("x"), 2) != F.col("two")))
    assert off.count() == 0


def test_critical_insider_scores_high(spark):
    df = spark.createDataFrame(
        [("e", "critical", 0.9, 0.8, "insider_threat", 8)],
        "event_id string, severity string, ml_score double, user_behavior_score double, attack_type string, login_failure_count int",
    )
    row = scoring.risk_score(df).first()
    assert row.risk_score == 100 and row.severity == "critical" and row.alert
    assert row.reason == ["insider_threat_detected", "login_anomaly", "ml_anomaly", "ueba_deviation"]


def test_score_is_truncated_before_the_bands(spark):
    df = spark.createDataFrame([(0.999,)], "ml_score double").withColumn("severity", F.lit("critical"))
    assert scoring.risk_score(df).first().risk_score == 59  # 39.96 + 20, not 60


def process_rows(spark):
    rows = [
        ("host-1", "alice", "process_create", 0, 1, 200, 100, "cmd"),
        ("host-1", "alice", "process_create", 1, 2, 300, 200, "sh"),
        ("host-1", "alice", "process_create", 2, 3, 0, 5, "none"),
        ("host-1", "alice", "login", 3, 4, 400, 1, "x"),
    ]
    return spark.createDataFrame(
        rows, "host string, user_name string, event_type string, at bigint, seq bigint, pid int, parent_pid int, process_name string"
    )


def test_process_tree(spark):
    df = process_rows(spark)
    assert {(r.parent_pid, r.pid) for r in behavior.process_edges(df).collect()} == {(100, 200), (200, 300)}
    counts = behavior.node_edge_counts(df).first()
    assert (counts.node_count, counts.edge_count) == (3, 2)
    growth = {r.seq: r.node_count for r in behavior.tree_growth(df).collect()}
    assert growth == {1: 2, 2: 3, 3: 3}
    names = {r.pid: r.name for r in behavior.process_nodes(df).collect()}
    assert names == {100: "unknown", 200: "cmd", 300: "sh"}
    mapped = behavior.mitre_map(df).filter("seq = 1").first()
    assert (mapped.mitre_technique, mapped.mitre_tactic) == ("T1059", "Execution")


def test_three_event_chain_isolates_the_host(spark):
    kinds = ["login_failure", "process_create", "network_connection"]
    rows = [("host-2", "bob", i * MINUTE, i, k, "low") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "host string, user_name string, at bigint, seq bigint, event_type string, severity string")
    out = {r.seq: r for r in behavior.recommended_response(behavior.suspicious_chain(df)).collect()}
    assert out[2].suspicious_chain and out[2].response_action == "isolate_host"
    assert out[2].response_reason == "behavioral_chain_detected"
    assert out[1].response_action == "monitor_process" and out[0].response_action == "alert_only"


def incident_rows(spark, rows):
    return spark.createDataFrame(
        rows, "event_id string, at bigint, seq bigint, source string, event_type string, user_name string, risk_score double, severity string, triggers array<string>"
    )


def test_two_close_failures_are_one_incident(spark):
    df = incident_rows(spark, [
        ("a", 600 * MINUTE, 1, "auth", "login_failure", "alice", 82.0, "high", ["failed login burst"]),
        ("b", 605 * MINUTE, 2, "auth", "login_failure", "alice", 91.0, "critical", []),
        ("c", 606 * MINUTE, 3, "auth", "login_failure", "alice", 10.0, "low", []),
    ])
    rolled = incidents.incident_rollup(incidents.sessionize_incidents(df)).collect()
    assert len(rolled) == 1
    row = rolled[0]
    assert row.attack_type == "bruteforce" and row.event_count == 2 and row.severity == "critical"
    assert row.risk_score == 0.91 and row.triggers == ["failed login burst"]
    assert row.summary == (
        "Bruteforce activity correlated for user alice. 2 events were grouped between 1970-01-01T10:00:00+00:00 and "
        "1970-01-01T10:05:00+00:00 with critical severity and peak risk score 91.0. Indicators: failed login burst."
    )


def test_gap_of_ten_minutes_holds_one_second_more_splits(spark):
    make = lambda extra: incident_rows(spark, [
        ("a", 0, 1, "auth", "x", "u", 50.0, "low", []), ("b", 10 * MINUTE + extra, 2, "auth", "x", "u", 50.0, "low", []),
    ])
    assert incidents.incident_rollup(incidents.sessionize_incidents(make(0))).count() == 1
    assert incidents.incident_rollup(incidents.sessionize_incidents(make(1_000_000))).count() == 2


def test_iso_text_writes_the_fraction_only_when_there_is_one(spark):
    df = spark.createDataFrame([(0,), (1,)], "at bigint")
    assert [r[0] for r in df.select(iso_text("at")).collect()] == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:00.000001+00:00"]


def test_baseline_floors_and_order(spark):
    hour = 60 * MINUTE
    rows = [("john", "login_success", h * hour, "d1" if h < 14 else "d2", f"10.0.0.{h}", "Interactive") for h in range(8, 20)]
    rows += [("lost", "login_success", None, "d", "i", "t"), ("unknown", "login_success", 0, "d", "i", "t"), ("eve", "login_failure", 0, "d", "i", "t")]
    df = spark.createDataFrame(rows, "user string, event_type string, at bigint, device string, ip_address string, logon_type string")
    base = {r.user: r for r in ueba.build_baselines(df).collect()}
    assert set(base) == {"john", "lost", "eve"}
    john = base["john"]
    assert (john.login_success_count, john.login_failure_count, john.total_logins) == (12, 1, 13)
    assert john.failed_login_rate == round(1 / 13, 4) and john.avg_login_hour == 13.5
    assert john.known_devices == ["d1", "d2"] and john.ip_count == 10
    assert john.known_ips == [f"10.0.0.{h}" for h in range(8, 18)]
    assert base["lost"].events_analyzed == 0 and base["lost"].login_success_count == 1
    assert base["eve"].login_time_distribution == {} and base["eve"].avg_login_hour is None


def test_stored_baseline_of_the_thirty_day_user(spark):
    """180 successes over six hours a day and 6 failures give rate 0.0323, shares 0.1667, mean hour 12.0."""
    hour = 60 * MINUTE
    hours = [8, 9, 11, 13, 15, 16]
    rows = [("john.doe", "login_success", (d * 24 + h) * hour, "pc", "10.1.1.1", "Interactive") for d in range(30) for h in hours]
    rows += [("john.doe", "login_failure", (d * 24 + 2) * hour, "pc", "10.1.1.1", "Interactive") for d in range(6)]
    df = spark.createDataFrame(rows, "user string, event_type string, at bigint, device string, ip_address string, logon_type string")
    row = ueba.build_baselines(df).first()
    assert (row.login_success_count, row.login_failure_count, row.failed_login_rate) == (180, 6, 0.0323)
    assert set(row.login_time_distribution.values()) == {0.1667} and row.avg_login_hour == 12.0


def test_deviation_reasons(spark):
    hour = 60 * MINUTE
    past = spark.createDataFrame(
        [("u", "login_success", 9 * hour, "pc", "1.1.1.1", "Network")] * 3,
        "user string, event_type string, at bigint, device string, ip_address string, logon_type string",
    )
    now = spark.createDataFrame(
        [
            ("u", "login_success", 9 * hour, "pc", "1.1.1.1", "Network", (False,)),
            ("u", "login_failure", 3 * hour, "laptop", "2.2.2.2", "RemoteInteractive", (True,)),
            ("u", "logout_event", 3 * hour, "laptop", "2.2.2.2", "Network", (False,)),
            ("new", "login_success", 9 * hour, "pc", "1.1.1.1", "Network", (False,)),
        ],
        "user string, event_type string, at bigint, device string, ip_address string, logon_type string, risk_signals struct<failed_login:boolean>",
    )
    out = {(r.user, r.event_type): r for r in ueba.ueba_score(now, ueba.build_baselines(past)).collect()}
    assert out["u", "login_success"].behavior_score == 0.0
    bad = out["u", "login_failure"]
    assert bad.behavior_score == pytest.approx(0.75)
    assert bad.behavior_reasons == [
        "unusual_login_time", "new_device", "new_ip_address", "failed_login", "login_failure_detected", "unusual_logon_type",
    ]
    assert out["u", "logout_event"].behavior_reasons == []
    assert out["new", "login_success"].behavior_reasons == ["new_user_baseline"]


def test_filter_truth_table(spark):
    rows = [("windows_auth", "login_success", "alice"), ("sysmon", "login_success", "alice"), ("windows_auth", "process_creation", "alice"), ("windows_auth", "login_success", "unknown")]
    df = spark.createDataFrame(rows, "source string, event_type string, user string")
    assert ueba.ueba_filter(df).count() == 1
    stats = ueba.ueba_filter_stats(df).first()
    assert (stats.total_events, stats.passed_filter, stats.pass_rate) == (4, 1, 25.0)
    assert stats.rejected_by_type == {"login_success": 2, "process_creation": 1}


def test_labels(spark):
    rows = [("anomaly", "high", "none", ["x"]), ("normal", "low", "none", []), ("login", "low", "brute_force", []), ("login", "low", "none", ["port scan seen"]), ("login", "low", "none", [])]
    df = spark.createDataFrame(rows, "event_type string, severity string, attack_type string, triggers array<string>")
    assert [r.label for r in labels.attach_labels(df).collect()] == [1, 0, 1, 1, 0]


def test_canonical_event_of_odd_records(spark):
    rows = [
        ("98.2", 3, "HIGH-ish", None, "carol", {"tenant_id": "t9"}),
        ("abc", 3, "low", "bob", "carol", {}),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "risk_score string, failed_attempts int, severity string, user string, user_id string, metadata map<string,string>")
    good, broken, empty = normalize.canonicalize(df).collect()
    assert (good.risk_score, good.ml_score, good.severity, good.user) == (98.2, 98.2, "critical", "carol")
    assert good.metadata["failed_attempts"] == "3" and good.metadata["tenant_id"] == "t9"
    assert broken.event_id == "fallback-event" and broken.status == "safe_fallback"
    assert (empty.user, empty.severity, empty.message, empty.status) == ("unknown", "low", "data unavailable", "success")


def test_raw_map_feeds_parsed_fields(spark):
    df = spark.createDataFrame(
        [("e1", {"message": "hello", "a": "1"}, {"a": "2", "b": "3"})], "event_id string, raw map<string,string>, parsed_fields map<string,string>"
    )
    row = normalize.canonicalize(df).first()
    assert row.raw_log == "hello" and row.parsed_fields == {"message": "hello", "a": "2", "b": "3"}


@pytest.mark.parametrize(
    ("address", "valid", "public"),
    [
        ("8.8.8.8", True, True), ("10.0.0.1", True, False), ("256.1.1.1", False, False), ("01.1.1.1", False, False),
        ("::1", True, False), ("fe80::1", True, False), ("2001:4860:4860::8888", True, True), ("1:2:3:4:5:6:7:8", True, True),
        ("1::2::3", False, False), ("12345::", False, False), ("", False, False), ("172.31.255.255", True, False), ("172.32.0.0", True, True),
    ],
)
def test_addresses(spark, address, valid, public):
    df = spark.createDataFrame([(address,)], "a string")
    text = F.col("a")
    row = df.select((text.rlike(normalize.IPV4) | text.rlike(normalize.IPV6)).alias("v"), normalize.flag_public_ip(text).alias("p")).first()
    assert (row.v, row.p) == (valid, public)


def test_telemetry_missing_columns_hide_other_errors(spark):
    df = spark.createDataFrame([("not a time", "")], "timestamp string, host string")
    errors = quality.validate_telemetry(df).first().errors
    assert errors[0] == "Missing required field: user" and len(errors) == 7


def test_dedup_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("", 4), ("", 5)], "event_id string, at bigint")
    kept = sorted(r.at for r in quality.dedup_events(df, at="at").collect())
    assert kept == [1, 3, 4, 5]


def test_chain_tags(spark):
    rows = [
        (f"e{i}", i, "t", "c", f"p{i}", "p0", "critical" if i == 0 else "low", "x", [t], ["persistence"])
        for i, t in enumerate(["T1589", "T1583", "T1598", "T1200", "T1059"])
    ]
    df = spark.createDataFrame(
        rows, "event_id string, at bigint, tenant_id string, chain_id string, process_id string, parent_process_id string, severity string, event_type string, mitre_techniques array<string>, mitre_tactics array<string>"
    )
    row = chains.attack_chain(chains.chain_nodes(df)).first()
    assert (row.root_event_id, row.severity, row.phase_count, row.tree_size) == ("e0", "critical", 4, 5)
    assert row.total_anomaly_score == 30.0 + 4 * 7.0
    assert row.tags == ["critical_threat", "medium_anomaly", "multi_stage_attack", "process_tree_attack", "persistence_attempt"]


def test_alert_payload_and_approval(spark):
    df = spark.createDataFrame(
        [("e", "acme", "privilege_escalation", "critical", 82.0, "h", "u", "privilege_escalation", "T1068")],
        "event_id string, tenant_id string, event_type string, severity string, risk_score double, host string, user_name string, attack_type string, mitre_technique string",
    )
    payload = alerts.alert_payload(df)
    row = payload.first()
    assert row.recommended_action == "kill_process"
    assert row.description.endswith("MITRE technique: T1068 | Risk score: 82.00")
    rules = [("default", ["kill_process"], False)]
    policies = spark.createDataFrame(rules, "tenant_id string, allowlist_actions array<string>, auto_response_allowed boolean")
    assert alerts.kill_switch_decision(payload, policies).first().switch_status == "pending_approval"
    approved = alerts.kill_switch_decision(payload.withColumn("approved", F.lit(True)), policies)
    assert approved.first().switch_status == "executed"
    assert alerts.response_decision(spark.createDataFrame([("block_ip",)], "action_type string")).first().status == "logged_only"


def test_hash_bucket_equals_the_whole_number(spark):
    import hashlib

    words = ["", "alice", "ä", "10.0.0.1"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(features.hash_bucket("w").alias("a"), features.hash_bucket("w", 997).alias("b")).collect()
    for word, row in zip(words, got):
        whole = int(hashlib.sha256((word or "unknown").encode()).hexdigest(), 16)
        assert (row.a, row.b) == (whole % 1024, whole % 997)


def test_dataset_reports(spark):
    rows = [(float(i), 0.0, int(i >= 90)) for i in range(100)]
    check = quality.dataset_check(spark.createDataFrame(rows, "a double, b double, label int"), ["a", "b"]).first()
    assert check.valid and check.warning.startswith("Anomaly ratio 10.00%")
    one = quality.dataset_check(spark.createDataFrame(rows[:60], "a double, b double, label int"), ["a", "b"]).first()
    assert one.error == "Training requires both normal and anomaly classes."
    assert features.balance(spark.createDataFrame(rows[:60], "a double, b double, label int"), "a").count() == 0


def test_jsonl_skips_blank_and_malformed_lines(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = [json.dumps({"event_id": f"e{i}", "timestamp": f"2024-01-0{i + 1}T00:00:00Z"}) for i in range(5)]
    with open(os.path.join(folder, "a.jsonl"), "w") as out:
        out.write("\n".join([*lines[:2], "", "  ", '{"event_id": ', "not json", *lines[2:]]))
    assert files.read_events_jsonl(spark, folder).count() == 5
    assert {r.event_id for r in files.read_events_jsonl(spark, folder, limit=2).collect()} == {"e3", "e4"}
    _, bad = files.parse_json_lines(spark.read.text(folder), "event_id string")
    assert bad.count() == 2


def test_flow_loaders_match_columns_by_name(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{folder}/deep")
    with open(f"{folder}/one.csv", "w") as out:
        out.write(" Source IP,Destination Port, Protocol,Total Fwd Packets,Total Backward Packets, Label\n1.1.1.1,80,6,3,4,BENIGN\n1.1.1.2,x,17,5,,DDoS\n")
    with open(f"{folder}/deep/two.csv", "w") as out:
        out.write("Label,Source IP,Flow Duration\nBot,2.2.2.2,9.5\n")
    rows = {r.src_ip: r for r in files.load_flows_cicids(spark, folder).collect()}
    assert rows["1.1.1.1"].packets == 7.0 and rows["1.1.1.1"].label == 0
    assert rows["1.1.1.2"].dst_port == 0.0 and rows["1.1.1.2"].label == 1
    assert rows["2.2.2.2"].duration == 9.5 and rows["2.2.2.2"].attack_category == "Bot"
    assert files.load_flows_unsw(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp")) is None


def test_artifacts(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    files.write_artifacts(folder, network=df, profiles=df)
    assert spark.read.parquet(f"{folder}/network_features.parquet").count() == 1
    assert spark.read.json(f"{folder}/metadata.json").first().rows == 1
