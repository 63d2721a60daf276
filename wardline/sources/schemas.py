"""Explicit schemas: reads never infer types."""

from __future__ import annotations

TEXT_MAP = "map<string,string>"

CANONICAL_EVENT = (
    "event_id string, timestamp string, hostname string, source string, event_type string, severity string, "
    f"raw_log string, parsed_fields {TEXT_MAP}, ml_score string, ml_prediction string, metadata {TEXT_MAP}, "
    "user string, message string, risk_score string, anomaly_score string, status string, label string, "
    "attack_type string, tenant_id string, user_id string, host string, computer_name string, time string"
)
TIMELINE_EVENT = (
    "timestamp string, event_id string, tenant_id string, host_id string, user_id string, process_id string, "
    "parent_process_id string, process_name string, event_type string, severity string, source string, "
    f"mitre_techniques array<string>, mitre_tactics array<string>, details {TEXT_MAP}, mode string, tags array<string>"
)
WINDOWS_TELEMETRY = (
    "timestamp string, host string, user string, event_id int, event_type string, source string, severity string, "
    "tenant_id string, integrity_hash string, process_name string, command_line string, ip_address string, raw_event string"
)
AUTH_FLOW = (
    "time string, user string, src string, dst string, auth_type string, logon_type string, "
    "auth_orientation string, success string"
)
FEEDBACK = "event_id string, label string, analyst string, notes string, timestamp string"
