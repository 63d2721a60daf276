"""Event vocabularies.  All tables are fixed values; callers may pass their own."""

from __future__ import annotations

# Fixed values, collector family: id -> (source, event type, severity, description)
COLLECTOR_SECURITY = {
    4624: ("auth", "login_success", "low", "Successful logon"),
    4625: ("auth", "login_failure", "high", "Failed logon"),
    4634: ("auth", "logout", "low", "User logoff"),
    4647: ("auth", "logout", "low", "User initiated logoff"),
    4672: ("auth", "privilege_change", "medium", "Special privileges assigned"),
    4688: ("process", "process_creation", "medium", "A new process has been created"),
}
COLLECTOR_SYSMON = {
    1: ("process", "process_creation", "medium", "Sysmon process create"),
    3: ("network", "network_connection", "medium", "Sysmon network connection"),
    5: ("process", "process_termination", "low", "Sysmon process termination"),
}
# Fixed values, telemetry agent: id -> (event type, severity, description)
AGENT_SECURITY = {
    4624: ("login_success", "low", "Successful logon"),
    4625: ("login_failure", "high", "Failed logon"),
    4634: ("logout", "low", "User logoff"),
    4647: ("logout", "low", "User initiated logoff"),
    4672: ("privilege_escalation", "high", "Special privileges assigned"),
    4688: ("process_creation", "medium", "Process creation"),
    4689: ("process_termination", "low", "Process termination"),
    7036: ("service_state_change", "medium", "Service started or stopped"),
    7034: ("service_crash", "high", "Service terminated unexpectedly"),
    1000: ("application_crash", "high", "Application error"),
    1001: ("application_hang", "medium", "Application hang"),
}
AGENT_SYSMON = {
    1: ("process_creation", "medium", "Process creation"),
    2: ("file_creation_time", "low", "File creation time changed"),
    3: ("network_connection", "medium", "Network connection"),
    5: ("process_termination", "low", "Process terminated"),
    6: ("driver_loaded", "medium", "Driver loaded"),
    7: ("image_loaded", "low", "Image loaded"),
    8: ("remote_thread_creation", "high", "Remote thread created"),
    9: ("raw_access_read", "high", "Raw access read"),
    10: ("process_access", "medium", "Process accessed"),
    11: ("file_create", "low", "File created"),
    12: ("registry_create_delete", "medium", "Registry object created/deleted"),
    13: ("registry_value_set", "medium", "Registry value set"),
    14: ("registry_key_value_rename", "medium", "Registry key/value renamed"),
    15: ("file_create_stream_hash", "low", "File stream created"),
    17: ("pipe_created", "medium", "Pipe created"),
    18: ("pipe_connected", "medium", "Pipe connected"),
    19: ("wmi_filter", "medium", "WMI filter"),
    20: ("wmi_consumer", "medium", "WMI consumer"),
    21: ("wmi_consumer_filter", "medium", "WMI consumer filter"),
    22: ("dns_query", "low", "DNS query"),
    23: ("file_delete", "low", "File deleted"),
    24: ("clipboard_change", "low", "Clipboard changed"),
    25: ("process_tampering", "high", "Process tampered"),
    26: ("file_delete_logged", "low", "File deleted logged"),
}
# Fixed values, endpoint agent: id -> (event type, severity, description)
ENDPOINT = {
    4624: ("login", "low", "Successful logon"),
    4625: ("login_failure", "high", "Failed logon"),
    4634: ("logout", "low", "User logoff"),
    4647: ("logout", "low", "User initiated logoff"),
    4672: ("privilege_escalation_attempt", "high", "Special privileges assigned"),
    4688: ("process_create", "medium", "Process creation"),
    7036: ("service_state_change", "medium", "Service started or stopped"),
    7034: ("system_event", "high", "Service terminated unexpectedly"),
    1000: ("application_crash", "high", "Application error"),
}
# Fixed values, operating-system collector: id -> (category, event type, severity, description)
OS_EVENTS = {
    4624: ("auth", "login_success", "low", "Successful logon"),
    4625: ("auth", "login_failure", "medium", "Failed logon"),
    4634: ("auth", "logout", "low", "User logoff"),
    4647: ("auth", "user_initiated_logout", "low", "User initiated logoff"),
    4688: ("process", "process_creation", "low", "A new process has been created"),
    4689: ("process", "process_termination", "low", "A process has exited"),
}

# Fixed values, stream of Windows telemetry: id -> type, technique, stage
WINDOWS_TYPE = {
    4624: "login_success",
    4625: "login_failure",
    4634: "logout",
    4688: "process_creation",
    4689: "process_termination",
}
WINDOWS_TECHNIQUE = {4624: "T1078", 4625: "T1110", 4688: "T1059"}
WINDOWS_STAGE = {4624: "initial_access", 4625: "initial_access", 4688: "execution"}

# Fixed values, unified operating-system telemetry: id -> category and sub type, and category of sub types
OS_CATEGORY = {
    4624: "auth", 4625: "auth", 4634: "auth",
    4688: "process", 4689: "process",
    4720: "user_management", 4722: "user_management", 4725: "user_management", 4726: "user_management",
    4738: "group_management", 4740: "group_management",
    4768: "kerberos", 4769: "kerberos", 4771: "kerberos",
    4776: "ntlm",
    4778: "session", 4779: "session",
}
OS_SUB_TYPE = {
    4624: "login_success",
    4625: "login_failure",
    4634: "logout",
    4688: "process_creation",
    4689: "process_termination",
    4720: "user_created",
    4722: "user_enabled",
    4725: "user_disabled",
    4726: "user_deleted",
    4738: "user_added_to_group",
    4740: "user_removed_from_group",
    4768: "kerberos_tgt_request",
    4769: "kerberos_service_ticket",
    4771: "kerberos_pre_auth_failed",
    4776: "ntlm_auth_attempt",
    4778: "rdp_reconnect",
    4779: "rdp_disconnect",
}
OS_SUB_CATEGORY = {
    "process_creation": "process",
    "process_termination": "process",
    "cpu_spike": "process",
    "memory_spike": "process",
}
OS_RAW_TYPES = [
    "win_event", "event_log", "process_creation", "process_termination", "cpu_spike", "memory_spike", "system_event",
]

# Logon-type codes.
LOGON_TYPES = {
    "2": "Interactive",
    "3": "Network",
    "4": "Batch",
    "5": "Service",
    "7": "Unlock",
    "8": "NetworkCleartext",
    "9": "NewCredentials",
    "10": "RemoteInteractive",
    "11": "CachedInteractive",
}

# Validation vocabulary
REQUIRED_FIELDS = [
    "timestamp", "host", "user", "event_id", "event_type", "source", "severity", "tenant_id", "integrity_hash",
]
VALID_SOURCES = ["windows_security", "windows_system", "windows_application", "sysmon"]
VALID_TYPES = [
    "login_success", "login_failure", "logout", "privilege_escalation", "process_creation",
    "process_termination", "service_state_change", "service_crash", "application_crash", "application_hang",
    "system_event", "file_creation_time", "network_connection", "driver_loaded", "image_loaded",
    "remote_thread_creation", "raw_access_read", "process_access", "file_create", "registry_create_delete",
    "registry_value_set", "registry_key_value_rename", "file_create_stream_hash", "pipe_created",
    "pipe_connected", "wmi_filter", "wmi_consumer", "wmi_consumer_filter", "dns_query", "file_delete",
    "clipboard_change", "process_tampering", "file_delete_logged",
]

# Host flags
SUSPICIOUS_PORTS = [21, 22, 23, 135, 445, 3389, 4444, 5985, 5986]
SENSITIVE_WORDS = ["credential", "secret", "payroll", "finance", "hr", "confidential"]
KNOWN_PROCESSES = [
    "system", "registry", "idle", "svchost.exe", "explorer.exe", "lsass.exe", "csrss.exe", "wininit.exe", "services.exe",
]
TRUSTED_FOLDERS = ["c:\\windows", "c:\\program files"]
SUSPICIOUS_OS_PROCESSES = ["cmd.exe", "powershell.exe", "rundll32.exe", "regsvr32.exe"]
SUSPICIOUS_PROCESSES = [
    "cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "rundll32.exe", "regsvr32.exe", "mshta.exe", "bitsadmin.exe",
]
OS_SYSTEM_USERS = ["unknown", "system", "local service", "network service"]


def event_lexicon(spark):
    """All id tables as one DataFrame: (variant, event_id, source, event_type, severity, description)."""
    rows = []
    for variant, table in (("collector_security", COLLECTOR_SECURITY), ("collector_sysmon", COLLECTOR_SYSMON), ("os", OS_EVENTS)):
        rows += [(variant, key, *values) for key, values in table.items()]
    for variant, table in (("agent_security", AGENT_SECURITY), ("agent_sysmon", AGENT_SYSMON), ("endpoint", ENDPOINT)):
        rows += [(variant, key, None, *values) for key, values in table.items()]
    return spark.createDataFrame(
        rows, "variant string, event_id int, source string, event_type string, severity string, description string"
    )
