"""Raw telemetry of several shapes to common columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import lexicon, risk
from wardline.functions.casts import TYPE_DEFAULTS, safe_cast
from wardline.functions.fields import coalesce_fields, field
from wardline.functions.lookup import capped, lookup, points

MAP = "map<string,string>"
# The canonical text columns with their fallbacks, and the aliases of some.
CANONICAL_ALIASES = {
    "user": ["user", "user_id"],
    "timestamp": ["timestamp", "time"],
    "hostname": ["hostname", "host", "computer_name"],
    "ml_prediction": ["ml_prediction", "prediction", "anomaly_prediction"],
    "source": ["source"],
    "event_type": ["event_type"],
}
FALLBACK = {
    "event_id": "fallback-event",
    "hostname": "unknown",
    "source": "middleware",
    "event_type": "fallback",
    "severity": "low",
    "raw_log": "data unavailable",
    "ml_prediction": "unknown",
    "user": "unknown",
    "message": "data unavailable",
    "status": "safe_fallback",
    "attack_type": "none",
}
CANONICAL = [
    "event_id", "timestamp", "hostname", "source", "event_type", "severity", "raw_log", "parsed_fields",
    "ml_score", "ml_prediction", "metadata", "user", "message", "risk_score", "anomaly_score", "status",
    "label", "attack_type",
]


def _map(df: DataFrame, name: str) -> Column:
    empty = F.create_map().cast(MAP)
    return F.coalesce(F.col(name).cast(MAP), empty) if name in df.columns else empty


def merged(first: Column, second: Column) -> Column:
    """Both maps; keys of the second win."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def canonicalize(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Any event frame to the eighteen canonical columns, with the columns of ``keep`` beside them.

    Null stands for a missing key.  Unknown columns go to ``metadata``.  A row whose numbers
    cannot be read, or whose severity is a known word in another case, becomes the fallback
    row.  A missing id is a hash of the row; a missing time stays null.
    """
    text = {name: coalesce_fields(df, names, "unknown") for name, names in CANONICAL_ALIASES.items()}
    text["timestamp"] = coalesce_fields(df, CANONICAL_ALIASES["timestamp"])
    raw_fields = _map(df, "raw") if dict(df.dtypes).get("raw", "").startswith("map") else None
    message = coalesce_fields(df, ["message", "incident_story"], "data unavailable")
    parsed = _map(df, "parsed_fields")
    if raw_fields is None:
        raw_log = coalesce_fields(df, ["raw_log", "raw", "message"], "")
    else:
        parsed = merged(raw_fields, parsed)
        inner = F.try_element_at(raw_fields, F.lit("message"))
        raw_log = F.coalesce(coalesce_fields(df, ["raw_log"]), inner, coalesce_fields(df, ["message"], ""))
    metadata = _map(df, "metadata")
    used = {n for names in CANONICAL_ALIASES.values() for n in names[:1]} | set(CANONICAL)
    kinds = dict(df.dtypes)
    extras = [name for name in df.columns if name not in used and name not in ("raw", "raw_features", *keep)]
    if extras:
        # Plain values as text, nested ones as JSON.
        texts = {n: F.to_json(n) if kinds[n].startswith(("map", "array", "struct")) else F.col(n).cast("string") for n in extras}
        pairs = [F.struct(F.lit(n).alias("k"), text.alias("v")) for n, text in texts.items()]
        present = F.filter(F.array(*pairs), lambda e: e["v"].isNotNull())
        metadata = merged(F.map_from_entries(present), metadata)

    numbers = {name: coalesce_fields(df, names) for name, names in {
        "risk_score": ["risk_score", "ml_score"],
        "ml_score": ["ml_score", "risk_score"],
        "anomaly_score": ["anomaly_score"],
        "label": ["label"],
    }.items()}
    given = F.coalesce(coalesce_fields(df, ["severity"]), F.lit(""))
    unread = [value.isNotNull() & value.try_cast("double").isNull() for value in numbers.values()]
    broken = (F.lower(given) != given) & F.lower(given).isin(risk.SEVERITIES)
    for test in unread:
        broken = broken | test
    score = F.coalesce(numbers["risk_score"].try_cast("double"), F.lit(0.0))
    severity = F.when(F.lower(given).isin(risk.SEVERITIES), given).otherwise(risk.severity_band(score))
    identity = F.coalesce(
        coalesce_fields(df, ["event_id"]), F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in keep])), 256)
    )
    good = {
        "event_id": identity,
        **text,
        "severity": severity,
        "raw_log": raw_log,
        "parsed_fields": merged(parsed, _map(df, "raw_features")),
        "ml_score": F.coalesce(numbers["ml_score"].try_cast("double"), F.lit(0.0)),
        "metadata": metadata,
        "message": message,
        "risk_score": score,
        "anomaly_score": F.coalesce(numbers["anomaly_score"].try_cast("double"), F.lit(0.0)),
        "status": coalesce_fields(df, ["status"], "success"),
        "label": F.coalesce(numbers["label"].try_cast("double").try_cast("int"), F.lit(0)),
        "attack_type": F.coalesce(
            coalesce_fields(df, ["attack_type"]), F.try_element_at(_map(df, "metadata"), F.lit("attack_type")), F.lit("none")
        ),
    }
    blank = {
        **{name: F.lit(word) for name, word in FALLBACK.items()},
        "timestamp": text["timestamp"],
        "parsed_fields": F.create_map().cast(MAP),
        "metadata": F.create_map().cast(MAP),
        "ml_score": F.lit(0.0), "risk_score": F.lit(0.0), "anomaly_score": F.lit(0.0), "label": F.lit(0),
    }
    made = [F.when(broken, blank[name]).otherwise(good[name]).alias(name) for name in CANONICAL]
    return df.select(*made, *keep)


def fill_missing(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Defaults for null and for missing columns."""
    filled = {}
    for name, value in defaults.items():
        filled[name] = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
    return df.withColumns(filled)


def enforce_types(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The named columns in the given types (defaults where missing or unreadable); others unchanged."""
    typed = {
        name: safe_cast(name, kind) if name in df.columns else F.lit(TYPE_DEFAULTS[kind]).cast(kind)
        for name, kind in kinds.items()
    }
    return df.withColumns(typed)


def normalize_ml_output(df: DataFrame, user: str = "unknown") -> DataFrame:
    """Model output of differing column names to the common eight; unreadable rows become the fallback.

    A frame with ``probability`` and ``anomaly`` only is read as bare model output.
    """
    if "probability" in df.columns:
        score = F.coalesce(F.col("probability").try_cast("double"), F.lit(0.0))
        given = df.withColumns(
            {
                "risk_score": score,
                "prediction": F.when(score >= 0.5, "anomaly").otherwise("normal"),
                "anomaly_score": F.coalesce(F.col("anomaly").try_cast("double"), F.lit(0.0)),
            }
        )
        return normalize_ml_output(given.drop("probability", "anomaly"), user)
    score = coalesce_fields(df, ["risk_score", "supervised_probability", "ml_score"], "0")
    anomaly = coalesce_fields(df, ["anomaly_score"], "0")
    bad = score.try_cast("double").isNull() | anomaly.try_cast("double").isNull()

    def either(value: Column, fallback) -> Column:
        return F.when(bad, F.lit(fallback)).otherwise(value)

    added = {
        "user": either(coalesce_fields(df, ["user", "user_id"], user), user),
        "risk_score": either(score.try_cast("double"), 0.0),
        "prediction": either(coalesce_fields(df, ["prediction", "ml_prediction"], "unknown"), "unknown"),
        "anomaly_score": either(anomaly.try_cast("double"), 0.0),
        "status": either(coalesce_fields(df, ["status"], "success"), "safe_fallback"),
        "message": either(coalesce_fields(df, ["message"], "ml output normalized"), "data unavailable"),
    }
    keep = [name for name in ("event_id", "timestamp") if name in df.columns]
    return df.select(*keep, *[value.alias(name) for name, value in added.items()])


def normalize_windows(df: DataFrame) -> DataFrame:
    """Windows telemetry to typed events with technique and stage."""
    code = field(df, "event_id", 0)
    return df.select(
        "timestamp",
        field(df, "host", "unknown").alias("host"),
        field(df, "user", "unknown").alias("user"),
        lookup(lexicon.WINDOWS_TYPE, code, "unknown").alias("event_type"),
        field(df, "source", "windows_security").alias("source"),
        code.alias("event_id"),
        field(df, "severity", "low").alias("severity"),
        field(df, "tenant_id", "default").alias("tenant_id"),
        field(df, "process_name", "").alias("process_name"),
        field(df, "command_line", "").alias("command_line"),
        field(df, "ip_address", "").alias("ip_address"),
        lookup(lexicon.WINDOWS_TECHNIQUE, code, "T0000").alias("mitre_technique"),
        lookup(lexicon.WINDOWS_STAGE, code, "unknown").alias("attack_stage"),
    )


def _contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def os_risk(df: DataFrame) -> Column:
    """0-1 score of operating-system telemetry; an explicit score is kept."""
    process = F.lower(field(df, "process", ""))
    score = capped(
        points(
            (field(df, "sub_event_type", "") == "login_failure", 0.8),
            (_contains_any(process, lexicon.SUSPICIOUS_OS_PROCESSES), 0.4),
            (field(df, "cpu_percent", 0.0) > 80.0, 0.3),
            (field(df, "memory_mb", 0.0) > 500.0, 0.2),
            (F.lower(field(df, "user", "")).isin(lexicon.OS_SYSTEM_USERS), 0.1),
        )
    )
    return F.coalesce(F.col("risk_score").try_cast("double"), score) if "risk_score" in df.columns else score


def _iso_or_null(value: Column) -> Column:
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
    parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(pattern)) for pattern in formats])
    text = F.concat(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.when(F.contains(value, F.lit("T")), value).otherwise(text)


def unify_os_telemetry(df: DataFrame) -> DataFrame:
    """Operating-system telemetry to unified columns; an unreadable time becomes null."""
    code = field(df, "event_id", 0)
    explicit = coalesce_fields(df, ["event_type"])
    sub_given = coalesce_fields(df, ["sub_event_type"])
    category_given = coalesce_fields(df, ["category"])
    by_content = (
        F.when(F.coalesce(*[_present(df, n) for n in ("process", "pid")]), "process")
        .when(F.coalesce(*[_present(df, n) for n in ("user", "username")]), "auth")
        .otherwise("system")
    )
    user = F.trim(F.coalesce(coalesce_fields(df, ["user", "username"]), F.lit("")))
    domain = F.split(user, r"\\", 2)
    named = F.when(
        F.contains(user, F.lit("\\")), F.concat(F.upper(domain[0]), F.lit("\\"), domain[1])
    ).otherwise(user)
    host = F.coalesce(coalesce_fields(df, ["host", "hostname"]), F.lit(""))
    score = os_risk(df)
    severity = F.coalesce(
        coalesce_fields(df, ["severity"]),
        F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low"),
    )
    return df.select(
        *[name for name in ("event_key",) if name in df.columns],
        F.when(explicit.isNull() | explicit.isin(lexicon.OS_RAW_TYPES), "os_telemetry")
        .otherwise(explicit)
        .alias("event_type"),
        F.coalesce(
            category_given, lookup(lexicon.OS_CATEGORY, code), lookup(lexicon.OS_SUB_CATEGORY, sub_given), by_content
        ).alias("category"),
        F.coalesce(
            sub_given, lookup(lexicon.OS_SUB_TYPE, code), category_given, F.lit("unknown")
        ).alias("sub_event_type"),
        severity.alias("severity"),
        F.when((user == "") | (user == "unknown"), "unknown").otherwise(named).alias("user"),
        F.when((host == "") | (host == "localhost"), "localhost").otherwise(F.trim(F.upper(host))).alias("host"),
        _iso_or_null(coalesce_fields(df, ["timestamp"])).alias("timestamp"),
        coalesce_fields(df, ["process", "process_name"], "").alias("process"),
        field(df, "command_line", "").alias("command_line"),
        score.alias("risk_score"),
        field(df, "source", "os_collector").alias("source"),
        field(df, "collector", "unknown").alias("collector"),
    )


def _present(df: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull() if name in df.columns else F.lit(None).cast("boolean")


def os_batch_route(unified: DataFrame) -> DataFrame:
    """Adds ``to_stream`` and ``to_model``: all rows are published, identity and process rows also scored."""
    return unified.withColumns({"to_stream": F.lit(True), "to_model": F.col("category").isin("auth", "process")})


def process_risk(df: DataFrame, cpu: float = 80.0, memory: float = 500.0) -> DataFrame:
    """Adds ``process_risk`` and ``process_severity`` to process rows."""
    kind = field(df, "event_type", "")
    parent = F.col("parent_pid") if "parent_pid" in df.columns else F.lit(None).cast("int")
    system = _contains_any(F.lower(field(df, "username", "")), lexicon.OS_SYSTEM_USERS[1:])
    base = points(
        (_contains_any(F.lower(field(df, "name", "")), lexicon.SUSPICIOUS_PROCESSES), 0.4),
        (field(df, "cpu_percent", 0.0) > cpu, 0.3),
        (field(df, "memory_mb", 0.0) > memory, 0.2),
        (F.coalesce(parent, F.lit(0)) == 0, 0.1),
        (system, 0.1),
    )
    scaled = F.when(kind == "process_creation", base * 0.7).when(kind == "cpu_spike", base * 1.2).otherwise(base)
    scored = df.withColumn("process_risk", capped(scaled))
    return scored.withColumn(
        "process_severity",
        F.when((kind == "cpu_spike") | (F.col("process_risk") > 0.7), "high")
        .when(F.col("process_risk") > 0.4, "medium")
        .otherwise("low"),
    )


def initial_auth_risk(df: DataFrame) -> Column:
    """Score of an authentication row before any model."""
    logon, address = field(df, "logon_type", ""), field(df, "ip_address", "")
    return capped(
        points(
            (field(df, "event_type", "") == "login_failure", 0.3),
            ((logon == "Network") & address.isin("", "unknown"), 0.2),
            (logon.isin("NetworkCleartext", "NewCredentials"), 0.4),
        )
    )


def _insert(position: int) -> Column:
    """Insert string by 0-based position, null beyond the end."""
    return F.get("inserts", F.lit(position))


def _address(value: Column, *none: str) -> Column:
    trimmed = F.trim(value)
    return F.when(~trimmed.isin("", *none), trimmed)


def logon_type(code: Column) -> Column:
    return F.coalesce(lookup(lexicon.LOGON_TYPES, code), F.concat(F.lit("Type_"), code))


def parse_inserts(df: DataFrame, variant: str = "collector", sysmon_log: str = "Microsoft-Windows-Sysmon/Operational") -> DataFrame:
    """Named fields from the insert strings of a Windows record, by event id.

    Variants differ in the positions they read: ``collector``, ``auth`` and ``os``.
    """
    code = F.col("event_id")
    count = F.coalesce(F.size("inserts"), F.lit(0))

    def when(*pairs: tuple[list[int], Column]) -> Column:
        result = F.lit(None).cast("string")
        for ids, value in reversed(pairs):
            result = F.when(code.isin(ids), value).otherwise(result)
        return result

    if variant == "collector":
        full = count > 18
        sysmon = F.coalesce(F.col("log_name") == sysmon_log, F.lit(False))
        known = [4624, 4625, 4634, 4647, 4672, 4688]
        user = F.when(
            code.isin(known), when(([4624, 4625], _insert(5)), ([4634, 4647, 4672, 4688], _insert(1)))
        ).otherwise(_insert(0))
        logon = [4624, 4625]
        return df.withColumns(
            {
                "user": user,
                "logon_type": when((logon, F.when(full, _insert(8)))),
                "workstation": when((logon, F.when(full, _insert(11)))),
                "source_ip": when((logon, F.when(full, F.coalesce(_insert(19), F.lit(""))))),
                "auth_package": when((logon, F.coalesce(_insert(10), F.lit("")))),
                "session_event": when(([4634, 4647], F.lit("logout"))),
                "privilege_change": code == 4672,
                "new_process_name": when(([4688], F.coalesce(_insert(5), F.lit("")))),
                "creator_process_name": when(([4688], F.coalesce(_insert(13), F.lit("")))),
                "command_line": when(([4688], F.coalesce(_insert(8), F.lit("")))),
                "sysmon_process_create": sysmon & (code == 1),
                "sysmon_network_connection": sysmon & (code == 3),
            }
        )
    if variant == "auth":
        return df.withColumns(
            {
                "user": when(([4624, 4634, 4647], F.trim(_insert(1))), ([4625], F.trim(_insert(5)))),
                "ip_address": when(
                    ([4624], _address(_insert(18), "-", "::")), ([4625], _address(_insert(19), "-", "::"))
                ),
                "logon_type": when(([4624], logon_type(F.trim(_insert(10))))),
            }
        )
    if variant == "os":
        return df.withColumns(
            {
                "user": when(([4624, 4634, 4647, 4688, 4689], F.trim(_insert(1))), ([4625], F.trim(_insert(5)))),
                "logon_type": when(([4624], logon_type(F.trim(_insert(8))))),
                "ip_address": when(([4624], _address(_insert(18), "-")), ([4625], _address(_insert(19), "-"))),
                "failure_reason": when(([4625], F.trim(_insert(10)))),
                "process": when(([4688, 4689], F.trim(_insert(5)))),
                "parent_process": when(([4688], F.trim(_insert(7)))),
                "command_line": when(([4688], F.trim(_insert(8)))),
                "exit_code": when(([4689], F.trim(_insert(6)))),
            }
        )
    raise ValueError(f"no such variant: {variant}")


def parse_linux_auth(df: DataFrame, line: str = "value", log_source: str = "auth.log") -> DataFrame:
    """Authentication log lines to events; other lines are dropped.  The whole line is kept."""
    text = F.trim(F.col(line))
    low = F.lower(text)
    kind = (
        F.when(_contains_any(low, ["failed password", "authentication failure"]), "login_failure")
        .when(_contains_any(low, ["session opened", "accepted password"]), "login_success")
        .when(_contains_any(low, ["session closed"]), "logout")
        .when(_contains_any(low, ["sudo", "privilege"]), "privilege_change")
    )
    subject = F.nullif(F.regexp_extract(text, r"for (invalid user )?([A-Za-z0-9_.-]+)", 2), F.lit(""))
    sudo = F.when(
        F.contains(low, F.lit("sudo:")),
        F.nullif(F.regexp_extract(text, r"sudo:\s+([A-Za-z0-9_.-]+)", 1), F.lit("")),
    )
    severity = {"login_failure": "high", "login_success": "low", "logout": "low", "privilege_change": "medium"}
    parsed = df.withColumn("event_type", kind).filter("event_type IS NOT NULL")
    return parsed.withColumns(
        {
            "severity": lookup(severity, "event_type"),
            "source": F.lit("auth"),
            "status": F.lit("ok"),
            "user": F.coalesce(subject, sudo, F.lit("unknown")),
            "remote_ip": F.regexp_extract(text, r"from ([0-9a-fA-F:.]+)", 1),
            "log_source": F.lit(log_source),
            "raw_log": text,
        }
    )


def filter_audit_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Lines that speak of audits, failed passwords or sudo."""
    return df.filter(_contains_any(F.lower(F.col(line)), ["audit", "failed password", "sudo"]))


def integrity_hash(timestamp="timestamp", host="host", event_id="event_id", event_type="event_type", user="user") -> Column:
    """SHA-256 of the five identifying texts in a row; a missing one is empty, so every row has a hash."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in (timestamp, host, event_id, event_type, user)]
    return F.sha2(F.concat(*parts), 256)


def verify_integrity(df: DataFrame) -> DataFrame:
    return df.withColumn("intact", F.coalesce(F.col("integrity_hash") == integrity_hash(), F.lit(False)))


def enrich(df: DataFrame) -> DataFrame:
    """Adds ``remote_ip`` and ``request_rate`` from the parsed fields where the row has none."""
    parsed = _map(df, "parsed_fields")
    rate = F.try_element_at(parsed, F.lit("packet_rate"))
    scaled = F.when(
        rate.isNotNull(), F.coalesce(F.least(rate.try_cast("double") / 10000.0, F.lit(1.0)), F.lit(0.0))
    )
    return df.withColumns(
        {
            "remote_ip": F.coalesce(coalesce_fields(df, ["remote_ip"]), F.try_element_at(parsed, F.lit("ip_address"))),
            "request_rate": F.coalesce(
                F.col("request_rate").try_cast("double") if "request_rate" in df.columns else F.lit(None).cast("double"),
                scaled,
            ),
        }
    )


def flag_process(name: Column, path: Column) -> Column:
    """True for a process that is neither well known nor in a trusted folder."""
    low = F.lower(F.coalesce(path, F.lit("")))
    trusted = F.lit(False)
    for folder in lexicon.TRUSTED_FOLDERS:
        trusted = trusted | F.startswith(low, F.lit(folder))
    return ~F.lower(F.coalesce(name, F.lit(""))).isin(lexicon.KNOWN_PROCESSES) & ~trusted


def flag_port(remote: Column, local: Column) -> Column:
    return F.coalesce(remote.isin(lexicon.SUSPICIOUS_PORTS), F.lit(False)) | F.coalesce(
        local.isin(lexicon.SUSPICIOUS_PORTS), F.lit(False)
    )


OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
# Full, compressed, and dotted-tail forms, with an optional zone.
_H = "[0-9a-fA-F]{1,4}"
IPV6 = (
    rf"^((({_H}:){{7}}({_H}|:))|(({_H}:){{1,7}}:)|(({_H}:){{1,6}}:{_H})|(({_H}:){{1,5}}(:{_H}){{1,2}})"
    rf"|(({_H}:){{1,4}}(:{_H}){{1,3}})|(({_H}:){{1,3}}(:{_H}){{1,4}})|(({_H}:){{1,2}}(:{_H}){{1,5}})"
    rf"|({_H}:(:{_H}){{1,6}})|(:((:{_H}){{1,7}}|:)))(%[^%/]+)?$"
)
# IPv4 blocks that count as private, loopback or link-local (first and last address).
LOCAL_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
]
LOCAL_IPV6 = r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:0?db8:|100::)"


def _address_number(text: str) -> int:
    a, b, c, d = (int(part) for part in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def flag_public_ip(address: Column) -> Column:
    """True for a readable address that is not private, loopback or link-local."""
    text = F.lower(F.coalesce(address, F.lit("")))
    parts = F.split(text, r"\.")
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + F.coalesce(F.get(parts, i).try_cast("bigint"), F.lit(0))
    local = F.lit(False)
    for start, bits in LOCAL_BLOCKS:
        low = _address_number(start)
        local = local | value.between(low, low + (1 << (32 - bits)) - 1)
    v4 = text.rlike(IPV4) & ~local
    v6 = text.rlike(IPV6) & ~text.rlike(LOCAL_IPV6)
    return v4 | v6


def flag_file(path: Column) -> Column:
    return _contains_any(F.lower(F.coalesce(path, F.lit(""))), lexicon.SENSITIVE_WORDS)


def agent_event(df: DataFrame, tenant: str = "unknown", agent: str = "unknown") -> DataFrame:
    """Endpoint-event projection with its defaults."""
    words = {"host": "unknown", "machine_id": "unknown", "session_name": "unknown", "user": "unknown",
             "event_source": "process", "event_type": "unknown", "severity": "low", "process_name": "",
             "event_log_id": ""}
    return df.select(
        *[name for name in ("event_id", "timestamp") if name in df.columns],
        field(df, "tenant_id", tenant).alias("tenant_id"),
        field(df, "agent_id", agent).alias("agent_id"),
        *[F.coalesce(F.nullif(field(df, n, w), F.lit("")), F.lit(w)).alias(n) for n, w in words.items()],
        field(df, "pid", 0).alias("pid"),
        field(df, "cpu", 0.0).alias("cpu"),
        safe_cast("memory", "bigint").alias("memory") if "memory" in df.columns else F.lit(0).cast("bigint").alias("memory"),
        F.lit(0.0).alias("ml_score"),
    )


def heartbeat_events(agents: DataFrame) -> DataFrame:
    """One heartbeat event per agent row (agent_id, agent_name, queue_depth)."""
    words = {"user": "system", "event_source": "heartbeat", "event_type": "agent_heartbeat", "severity": "low"}
    beats = agents.withColumns({name: F.lit(word) for name, word in words.items()})
    body = F.struct(
        field(agents, "agent_name", "unknown").alias("agent_name"), F.col("queue_depth"), F.lit("healthy").alias("status")
    )
    return agent_event(beats.withColumn("event_log_id", F.to_json(body))).withColumnRenamed("event_log_id", "raw_data")
