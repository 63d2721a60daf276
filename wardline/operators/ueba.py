"""User behaviour: identity events, per-user baselines, deviation scores, activity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.fields import beside, coalesce_fields, field
from wardline.functions.lookup import capped, lookup, points, reasons
from wardline.functions.rounding import exact_round

# Identity event ids and types, names that are no user, list sizes.
AUTH_EVENT_TYPES = {
    4624: "login_success",
    4625: "login_failure",
    4634: "logout_event",
    4647: "logout_event",
}
IDENTITY_TYPES = ["login_success", "login_failure", "logout_event"]
NO_USERS = ["unknown", "system", "local service"]
ODD_LOGON_TYPES = ["RemoteInteractive", "NetworkCleartext", "NewCredentials"]
SCORED_LOGON_TYPES = ["RemoteInteractive", "NetworkCleartext"]
KNOWN_LIMIT = 10
RARE_HOUR = 0.05


def to_ueba(df: DataFrame) -> DataFrame:
    """Windows authentication rows to identity events; other ids and nameless rows are dropped."""
    code = field(df, "event_id", 0)
    user = F.trim(field(df, "user", ""))
    device = F.trim(F.coalesce(F.nullif(coalesce_fields(df, ["host", "source_device"]), F.lit("")), F.lit("unknown")))
    logon = field(df, "logon_type", "unknown")
    return (
        df.filter((field(df, "user", "") != "") & (field(df, "user", "") != "unknown"))
        .withColumn("_kind", lookup(AUTH_EVENT_TYPES, code))
        .filter("_kind IS NOT NULL")
        .select(
            user.alias("user"),
            device.alias("device"),
            device.alias("source_device"),
            F.col("_kind").alias("event_type"),
            code.alias("auth_event_id"),
            F.col("timestamp").cast("string").alias("timestamp"),
            F.lit("windows_auth").alias("source"),
            F.lit("windows_security").alias("raw_source"),
            field(df, "ip_address", "unknown").alias("ip_address"),
            logon.alias("logon_type"),
            F.struct(
                (code == 4625).alias("failed_login"),
                F.lit(False).alias("new_device"),
                F.lit(False).alias("impossible_travel"),
                F.lit(False).alias("brute_force_attempt"),
                logon.isin(ODD_LOGON_TYPES).alias("unusual_logon_type"),
            ).alias("risk_signals"),
            field(df, "record_number", 0).alias("record_id"),
            F.lit("ok").alias("status"),
        )
    )


def is_identity_event(df: DataFrame) -> Column:
    """Rows from the authentication source, of an identity type, with a real user."""
    user = F.lower(field(df, "user", ""))
    return (
        (F.lower(field(df, "source", "")) == "windows_auth")
        & F.lower(field(df, "event_type", "")).isin(IDENTITY_TYPES)
        & (user != "")
        & ~user.isin(NO_USERS)
    )


def ueba_filter(df: DataFrame) -> DataFrame:
    return df.filter(is_identity_event(df))


def ueba_filter_stats(df: DataFrame) -> DataFrame:
    """One row: totals and pass rate, with rejected counts by type and by source as maps."""
    marked = df.select(
        is_identity_event(df).alias("_ok"),
        field(df, "event_type", "unknown").alias("event_type"),
        field(df, "source", "unknown").alias("source"),
    )
    cells = marked.groupBy("_ok", "event_type", "source").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum(F.when(F.col("_ok"), F.col("n"))), F.lit(0)).alias("passed_filter"),
    )

    def counted(name: str) -> DataFrame:
        pairs = cells.filter(~F.col("_ok")).groupBy(name).agg(F.sum("n").alias("n"))
        return pairs.agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(f"rejected_by_{name}")
        ).withColumnRenamed("rejected_by_event_type", "rejected_by_type")

    share = F.col("passed_filter") / F.col("total_events") * 100
    rated = totals.withColumn("rejected", F.col("total_events") - F.col("passed_filter")).withColumn(
        "pass_rate", F.when(F.col("total_events") > 0, F.bround(share, 2)).otherwise(0.0)
    )
    return beside(beside(rated, counted("event_type")), counted("source"))


def _identity_rows(df: DataFrame, user: str, at: str) -> DataFrame:
    device = F.coalesce(
        F.nullif(coalesce_fields(df, ["device", "source_device"]), F.lit("")), F.lit("unknown")
    )
    kind = F.lower(F.coalesce(F.col("event_type"), F.lit("")))
    name = F.trim(F.coalesce(F.col(user), F.lit("unknown")))
    return df.select(
        name.alias("user"),
        kind.alias("kind"),
        F.col(at).alias("at"),
        F.hour(F.timestamp_micros(F.col(at))).alias("hour"),
        device.alias("device"),
        field(df, "ip_address", "unknown").alias("ip"),
        field(df, "logon_type", "unknown").alias("logon_type"),
    ).filter((F.col("user") != "") & (F.col("user") != "unknown") & F.col("kind").isin(IDENTITY_TYPES))


def baseline_totals(df: DataFrame, user: str = "user", at: str = "at") -> DataFrame:
    """Counts per user.  Success and failure counts are at least 1, as later rates divide by them."""
    timed = F.col("at").isNotNull()

    def seen(kind: str) -> Column:
        return F.count(F.when(timed & (F.col("kind") == kind), 1))

    counts = (
        _identity_rows(df, user, at)
        .groupBy("user")
        .agg(
            F.greatest(seen("login_success"), F.lit(1)).alias("login_success_count"),
            F.greatest(seen("login_failure"), F.lit(1)).alias("login_failure_count"),
            seen("logout_event").alias("logout_count"),
            F.count("at").alias("events_analyzed"),
        )
        .withColumn("total_logins", F.col("login_success_count") + F.col("login_failure_count"))
        .withColumn("_rate", F.col("login_failure_count") / F.col("total_logins"))
    )
    return counts.withColumn("failed_login_rate", exact_round(F.col("_rate"), 4)).drop("_rate")


def baseline_shares(df: DataFrame, user: str = "user", at: str = "at", limit: int = KNOWN_LIMIT) -> DataFrame:
    """(user, dimension, value, count, share, rank) from successful logins.

    Dimensions are hour, device, ip and logon_type; of devices and ips the ``limit`` most used
    are kept, the first seen first among equals.  The counts are combined before the shuffle and
    the ranking sees counts only, so a busy user costs no more than its distinct values.
    """
    rows = _identity_rows(df, user, at)
    wins = rows.filter((F.col("kind") == "login_success") & F.col("at").isNotNull())
    sides = F.explode(
        F.create_map(
            F.lit("hour"), F.col("hour").cast("string"),
            F.lit("device"), F.col("device"),
            F.lit("ip"), F.col("ip"),
            F.lit("logon_type"), F.col("logon_type"),
        )
    ).alias("dimension", "value")
    counted = (
        wins.select("user", "at", sides)
        .groupBy("user", "dimension", "value")
        .agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first_at"))
    )
    order = Window.partitionBy("user", "dimension").orderBy(F.desc("count"), "first_at", "value")
    listed = counted.filter(F.col("dimension").isin("device", "ip")).withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= limit)
    whole = counted.filter(F.col("dimension").isin("hour", "logon_type")).withColumn("rank", F.lit(0))
    totals = baseline_totals(df, user, at).select("user", "login_success_count")
    shares = listed.unionByName(whole).join(totals, "user").withColumn(
        "_share", F.col("count") / F.col("login_success_count")
    )
    return shares.withColumn("share", exact_round(F.col("_share"), 4)).drop("_share", "login_success_count")


def build_baselines(df: DataFrame, user: str = "user", at: str = "at", limit: int = KNOWN_LIMIT) -> DataFrame:
    """One baseline row per user: counts, hour and logon-type shares, known devices and addresses.

    Every collected list is bounded: 24 hours, ``limit`` devices and ips, the logon-type words.
    """
    shares = baseline_shares(df, user, at, limit)

    def entries(dimension: str) -> Column:
        row = F.when(F.col("dimension") == dimension, F.struct("rank", "value", "share"))
        return F.array_sort(F.collect_list(row))

    def as_map(name: str) -> Column:
        return F.map_from_entries(F.transform(name, lambda e: F.struct(e["value"], e["share"])))

    sides = shares.groupBy("user").agg(
        entries("hour").alias("_hours"),
        entries("device").alias("_devices"),
        entries("ip").alias("_ips"),
        entries("logon_type").alias("_types"),
        F.avg(F.when(F.col("dimension") == "hour", F.col("value").cast("int"))).alias("_mean_hour"),
    )
    empty = F.array().cast("array<struct<rank:int,value:string,share:double>>")
    joined = baseline_totals(df, user, at).join(sides, "user", "left")
    filled = joined.withColumns(
        {name: F.coalesce(name, empty) for name in ("_hours", "_devices", "_ips", "_types")}
    )
    return filled.select(
        "user",
        as_map("_hours").alias("login_time_distribution"),
        exact_round(F.col("_mean_hour"), 2).alias("avg_login_hour"),
        "total_logins",
        "login_success_count",
        "login_failure_count",
        "failed_login_rate",
        "logout_count",
        F.transform("_devices", lambda e: e["value"]).alias("known_devices"),
        F.size("_devices").alias("device_count"),
        as_map("_devices").alias("devices"),
        F.transform("_ips", lambda e: e["value"]).alias("known_ips"),
        F.size("_ips").alias("ip_count"),
        as_map("_ips").alias("ips"),
        as_map("_types").alias("logon_types"),
        "events_analyzed",
    )


def ueba_score(events: DataFrame, baselines: DataFrame, user: str = "user", at: str = "at") -> DataFrame:
    """Adds ``behavior_score`` and ``behavior_reasons`` by comparing events with their baselines.

    A plain left join on the user: Spark broadcasts the baselines when they are small, and
    otherwise splits a busy user's partition on the event side (adaptive skew join).
    """
    known = baselines.select(
        F.col("user").alias("_user"),
        F.col("login_time_distribution").alias("_hours"),
        F.col("known_devices").alias("_devices"),
        F.col("known_ips").alias("_ips"),
        F.map_keys("logon_types").alias("_types"),
    )
    device = F.coalesce(
        F.nullif(coalesce_fields(events, ["device", "source_device"]), F.lit("")), F.lit("unknown")
    )
    address = field(events, "ip_address", "unknown")
    logon = field(events, "logon_type", "unknown")
    kind = F.lower(F.coalesce(F.col("event_type"), F.lit("")))
    hour = F.hour(F.timestamp_micros(F.col(at))).cast("string")
    failed = F.col("risk_signals.failed_login") if "risk_signals" in events.columns else F.lit(False)

    joined = events.withColumn("_name", F.trim(F.coalesce(F.col(user), F.lit("unknown")))).join(
        known, F.col("_name") == F.col("_user"), "left"
    )
    rare = F.col(at).isNotNull() & (F.coalesce(F.try_element_at("_hours", hour), F.lit(0.0)) < RARE_HOUR)
    new_device = ~F.array_contains("_devices", device) & ~device.isin("unknown", "local")
    new_address = ~F.array_contains("_ips", address) & ~address.isin("unknown", "127.0.0.1", "::1")
    failure = kind == "login_failure"
    odd_type = ~F.array_contains("_types", logon) & logon.isin(SCORED_LOGON_TYPES)
    deviation = points((rare, 0.15), (new_device, 0.20), (new_address, 0.20), (failure, 0.10), (odd_type, 0.10))
    found = reasons(
        (rare, "unusual_login_time"),
        (new_device, "new_device"),
        (new_address, "new_ip_address"),
        (failure, "failed_login"),
        (failure & F.coalesce(failed, F.lit(False)), "login_failure_detected"),  # adds no score
        (odd_type, "unusual_logon_type"),
    )
    stranger = F.col("_user").isNull()
    login = kind.isin("login_success", "login_failure")
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "behavior_score": F.when(stranger, 0.15).when(login, capped(deviation)).otherwise(0.0),
            "behavior_reasons": F.when(stranger, F.array(F.lit("new_user_baseline")))
            .when(login, found)
            .otherwise(none),
        }
    ).drop("_name", "_user", "_hours", "_devices", "_ips", "_types")


def _first_seen(df: DataFrame, user: str, value: Column, at: str, ties: list[str], limit: int, name: str) -> DataFrame:
    """The first ``limit`` distinct values of each user, in order of first appearance."""
    met = df.select(F.col(user).alias("user_id"), value.alias("value"), at, *ties).filter("value IS NOT NULL")
    first = met.groupBy("user_id", "value").agg(F.min(F.struct(at, *ties)).alias("_first"))
    order = Window.partitionBy("user_id").orderBy("_first", "value")
    kept = first.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    return kept.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda e: e["value"]).alias(name)
    )


def hour_shares(df: DataFrame, user: str = "user_id", at: str = "at") -> DataFrame:
    """(user_id, hour, share) over all of a user's timed rows."""
    hours = (
        df.filter(F.col(at).isNotNull() & F.col(user).isNotNull())
        .groupBy(F.col(user).alias("user_id"), F.hour(F.timestamp_micros(F.col(at))).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = Window.partitionBy("user_id")  # at most 24 rows per user
    shared = hours.withColumn("_share", F.col("n") / F.sum("n").over(whole))
    return shared.select("user_id", "hour", exact_round(F.col("_share"), 4).alias("share"))


def build_profiles(
    df: DataFrame,
    lists: dict[str, tuple[Column, int]],
    user: str = "user_id",
    at: str = "at",
    ties: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """Activity profiles: hour shares, first-seen lists, totals.

    ``lists`` maps an output name to (value column, how many first-seen values to keep).
    """
    named = df.filter(F.col(user).isNotNull())
    hours = hour_shares(named, user, at).groupBy("user_id").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("hour", "share"))),
                lambda e: F.struct(e["hour"].cast("string"), e["share"]),
            )
        ).alias("login_time_distribution")
    )
    profile = named.groupBy(F.col(user).alias("user_id")).agg(
        F.count(F.lit(1)).alias("total_logins"),
        F.coalesce(F.sum("failed_logins"), F.lit(0)).alias("failed_logins"),
    ).join(hours, "user_id", "left")
    for name, (value, limit) in lists.items():
        profile = profile.join(_first_seen(named, user, value, at, list(ties), limit, name), "user_id", "left")
        profile = profile.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return profile


def build_profiles_flow(df: DataFrame, **options) -> DataFrame:
    """Profiles of authentication flows: ten source hosts, five authentication types."""
    lists = {
        "device_fingerprint": (F.col("source_host"), 10),
        "auth_methods": (F.col("auth_type"), 5),
    }
    return build_profiles(df, lists, **options)


def build_profiles_actions(df: DataFrame, **options) -> DataFrame:
    """Profiles with ten host pairs, ten source hosts and fifteen actions."""
    pair = F.concat("source_host", F.lit("->"), "destination_host")
    lists = {
        "location_history": (pair, 10),
        "device_fingerprint": (F.col("source_host"), 10),
        "activity_sequence_model": (F.col("action"), 15),
    }
    return build_profiles(df, lists, **options)


def risk_factors(profiles: DataFrame) -> Column:
    """Plain-text risk factors of a profile row."""
    return reasons(
        (F.col("total_logins") < 5, "Low activity user (limited baseline)"),
        (F.size("device_fingerprint") > 10, "High device diversity"),
        (F.size("location_history") > 5, "Multi-location user"),
        (F.col("failed_logins") > 3, "High auth failure rate"),
    )


def profile_lookup(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile and risk factors of each requested user that has one."""
    found = profiles.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return found.withColumn("risk_factors", risk_factors(found))


def behavior_score(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``behavior_deviation_score`` and ``behavior_reasons`` from a user's activity profile."""
    known = profiles.select(
        F.col("user_id").alias("_user"),
        F.col("login_time_distribution").alias("_hours"),
        F.col("location_history").alias("_places"),
        F.col("device_fingerprint").alias("_devices"),
        F.col("activity_sequence_model").alias("_actions"),
    )
    joined = requests.join(known, F.col("user_id") == F.col("_user"), "left")

    def word(name: str) -> Column:
        return F.nullif(field(requests, name, ""), F.lit(""))

    hour = F.hour(F.timestamp_micros(F.col("at"))).cast("string")
    share = F.coalesce(F.try_element_at("_hours", hour), F.lit(0.0))
    timed = F.col("at").isNotNull()
    host_pair = F.concat(word("source_host"), F.lit("->"), word("destination_host"))
    address_pair = F.concat(word("source_ip"), F.lit("->"), word("destination_ip"))
    place = F.coalesce(host_pair, address_pair)
    device = F.coalesce(word("device_id"), word("source_host"), word("source_ip"))
    action = word("action")

    def unseen(value: Column, known_values: str) -> Column:
        return F.coalesce(value.isNotNull() & ~F.array_contains(known_values, value), F.lit(False))

    tests = [
        (timed & (share < 0.05), 0.15, "behavior_unusual_time"),
        (timed & (share >= 0.05) & (share < 0.10), 0.08, "behavior_atypical_time"),
        (unseen(place, "_places"), 0.25, "behavior_unusual_location"),
        (unseen(device, "_devices"), 0.20, "behavior_new_device"),
        (unseen(action, "_actions"), 0.15, "behavior_rare_action"),
        (field(requests, "bulk_download", False), 0.20, "behavior_bulk_data_transfer"),
        (field(requests, "sensitive_file_access", False), 0.15, "behavior_sensitive_file_access"),
        (field(requests, "failed_logins", 0) > 1, 0.20, "behavior_multiple_failures"),
        (field(requests, "privilege_escalation", False), 0.20, "behavior_privilege_escalation"),
    ]
    score = capped(points(*[(test, weight) for test, weight, _ in tests]))
    found = reasons(*[(test, text) for test, _, text in tests])
    nameless = F.coalesce(F.col("user_id"), F.lit("")) == ""
    stranger = F.col("_user").isNull()
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "behavior_deviation_score": F.when(nameless, 0.0).when(stranger, 0.05).otherwise(score),
            "behavior_reasons": F.when(nameless, none)
            .when(stranger, F.array(F.lit("new_user_behavior")))
            .otherwise(found),
        }
    ).drop("_user", "_hours", "_places", "_devices", "_actions")
