"""Timeline queries: ranges, points, process context, replay windows, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.fields import beside
from wardline.operators.slices import HOUR, KEY, key_of, newest, numbered, running

FILTERS = {
    "host_id": "host",
    "user_id": "user_name",
    "process_id": "process_id",
    "event_type": "event_type",
    "severity": "severity",
}


def between(df: DataFrame, start: int, end: int, at: str = "at") -> DataFrame:
    """Rows from ``start`` to ``end``.  A stored ``day`` column is filtered too, so other days' folders are not read."""
    found = df.filter(F.col(at).between(start, end))
    if "day" not in df.columns:
        return found
    first, last = (F.to_date(F.timestamp_micros(F.lit(edge))) for edge in (start, end))
    return found.filter(F.col("day").between(first, last))


def timeline_range(
    df: DataFrame,
    tenant: str,
    start: int,
    end: int,
    filters: dict[str, str] | None = None,
    at: str = "at",
    tie: str = "event_id",
) -> DataFrame:
    """A tenant's events from ``start`` to ``end`` (both included) in time order; empty filters are ignored."""
    found = between(df.filter(F.col("tenant_id") == tenant), start, end, at)
    for name, wanted in (filters or {}).items():
        if not wanted:
            continue
        if name == "mitre_technique":
            found = found.filter(F.array_contains("mitre_techniques", wanted))
        else:
            found = found.filter(F.col(FILTERS[name]) == wanted)
    return found.orderBy(at, tie)


def get_event(df: DataFrame, tenant: str, event_id: str) -> DataFrame:
    return df.filter((F.col("tenant_id") == tenant) & (F.col("event_id") == event_id))


def latest_versions(df: DataFrame, at: str = "at") -> DataFrame:
    """One row per (tenant, event id): the version added last."""
    whole = F.struct(*df.columns)
    return (
        df.groupBy(F.col("tenant_id").alias("_tenant"), F.col("event_id").alias("_event"))
        .agg(F.max_by(whole, at).alias("_row"))
        .select("_row.*")
    )


def replay_last(df: DataFrame, limit: int, at: str = "at", tie: str = "seq") -> DataFrame:
    """The last ``limit`` events, oldest first."""
    return newest(df, [], at, [tie], limit).orderBy(at, tie)


def replay_range(
    df: DataFrame, start: int | None, end: int | None, limit: int | None = None, at: str = "at", tie: str = "seq"
) -> DataFrame:
    """Events of a time range, at most the last ``limit``; nothing when a bound is missing."""
    if start is None or end is None:
        return df.limit(0)
    found = between(df, start, end, at)
    return replay_last(found, limit, at, tie) if limit is not None else found.orderBy(at, tie)


def process_context(
    df: DataFrame, tenant: str, process_id: str, start: int, end: int, at: str = "at", tie: str = "event_id"
) -> DataFrame:
    """Rows with ``role`` root, parent or child: the first event of each.

    The parent may be on any host, children must be on the root's host.  The root is one row,
    so its joins are broadcasts of a single row.
    """
    window = between(df.filter(F.col("tenant_id") == tenant), start, end, at)
    whole = F.struct(*window.columns)
    order = F.struct(at, tie)

    def first(rows: DataFrame, role: str, *keys: str) -> DataFrame:
        picked = rows.groupBy(*keys).agg(F.min_by(whole, order).alias("_row")).filter("_row IS NOT NULL")
        return picked.select(F.lit(role).alias("role"), "_row.*")

    root = first(window.filter(F.col("process_id") == process_id), "root")
    facts = F.broadcast(
        root.select(
            F.col("parent_process_id").alias("_parent"), F.col("host").alias("_host")
        )
    )
    parents = window.join(
        facts, (F.col("process_id") == F.col("_parent")) & (F.col("_parent") != ""), "left_semi"
    )
    children = window.filter(F.col("parent_process_id") == process_id).join(
        facts, F.col("host") == F.col("_host"), "left_semi"
    )
    return root.unionByName(first(parents, "parent")).unionByName(first(children, "child", "process_id"))


def process_tree_events(
    df: DataFrame, tenant: str, process_id: str, start: int, end: int, at: str = "at", tie: str = "event_id"
) -> DataFrame:
    """All events of the root process, its parent and its children in the range."""
    context = process_context(df, tenant, process_id, start, end, at, tie)
    ids = context.select("process_id").unionByName(
        df.sparkSession.createDataFrame([(process_id,)], "process_id string")
    )
    window = between(df.filter(F.col("tenant_id") == tenant), start, end, at)
    return window.join(ids.distinct(), "process_id", "left_semi")


def nearest_event(df: DataFrame, target: int, at: str = "at", tie: str = "seq") -> DataFrame:
    """The event closest in time to ``target``; the earlier one on a tie."""
    order = F.struct(F.abs(F.col(at) - F.lit(target)), F.col(at), F.col(tie))
    return df.agg(F.min_by(F.struct(*df.columns), order).alias("_row")).filter("_row IS NOT NULL").select("_row.*")


def nearest_events(
    probes: DataFrame, events: DataFrame, key: str, at: str = "at", tie: str = "seq", width: int = HOUR
) -> DataFrame:
    """For every probe (key, probe_id, at) the event of its key closest in time; earlier on a tie.

    Probes and events are put in one order; the latest event before a probe is a running
    maximum, the first one after it a running maximum over negated time.  No pairs are formed.
    """
    event = F.struct(F.col(at).alias("at"), F.col(tie).alias("seq"))
    both = events.select(
        key, F.col(at).alias("at"), F.lit(None).cast("string").alias("probe_id"), event.alias("_event")
    ).unionByName(
        probes.select(
            key, F.col(at).alias("at"), F.col("probe_id").cast("string").alias("probe_id"),
            F.lit(None).cast(f"struct<at:bigint,seq:{dict(events.dtypes)[tie]}>").alias("_event"),
        )
    )
    # At equal times events come first going up and going down, so both sides include them.
    later = F.when(F.col("_event").isNotNull(), F.struct(-F.col("_event.at"), -F.col("_event.seq")))
    placed = both.withColumns(
        {"_probe": F.col("_event").isNull().cast("int"), "_down": -F.col("at"), "_later": later}
    )
    up = running(placed, [key], "at", ["_probe"], {"_below": ("max", F.col("_event"))}, width)
    down = running(up, [key], "_down", ["_probe"], {"_above": ("max", F.col("_later"))}, width)
    # Among events at the same nearest time the first (lowest tie) one counts.
    below = F.col("_below.at")
    above = -F.col("_above.col1")
    take_below = below.isNotNull() & (above.isNull() | (F.col("at") - below <= above - F.col("at")))
    return down.filter(F.col("_probe") == 1).select(
        key, "probe_id", F.col("at").alias("probe_at"),
        F.when(take_below, below).otherwise(above).alias("event_at"),
    )


def retain_last(
    df: DataFrame, limit: int, key: str = "tenant_id", at: str = "at", tie: str = "seq", width: int = HOUR
) -> DataFrame:
    """Each key's newest ``limit`` rows."""
    return newest(df, [key], at, [tie], limit, width)


def events_since(
    df: DataFrame, tenant: str, since: int | None, limit: int = 1000, at: str = "at", tie: str = "seq"
) -> DataFrame:
    """A tenant's events newer than ``since``, the last ``limit`` of them in time order."""
    found = df.filter(F.col("tenant_id") == tenant)
    if since is not None:
        found = found.filter(F.col(at) > since)
    return newest(found, [], at, [tie], limit).orderBy(at, tie)


def positions(df: DataFrame, keys: list[str], at: str = "at", tie: str = "seq", width: int = HOUR) -> DataFrame:
    """Adds the 0-based ``position`` of each event, the total and the progress in percent.

    A null key is a key of its own; rows without a time come first.
    """
    placed = numbered(df, keys, at, [tie], "_row", width).withColumn(KEY, key_of(keys))
    totals = df.groupBy(key_of(keys).alias(KEY)).agg(F.count(F.lit(1)).alias("total"))
    joined = placed.join(totals, KEY) if keys else beside(placed, totals.drop(KEY))
    return joined.withColumns(
        {"position": F.col("_row") - 1, "progress": F.bround(F.col("_row") / F.col("total") * 100.0, 2)}
    ).drop("_row", KEY)


def step(df: DataFrame, index: int, count: int, at: str = "at", tie: str = "seq", width: int = HOUR) -> DataFrame:
    """The event ``count`` rows after (or before) row ``index``, held inside the list."""
    placed = positions(df, [], at, tie, width)
    target = F.greatest(F.lit(0), F.least(F.lit(index + count), F.col("total") - 1))
    return placed.filter(F.col("position") == target)


def attack_timeline(
    df: DataFrame,
    user: str | None = None,
    event_id: str | None = None,
    limit: int = 100,
    legacy: bool = False,
    at: str = "at",
    tie: str = "seq",
) -> DataFrame:
    """Last ``limit`` records of a user or event; ``legacy`` cuts first and filters after."""

    def wanted(rows: DataFrame) -> DataFrame:
        if user:
            rows = rows.filter(F.col("user_name") == user)
        if event_id:
            rows = rows.filter(F.col("event_id") == event_id)
        return rows

    if legacy:
        return wanted(newest(df, [], at, [tie], limit))
    return newest(wanted(df), [], at, [tie], limit)


def cpu_spikes(df: DataFrame, threshold: float = 80.0, spacing: int = 5_000_000, at: str = "at") -> DataFrame:
    """Rows above the threshold in snapshots that are checked: those at least ``spacing`` after
    the last checked one.  Needs ``snapshot_at`` and ``host``.

    The snapshots of a host are few next to its rows; they are thinned first, rows join after.
    """
    from wardline.operators.throttle import spaced_out

    snapshots = df.select("host", at).distinct()
    checked = spaced_out(snapshots, ["host"], at, spacing)
    return df.filter(F.col("cpu_percent") > threshold).join(checked, ["host", at], "left_semi")


def timeline_stats(df: DataFrame, at: str = "at") -> DataFrame:
    """Events and last time per tenant, with the totals of the whole store on each row."""
    per = df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total_events"), F.max(at).alias("last_at"))
    whole = per.agg(
        F.sum("total_events").alias("store_events"),
        F.count(F.lit(1)).alias("tenants"),
        F.max("last_at").alias("store_last_at"),
    )
    return beside(per, whole)


def display_event(df: DataFrame) -> DataFrame:
    """Columns as shown to an analyst."""
    techniques = F.array_join("mitre_techniques", ", ")
    return df.select(
        "event_id",
        F.col("host").alias("Host"),
        F.coalesce(F.nullif(F.col("user_name"), F.lit("")), F.lit("-")).alias("User"),
        F.col("process_name").alias("Process"),
        F.initcap(F.replace("event_type", F.lit("_"), F.lit(" "))).alias("Event"),
        F.upper("severity").alias("Severity"),
        F.when(F.coalesce(F.size("mitre_techniques"), F.lit(0)) > 0, techniques).otherwise("-").alias("Techniques"),
    )
