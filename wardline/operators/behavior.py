"""Host behaviour: event chains, process trees, technique and stage tables, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.casts import as_column, seconds_to_micros
from wardline.functions.fields import field
from wardline.functions.lookup import lookup
from wardline.operators.slices import HOUR, count_back, halo, in_slice, own_rows, running

# Event type to technique, its name, its tactic, and the attack stage.
TECHNIQUE = {
    "login_failure": "T1110",
    "login": "T1078",
    "process_create": "T1059",
    "network_connection": "T1021",
    "privilege_change": "T1068",
    "registry_change": "T1112",
    "file_modify": "T1547",
}
TECHNIQUE_NAME = {
    "T1110": "Brute Force",
    "T1078": "Valid Accounts",
    "T1059": "Command and Scripting Interpreter",
    "T1021": "Remote Services",
    "T1068": "Exploitation for Privilege Escalation",
    "T1112": "Modify Registry",
    "T1547": "Boot or Logon Autostart Execution",
}
TECHNIQUE_TACTIC = {
    "T1110": "Credential Access",
    "T1078": "Defense Evasion",
    "T1059": "Execution",
    "T1021": "Lateral Movement",
    "T1068": "Privilege Escalation",
    "T1112": "Defense Evasion",
    "T1547": "Persistence",
}
STAGE = {
    "login_failure": "initial_access",
    "login": "initial_access",
    "process_create": "execution",
    "registry_change": "persistence",
    "file_modify": "persistence",
    "network_connection": "lateral_movement",
    "exfiltration": "exfiltration",
}
CHAIN_TYPES = ["login_failure", "process_create", "network_connection"]
CHAIN_SPAN = 900
# Event types whose latest rows are followed when the related types are asked for.
MOST_TYPES = 200


def mitre_map(df: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Adds technique, technique name and tactic; null for types without one."""
    mapped = df.withColumn("mitre_technique", lookup(TECHNIQUE, F.lower(F.col(event_type))))
    return mapped.withColumns(
        {
            "mitre_name": lookup(TECHNIQUE_NAME, "mitre_technique"),
            "mitre_tactic": lookup(TECHNIQUE_TACTIC, "mitre_technique"),
        }
    )


def kill_chain_stage(event_type: str | Column = "event_type") -> Column:
    return lookup(STAGE, F.lower(as_column(event_type)), "unknown")


def suspicious_chain(
    df: DataFrame,
    host: str = "host",
    user: str = "user_name",
    at: str = "at",
    tie: str = "seq",
    span: float = CHAIN_SPAN,
    rows: int | None = None,
    with_types: bool = False,
) -> DataFrame:
    """Adds ``entity``, ``related_event_count`` and ``suspicious_chain``.

    A row is related when it is at most ``span`` old and, if ``rows`` are given, among the entity's
    last ``rows`` rows.  For each needed type it is enough to know its latest row: its age and its distance in
    rows come from running maxima inside the slice, which cost the same however many rows lie in the
    span.  ``with_types`` adds the sorted set of related types in the same way, for the types that
    the frame has: a vocabulary, of which at most MOST_TYPES are taken.
    """
    back = seconds_to_micros(span)
    kinds = list(CHAIN_TYPES)
    if with_types:
        found = [r[0] for r in df.select("event_type").distinct().limit(MOST_TYPES + 1).collect() if r[0] is not None]
        if len(found) > MOST_TYPES:
            raise ValueError(f"more than {MOST_TYPES} event types")
        kinds += sorted(set(found) - set(kinds))
    entity = F.concat(
        F.coalesce(F.col(host), F.lit("unknown-host")), F.lit(":"), F.coalesce(F.col(user), F.lit("unknown-user"))
    )
    wide = halo(df.withColumn("entity", entity), at, back)
    order = in_slice(["entity"], at, tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = wide.withColumns({"_recent": count_back(["entity"], at, [tie], back), "_nth": F.row_number().over(order)})
    # Rows are in order of time, so the latest row of a type has both its largest time and its largest number.
    latest = {
        f"_last_{i}": F.max(F.when(F.col("event_type") == kind, F.struct("_nth", at))).over(so_far) for i, kind in enumerate(kinds)
    }

    def related(i: int) -> Column:
        last = F.col(f"_last_{i}")
        near = last[at] >= F.col(at) - F.lit(back)
        return F.coalesce(near if rows is None else near & (last["_nth"] > F.col("_nth") - rows), F.lit(False))

    complete = F.lit(True)
    for i, _ in enumerate(CHAIN_TYPES):
        complete = complete & related(i)
    count = F.col("_recent") if rows is None else F.least(F.col("_recent"), F.lit(rows))
    added = {"related_event_count": count, "suspicious_chain": complete}
    if with_types:
        held = F.array(*[F.when(related(i), F.lit(kind)) for i, kind in enumerate(kinds)])
        added["related_types"] = F.array_sort(F.array_compact(held))
    result = numbered.withColumns(latest).withColumns(added)
    return own_rows(result).drop("_recent", "_nth", *latest)


def recommended_response(df: DataFrame) -> DataFrame:
    """Adds ``response_action``, ``response_mode`` and ``response_reason``."""
    severe = F.lower(field(df, "severity", "low")).isin("high", "critical")
    chain = field(df, "suspicious_chain", False)
    process = field(df, "event_type", "") == "process_create"
    return df.withColumns(
        {
            "response_action": F.when(severe | chain, "isolate_host")
            .when(process, "monitor_process")
            .otherwise("alert_only"),
            "response_mode": F.when(severe | chain, "simulated").otherwise("safe"),
            "response_reason": F.when(chain, "behavioral_chain_detected")
            .when(severe, "high_severity_event")
            .when(process, "lineage_tracking")
            .otherwise("insufficient_context"),
        }
    )


def _process_rows(df: DataFrame, host: str) -> DataFrame:
    return df.filter((F.col("event_type") == "process_create") & (F.coalesce(F.col("pid"), F.lit(0)) > 0)).withColumn(
        "_host", F.coalesce(F.col(host), F.lit("unknown-host"))
    )


def process_edges(df: DataFrame, host: str = "host") -> DataFrame:
    """Distinct (host, parent_pid, pid) edges; a null or 0 parent is no edge."""
    edge = F.coalesce(F.col("parent_pid"), F.lit(0)) != 0
    return _process_rows(df, host).filter(edge).select(F.col("_host").alias("host"), "parent_pid", "pid").distinct()


def process_nodes(df: DataFrame, host: str = "host", at: str = "at", tie: str = "seq") -> DataFrame:
    """(host, pid, name, parent_pid): latest name and parent of each process, implied parents included."""
    rows = _process_rows(df, host)
    order = F.struct(at, tie)
    name = F.nullif(field(df, "process_name", ""), F.lit(""))
    own = rows.groupBy(F.col("_host").alias("host"), "pid").agg(
        F.max_by(name, F.when(name.isNotNull(), order)).alias("name"),
        F.max_by("parent_pid", order).alias("parent_pid"),
    )
    implied = process_edges(df, host).select("host", F.col("parent_pid").alias("pid")).distinct()
    both = own.join(implied, ["host", "pid"], "full")
    return both.withColumn("name", F.coalesce("name", F.lit("unknown")))


def node_edge_counts(df: DataFrame, host: str = "host") -> DataFrame:
    """Distinct processes and edges per host."""
    edges = process_edges(df, host)
    nodes = (
        _process_rows(df, host)
        .select(F.col("_host").alias("host"), "pid")
        .unionByName(edges.select("host", F.col("parent_pid").alias("pid")))
        .distinct()
    )
    return (
        nodes.groupBy("host").agg(F.count(F.lit(1)).alias("node_count"))
        .join(edges.groupBy("host").agg(F.count(F.lit(1)).alias("edge_count")), "host", "left")
        .withColumn("edge_count", F.coalesce("edge_count", F.lit(0).cast("bigint")))
    )


def tree_growth(df: DataFrame, host: str = "host", at: str = "at", tie: str = "seq", width: int = HOUR) -> DataFrame:
    """Process rows with ``node_count``: processes known on the host up to and including the row.

    A node counts at the first row that names it; rows then carry a running sum of new nodes.
    """
    created = df.filter(F.col("event_type") == "process_create").withColumn(
        "_host", F.coalesce(F.col(host), F.lit("unknown-host"))
    )
    ids = F.array(F.col("pid"), F.nullif(F.col("parent_pid"), F.lit(0)))
    named = (
        _process_rows(df, host)
        .select("_host", at, tie, F.explode(F.array_compact(ids)).alias("_node"))
        .groupBy("_host", "_node")
        .agg(F.min(F.struct(at, tie)).alias("_first"))
    )
    fresh = named.groupBy("_host", F.col(f"_first.{at}").alias(at), F.col(f"_first.{tie}").alias(tie)).agg(
        F.count(F.lit(1)).alias("_new")
    )
    joined = created.join(fresh, ["_host", at, tie], "left")
    new = F.coalesce(F.col("_new"), F.lit(0).cast("bigint"))
    return running(joined, ["_host"], at, [tie], {"node_count": ("sum", new)}, width).drop("_new", "_host")


def snapshot_new(previous_rows: DataFrame, current: DataFrame, keys: list[str], changed: list[str] | None = None) -> DataFrame:
    """Rows of ``current`` whose key is not in the previous snapshot.

    With ``changed``, rows whose listed columns differ from the previous ones are new as well.
    """
    if changed is None:
        return current.join(previous_rows.select(*keys).distinct(), keys, "left_anti")
    same = [F.col(f"c.{name}").eqNullSafe(F.col(f"p.{name}")) for name in [*keys, *changed]]
    condition = same[0]
    for test in same[1:]:
        condition = condition & test
    return current.alias("c").join(previous_rows.select(*keys, *changed).alias("p"), condition, "left_anti")


def snapshot_gone(previous_rows: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the previous snapshot that are missing now."""
    return snapshot_new(current, previous_rows, keys)
