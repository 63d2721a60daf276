"""Timeline queries, dashboard aggregates, tenancy and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.rounding import exact_round_sql
from wardline.operators import drift as drifts
from wardline.operators import incidents, quality, soc, tenancy, timeline, ueba
from wardline.plans.behavior_plans import KEYED, TIMELINE, sessions_of, timeline_events
from wardline.plans.registry import plan
from wardline.plans.scoring_plans import CHAIN, scored_events
from wardline.plans.tables import DAY, SEC, security_events, table
from wardline.plans.ueba_plans import AUTH, FLOWS, PAST, auth_flows, past_auth

START, END = 1_704_412_800_000_000, 1_706_054_400_000_000  # 2024-01-05 and 2024-01-24


@plan(
    "timeline_range",
    f"""WITH {SEC}, {TIMELINE} SELECT event_id, us AS at, kind AS event_type FROM tl WHERE tenant_id = 't2' AND us BETWEEN {START} AND {END}
    AND severity = 'low' AND list_contains(mitre_techniques, 'T1190')""",
)
def _range(spark, sf_dir):
    wanted = {"severity": "low", "mitre_technique": "T1190", "host_id": ""}
    return timeline.timeline_range(timeline_events(spark, sf_dir), "t2", START, END, wanted).select("event_id", "at", "event_type")


@plan("timeline_event", f"WITH {SEC} SELECT event_id, tenant_id, host, us AS at FROM sec WHERE tenant_id = 't3' AND seq = (SELECT max(seq) FROM sec WHERE tenant_id = 't3')")
def _event(spark, sf_dir):
    events = security_events(spark, sf_dir)
    last = events.filter("tenant_id = 't3'").agg(F.max("seq").cast("string")).first()[0]
    return timeline.get_event(events, "t3", last or "").select("event_id", "tenant_id", "host", "at")


@plan(
    "timeline_latest_versions",
    f"""WITH {SEC}, v AS (SELECT *, 'e' || CAST(seq % 3000 AS VARCHAR) AS id FROM sec) SELECT tenant_id, id AS event_id, max(us) AS at, arg_max(severity, us) AS severity FROM v GROUP BY tenant_id, id""",
)
def _versions(spark, sf_dir):
    again = security_events(spark, sf_dir).withColumn("event_id", F.concat(F.lit("e"), (F.col("seq") % 3000).cast("string")))
    return timeline.latest_versions(again).select("tenant_id", "event_id", "at", "severity")


@plan("timeline_stats", f"""WITH {SEC} SELECT tenant_id, count(*) AS total_events, max(us) AS last_at, CAST(sum(count(*)) OVER () AS BIGINT) AS store_events,
    count(*) OVER () AS tenants, max(max(us)) OVER () AS store_last_at FROM sec GROUP BY tenant_id""")
def _tstats(spark, sf_dir):
    return timeline.timeline_stats(security_events(spark, sf_dir))


@plan("replay_last_events", f"WITH {SEC} SELECT event_id, us AS at FROM sec ORDER BY us DESC, seq DESC LIMIT 100")
def _replay_last(spark, sf_dir):
    return timeline.replay_last(security_events(spark, sf_dir), 100).select("event_id", "at")


@plan("replay_time_range", f"WITH {SEC} SELECT event_id, us AS at FROM sec WHERE us BETWEEN {START} AND {END}")
def _replay_range(spark, sf_dir):
    return timeline.replay_range(security_events(spark, sf_dir), START, END).select("event_id", "at")


CONTEXT = f"""win AS (SELECT * FROM tl WHERE tenant_id = 't1' AND us BETWEEN {START} AND {END}),
 root AS (SELECT * FROM win WHERE process_id = (SELECT process_id FROM win GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY us, seq LIMIT 1),
 par AS (SELECT w.* FROM win w JOIN root r ON w.process_id = r.parent_process_id AND r.parent_process_id <> '' ORDER BY w.us, w.seq LIMIT 1),
 kids AS (SELECT w.*, row_number() OVER (PARTITION BY w.process_id ORDER BY w.us, w.seq) AS n FROM win w JOIN root r ON w.parent_process_id = r.process_id AND w.host = r.host)"""


def _root_id(events):
    """The busiest process of the range (a one-row frame made by the query itself)."""
    found = timeline.between(events.filter("tenant_id = 't1'"), START, END).groupBy("process_id").count()
    return found.orderBy(F.desc("count"), "process_id").first()["process_id"]


@plan(
    "process_context",
    f"""WITH {SEC}, {TIMELINE}, {CONTEXT} SELECT 'root' AS role, event_id, process_id FROM root UNION ALL SELECT 'parent', event_id, process_id FROM par
    UNION ALL SELECT 'child', event_id, process_id FROM kids WHERE n = 1""",
)
def _context(spark, sf_dir):
    events = timeline_events(spark, sf_dir)
    return timeline.process_context(events, "t1", _root_id(events), START, END, tie="seq").select("role", "event_id", "process_id")


@plan(
    "process_tree_events",
    f"""WITH {SEC}, {TIMELINE}, {CONTEXT} SELECT event_id, process_id FROM win WHERE process_id IN
    (SELECT process_id FROM root UNION SELECT process_id FROM par UNION SELECT process_id FROM kids)""",
)
def _tree(spark, sf_dir):
    events = timeline_events(spark, sf_dir)
    return timeline.process_tree_events(events, "t1", _root_id(events), START, END, tie="seq").select("event_id", "process_id")


@plan("nearest_event", f"WITH {SEC} SELECT event_id, us AS at FROM sec ORDER BY abs(us - {END}), us, seq LIMIT 1")
def _nearest(spark, sf_dir):
    return timeline.nearest_event(security_events(spark, sf_dir), END).select("event_id", "at")


@plan(
    "nearest_events_by_host",
    f"""WITH {SEC}, probes AS (SELECT CAST(o_orderkey AS VARCHAR) AS probe_id, 'h' || CAST(o_custkey % 20 AS VARCHAR) AS host,
      {START} + (o_orderkey % 40000) * 60000000 AS t FROM orders),
    below AS (SELECT p.probe_id, p.host, p.t, s.us FROM probes p ASOF LEFT JOIN sec s ON p.host = s.host AND p.t >= s.us),
    above AS (SELECT p.probe_id, s.us FROM probes p ASOF LEFT JOIN sec s ON p.host = s.host AND p.t <= s.us)
    SELECT b.probe_id, b.host, b.t AS probe_at, CASE WHEN b.us IS NOT NULL AND (a.us IS NULL OR b.t - b.us <= a.us - b.t) THEN b.us ELSE a.us END AS event_at
    FROM below b JOIN above a USING (probe_id)""",
)
def _nearest_many(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    probes = orders.select(
        F.col("o_orderkey").cast("string").alias("probe_id"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 20).cast("string")).alias("host"),
        (F.lit(START) + (F.col("o_orderkey") % 40000) * 60_000_000).alias("at"),
    )
    return timeline.nearest_events(probes, security_events(spark, sf_dir), "host", width=DAY)


@plan(
    "incident_replay",
    f"""WITH {SEC}, {KEYED}, pick AS (SELECT key, session_start FROM sess GROUP BY key, session_start ORDER BY count(*) DESC, sha256(key || '|' || CAST(session_start AS VARCHAR)) LIMIT 1)
    SELECT event_id, severity FROM sess WHERE (key, session_start) IN (SELECT (key, session_start) FROM pick)""",
)
def _incident_replay(spark, sf_dir):
    cut = sessions_of(spark, sf_dir)
    members = incidents.incident_members(cut)
    largest = members.groupBy("incident_id").count().orderBy(F.desc("count"), "incident_id").first()
    wanted = largest["incident_id"] if largest else ""
    return incidents.incident_events(members, security_events(spark, sf_dir), wanted).select("event_id", "severity")


@plan(
    "retained_events",
    f"""WITH {SEC} SELECT event_id, tenant_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY us DESC, seq DESC) AS rn FROM sec) WHERE rn <= 500""",
)
def _retain(spark, sf_dir):
    return timeline.retain_last(security_events(spark, sf_dir), 500, width=DAY).select("event_id", "tenant_id")


@plan("events_since", f"WITH {SEC} SELECT event_id, us AS at FROM sec WHERE tenant_id = 't4' AND us > {START} ORDER BY us DESC, seq DESC LIMIT 1000")
def _since(spark, sf_dir):
    return timeline.events_since(security_events(spark, sf_dir), "t4", START, 1000).select("event_id", "at")


@plan(
    "event_positions",
    f"""WITH {SEC}, p AS (SELECT event_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY us, seq) - 1 AS position, count(*) OVER (PARTITION BY tenant_id) AS total FROM sec)
    SELECT event_id, tenant_id, position, total, round((position + 1) / total::DOUBLE * 100, 2) AS progress FROM p""",
)
def _positions(spark, sf_dir):
    placed = timeline.positions(security_events(spark, sf_dir), ["tenant_id"], width=DAY)
    exact = F.round(((F.col("position") + 1) / F.col("total")) * 100, 2)
    return placed.select("event_id", "tenant_id", "position", "total", exact.alias("progress"))


@plan("step_forward", f"WITH {SEC}, p AS (SELECT event_id, row_number() OVER (ORDER BY us, seq) - 1 AS position FROM sec) SELECT * FROM p WHERE position = 120 + 35")
def _step(spark, sf_dir):
    return timeline.step(security_events(spark, sf_dir), 120, 35, width=DAY).select("event_id", "position")


@plan("attack_timeline", f"WITH {SEC} SELECT event_id, user_name FROM sec WHERE user_name = 'u7' ORDER BY us DESC, seq DESC LIMIT 100")
def _attack_timeline(spark, sf_dir):
    return timeline.attack_timeline(security_events(spark, sf_dir), user="u7").select("event_id", "user_name")


@plan("attack_timeline_cut_first", f"WITH {SEC}, t AS (SELECT * FROM sec ORDER BY us DESC, seq DESC LIMIT 1000) SELECT event_id, user_name FROM t WHERE user_name = 'u7'")
def _attack_timeline_legacy(spark, sf_dir):
    return timeline.attack_timeline(security_events(spark, sf_dir), user="u7", limit=1000, legacy=True).select("event_id", "user_name")


@plan(
    "cpu_spikes",
    f"""WITH RECURSIVE {SEC}, d AS (SELECT host, CAST(us // {DAY} * {DAY} AS BIGINT) AS snap, k, event_id FROM sec), s AS (SELECT DISTINCT host, snap FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY snap) AS rn FROM s),
    f AS (SELECT host, snap, rn, snap AS last, true AS kept FROM o WHERE rn = 1 UNION ALL
      SELECT o.host, o.snap, o.rn, CASE WHEN o.snap - f.last >= {3 * DAY} THEN o.snap ELSE f.last END, o.snap - f.last >= {3 * DAY} FROM f JOIN o ON o.host = f.host AND o.rn = f.rn + 1)
    SELECT event_id, d.host FROM d JOIN f ON f.host = d.host AND f.snap = d.snap AND kept WHERE k > 80""",
)
def _spikes(spark, sf_dir):
    rows = security_events(spark, sf_dir).withColumns(
        {"at": F.col("at") - F.pmod(F.col("at"), F.lit(DAY)), "cpu_percent": F.col("k").cast("double")}
    )
    return timeline.cpu_spikes(rows, spacing=3 * DAY).select("event_id", "host")


@plan(
    "displayed_events",
    f"""WITH {SEC}, {TIMELINE} SELECT event_id, host AS "Host", user_name AS "User", 'proc' || CAST(k % 6 AS VARCHAR) AS "Process",
    CASE kind WHEN 'login_failure' THEN 'Login Failure' WHEN 'login_success' THEN 'Login Success' WHEN 'process_create' THEN 'Process Create' WHEN 'network_connection' THEN 'Network Connection'
      WHEN 'anomaly' THEN 'Anomaly' WHEN 'privilege_escalation' THEN 'Privilege Escalation' ELSE 'Data Exfiltration' END AS "Event", upper(severity) AS "Severity",
    CASE WHEN len(mitre_techniques) > 0 THEN array_to_string(mitre_techniques, ', ') ELSE '-' END AS "Techniques" FROM tl""",
)
def _display(spark, sf_dir):
    return timeline.display_event(timeline_events(spark, sf_dir))


# Dashboards ----------------------------------------------------------------------------


@plan("severity_counts", f"WITH {SEC} SELECT severity, count(*) AS n FROM sec GROUP BY 1")
def _sev(spark, sf_dir):
    return soc.severity_counts(security_events(spark, sf_dir))


@plan(
    "soc_kpis",
    f"""WITH {CHAIN}, {AUTH[len(SEC) + 2:]}, {PAST} SELECT count(*) AS events, max(us) AS last_event_at, count(*) FILTER (band = 'critical' AND risk >= 30) AS critical,
    count(*) FILTER (band = 'high' AND risk >= 30) AS high, count(*) FILTER (band IN ('critical','high') AND risk >= 30) AS threats, (SELECT count(*) FROM totals) AS users_profiled FROM banded""",
)
def _kpis(spark, sf_dir):
    found = scored_events(spark, sf_dir).filter("alert")
    return soc.soc_kpis(security_events(spark, sf_dir), found, ueba.baseline_totals(past_auth(spark, sf_dir)))


@plan("top_flows", f"WITH {SEC} SELECT host, ip_address, count(*) AS \"count\" FROM sec GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 25")
def _flows(spark, sf_dir):
    return soc.top_flows(security_events(spark, sf_dir), "host", "ip_address")


@plan(
    "type_severity_matrix",
    f"""WITH {SEC} SELECT event_type, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
    count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM sec GROUP BY 1""",
)
def _matrix(spark, sf_dir):
    return soc.type_severity_matrix(security_events(spark, sf_dir))


@plan("technique_counts", f"WITH {SEC}, {TIMELINE} SELECT technique, count(*) AS n FROM (SELECT unnest(mitre_techniques) AS technique FROM tl) GROUP BY 1")
def _techniques(spark, sf_dir):
    return soc.technique_counts(timeline_events(spark, sf_dir))


@plan("tactic_counts", f"WITH {SEC}, {TIMELINE} SELECT tactic, count(*) AS n FROM (SELECT unnest(mitre_tactics) AS tactic FROM tl) GROUP BY 1")
def _tactics(spark, sf_dir):
    return soc.tactic_counts(timeline_events(spark, sf_dir))


@plan("event_type_counts", f"WITH {SEC} SELECT event_type, tenant_id, count(*) AS n FROM sec GROUP BY ALL")
def _types(spark, sf_dir):
    return soc.event_type_counts(security_events(spark, sf_dir), "tenant_id")


@plan("user_event_counts", f"WITH {SEC} SELECT user_name, count(*) AS n FROM sec GROUP BY 1")
def _users(spark, sf_dir):
    return soc.user_event_counts(security_events(spark, sf_dir))


@plan("top_threats", f"WITH {CHAIN} SELECT event_id, risk AS risk_score, band AS severity FROM banded WHERE band IN ('high','critical') ORDER BY risk DESC, seq LIMIT 20")
def _threats(spark, sf_dir):
    return soc.top_threats(scored_events(spark, sf_dir)).select("event_id", "risk_score", "severity")


@plan("risk_trend", f"WITH {CHAIN} SELECT us AS at, risk AS risk_score, band AS severity, seq FROM banded ORDER BY us DESC, seq DESC LIMIT 100")
def _trend(spark, sf_dir):
    return soc.risk_trend(scored_events(spark, sf_dir))


@plan("recent_activity", f"WITH {SEC} SELECT us AS at, seq, source, event_type, user_name FROM sec ORDER BY us DESC, seq DESC LIMIT 50")
def _recent(spark, sf_dir):
    return soc.recent(security_events(spark, sf_dir), 50, ["at", "source", "event_type", "user_name"])


@plan(
    "recent_logs",
    f"""WITH {SEC}, n AS (SELECT event_id, source, us, seq, 0 AS l FROM sec WHERE source = 'network' ORDER BY us DESC, seq DESC LIMIT 60),
    a AS (SELECT event_id, source, us, seq, 1 AS l FROM sec WHERE source = 'auth' ORDER BY us DESC, seq DESC LIMIT 60)
    SELECT event_id, source FROM (SELECT * FROM n UNION ALL SELECT * FROM a) ORDER BY l DESC, us DESC, seq DESC LIMIT 60""",
)
def _recent_logs(spark, sf_dir):
    events = security_events(spark, sf_dir)
    both = soc.load_recent(events.filter("source = 'network'"), events.filter("source = 'auth'"), 60)
    return both.select("event_id", "source")


RULES_SQL = """ruled AS (SELECT CAST(seq AS VARCHAR) AS event_id, list_filter([CASE WHEN seq % 9 = 0 THEN 'sensitive_file_access' END,
   CASE WHEN seq % 10 = 0 THEN 'bulk_download' END, CASE WHEN seq % 12 = 0 THEN 'privilege_escalation' END, CASE WHEN seq % 7 = 0 THEN 'behavior_sensitive_file_access' END], lambda x: x IS NOT NULL) AS rules FROM flows)"""


def _ruled(spark, sf_dir):
    from wardline.functions.lookup import reasons

    seq = F.col("seq")
    rules = reasons(
        (seq % 9 == 0, "sensitive_file_access"), (seq % 10 == 0, "bulk_download"),
        (seq % 12 == 0, "privilege_escalation"), (seq % 7 == 0, "behavior_sensitive_file_access"),
    )
    return auth_flows(spark, sf_dir).withColumn("triggered_rules", rules)


@plan("sensitive_access", f"WITH {FLOWS}, {RULES_SQL} SELECT event_id FROM ruled WHERE array_to_string(rules, ',') LIKE '%sensitive_file_access%'")
def _sensitive(spark, sf_dir):
    return soc.sensitive_access(_ruled(spark, sf_dir)).select("event_id")


@plan("insider_alerts", f"WITH {FLOWS}, {RULES_SQL} SELECT event_id FROM ruled WHERE list_has_any(rules, ['bulk_download','privilege_escalation'])")
def _insider(spark, sf_dir):
    return soc.insider_alerts(_ruled(spark, sf_dir)).select("event_id")


@plan(
    "ingest_counters",
    f"""WITH {SEC} SELECT tenant_id, source, device AS component, count(*) FILTER (k % 10 > 1) AS ingested, count(*) FILTER (k % 10 = 0) AS failed, count(*) FILTER (k % 10 = 1) AS dead_lettered FROM sec GROUP BY ALL""",
)
def _metrics(spark, sf_dir):
    k = F.col("k")
    rows = security_events(spark, sf_dir).withColumns(
        {"component": F.col("device"), "outcome": F.when(k % 10 == 0, "failed").when(k % 10 == 1, "dead_letter").otherwise("ingested")}
    )
    return soc.pipeline_metrics(rows)


@plan(
    "buffer_stats",
    f"""WITH {SEC} SELECT count(*) FILTER (k % 4 <> 0) AS total_received, count(*) FILTER (k % 4 = 0) AS total_dropped,
    count(DISTINCT tenant_id) FILTER (k % 4 <> 0) AS tenants, (SELECT count(*) FROM sec WHERE severity = 'high') AS total_incidents FROM sec""",
)
def _buffer(spark, sf_dir):
    events = security_events(spark, sf_dir)
    rows = events.withColumns(
        {
            "risk_score": F.col("value"), "anomaly_score": F.col("k") / 100.0, "processed_at": F.col("at"),
            "processor_version": F.when(F.col("k") % 4 != 0, "1"),
        }
    )
    return quality.buffer_stats(quality.required_enriched(rows), events.filter("severity = 'high'"))


# Tenancy -------------------------------------------------------------------------------

TENANTS = """tenants AS (SELECT 't' || CAST(r_regionkey AS VARCHAR) AS tenant_id, CASE r_regionkey WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' WHEN 3 THEN 'trial' ELSE 'free' END AS plan FROM region)"""


def tenants_of(spark, sf_dir):
    key = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("t"), key.cast("string")).alias("tenant_id"),
        F.when(key == 1, "pro").when(key == 2, "enterprise").when(key == 3, "trial").otherwise("free").alias("plan"),
    )


USAGE = f"""usage AS (SELECT tenant_id, us // {DAY} * {DAY} AS period_at, count(*) AS events_ingested, count(*) FILTER (source = 'auth') AS api_calls,
   count(*) FILTER (k % 2 = 0) AS ml_predictions, sum(k * 1000) / 1048576e0 AS storage_mb FROM sec GROUP BY ALL)"""


def usage_of(spark, sf_dir):
    rows = security_events(spark, sf_dir).withColumns(
        {"is_call": F.col("source") == "auth", "is_prediction": F.col("k") % 2 == 0, "bytes": F.col("k") * 1000}
    )
    return tenancy.tenant_usage(rows)


@plan("tenant_usage", f"WITH {SEC}, {USAGE} SELECT tenant_id, period_at, events_ingested, api_calls, ml_predictions, round(storage_mb, 6) AS storage_mb FROM usage")
def _usage(spark, sf_dir):
    return usage_of(spark, sf_dir).withColumn("storage_mb", F.round("storage_mb", 6))


@plan(
    "latest_usage",
    f"WITH {SEC}, {USAGE} SELECT tenant_id, period_at, events_ingested, api_calls FROM usage u WHERE period_at = (SELECT max(period_at) FROM usage x WHERE x.tenant_id = u.tenant_id)",
)
def _latest(spark, sf_dir):
    return tenancy.latest_usage(usage_of(spark, sf_dir)).select("tenant_id", "period_at", "events_ingested", "api_calls")


@plan(
    "quota_check",
    f"""WITH {SEC}, {USAGE}, {TENANTS}, big AS (SELECT tenant_id, period_at, api_calls * 10 AS api_calls, ml_predictions * 200 AS ml_predictions FROM usage)
    SELECT tenant_id, period_at, plan, CASE plan WHEN 'pro' THEN 500 WHEN 'enterprise' THEN 5000 ELSE 25 END AS eps_limit,
    api_calls <= CASE plan WHEN 'pro' THEN 3000 WHEN 'enterprise' THEN 25000 ELSE 300 END AND ml_predictions <= CASE plan WHEN 'pro' THEN 500000 WHEN 'enterprise' THEN 5000000 ELSE 10000 END AS within_limits
    FROM big JOIN tenants USING (tenant_id)""",
)
def _quota(spark, sf_dir):
    grown = usage_of(spark, sf_dir).withColumns(
        {"api_calls": F.col("api_calls") * 10, "ml_predictions": F.col("ml_predictions") * 200}
    )
    return tenancy.quota_check(grown, tenants_of(spark, sf_dir)).select("tenant_id", "period_at", "plan", "eps_limit", "within_limits")


@plan(
    "tenant_agent_quota",
    f"""WITH {TENANTS}, a AS (SELECT 't' || CAST(c_custkey % 5 AS VARCHAR) AS tenant_id, count(*) AS agents FROM customer GROUP BY 1),
    l AS (SELECT *, CASE plan WHEN 'free' THEN 10 WHEN 'pro' THEN 250 ELSE 5000 END AS agent_limit FROM tenants)
    SELECT tenant_id, plan, agent_limit, coalesce(agents, 0) AS agents, coalesce(agents, 0) >= agent_limit AS exceeded FROM l LEFT JOIN a USING (tenant_id)""",
)
def _agent_quota(spark, sf_dir):
    agents = table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 5).cast("string")).alias("tenant_id"))
    return tenancy.tenant_quota(agents, tenants_of(spark, sf_dir))


@plan(
    "plan_defaults",
    f"""WITH {TENANTS} SELECT tenant_id, plan, CASE plan WHEN 'free' THEN 10 WHEN 'pro' THEN 250 ELSE 5000 END AS agent_limit,
    CASE plan WHEN 'pro' THEN 500 WHEN 'enterprise' THEN 5000 ELSE 25 END AS eps_limit, CASE plan WHEN 'free' THEN 1024 WHEN 'pro' THEN 20480 ELSE 204800 END AS storage_limit_mb,
    CASE plan WHEN 'free' THEN 7 WHEN 'pro' THEN 30 ELSE 180 END AS retention_days FROM tenants""",
)
def _defaults(spark, sf_dir):
    return tenancy.plan_defaults(tenants_of(spark, sf_dir))


BEATS = """beats AS (SELECT seq, host AS agent_id, us AS received_at, us - (k % 5) * 40000000 AS signed_at, 'n' || CAST(k AS VARCHAR) AS nonce,
   CASE WHEN k % 9 = 0 THEN 'Degraded' ELSE 'Healthy' END AS health FROM sec UNION ALL
   SELECT seq + 100000000, host, us + 1000, us - (k % 5) * 40000000, 'n' || CAST(k AS VARCHAR), 'Healthy' FROM sec WHERE seq % 4 = 0),
 judged AS (SELECT *, CASE WHEN abs(received_at - signed_at) > 120000000 THEN 'stale'
   WHEN row_number() OVER (PARTITION BY agent_id, nonce, signed_at, abs(received_at - signed_at) <= 120000000 ORDER BY seq) = 1 THEN 'accepted' ELSE 'replay' END AS verdict FROM beats)"""


def beats(spark, sf_dir):
    k = F.col("k")
    own = security_events(spark, sf_dir).select(
        "seq", F.col("host").alias("agent_id"), F.col("at").alias("received_at"),
        (F.col("at") - (k % 5) * 40_000_000).alias("signed_at"), F.concat(F.lit("n"), k.cast("string")).alias("nonce"),
        F.when(k % 9 == 0, "Degraded").otherwise("Healthy").alias("agent_health"),
    )
    again = own.filter(F.col("seq") % 4 == 0).withColumns(
        {"seq": F.col("seq") + 100000000, "received_at": F.col("received_at") + 1000, "agent_health": F.lit("Healthy")}
    )
    return own.unionByName(again)


@plan("heartbeat_checks", f"WITH {SEC}, {BEATS} SELECT seq, agent_id, verdict FROM judged")
def _beats(spark, sf_dir):
    return tenancy.heartbeat_checks(beats(spark, sf_dir)).select("seq", "agent_id", "verdict")


@plan(
    "agent_health",
    f"""WITH {SEC}, {BEATS} SELECT agent_id, max(received_at) AS last_heartbeat_at, CASE WHEN arg_max(health, received_at) = 'Healthy' THEN 'active' ELSE 'degraded' END AS status,
    count(*) AS heartbeats FROM judged WHERE verdict = 'accepted' GROUP BY 1""",
)
def _health(spark, sf_dir):
    return tenancy.agent_health(beats(spark, sf_dir))


@plan("tenant_view", f"WITH {SEC} SELECT event_id, tenant_id, severity FROM sec WHERE tenant_id = 't2'")
def _view(spark, sf_dir):
    return tenancy.tenant_view(security_events(spark, sf_dir), "t2").select("event_id", "tenant_id", "severity")


@plan(
    "tenant_retention",
    f"""WITH {SEC}, {TENANTS} SELECT event_id, tenant_id FROM sec JOIN tenants USING (tenant_id)
    WHERE us >= 1706659200000000 - CASE plan WHEN 'free' THEN 7 WHEN 'pro' THEN 30 ELSE 180 END * {DAY}""",
)
def _retention(spark, sf_dir):
    kept = tenancy.retention(security_events(spark, sf_dir), tenants_of(spark, sf_dir), 1_706_659_200_000_000)
    return kept.select("event_id", "tenant_id")


# Drift ---------------------------------------------------------------------------------


@plan(
    "prediction_drift",
    f"""WITH {SEC}, e AS (SELECT event_id, CASE WHEN (CASE WHEN seq % 1000 > 600 THEN k > 35 ELSE k > 90 END) THEN 1e0 ELSE 0e0 END AS w,
      row_number() OVER (ORDER BY us, seq) AS rn, us, seq FROM sec),
    a AS (SELECT *, avg(w) OVER (ORDER BY us, seq ROWS 99 PRECEDING) AS b, avg(w) OVER (ORDER BY us, seq ROWS 24 PRECEDING) AS r FROM e)
    SELECT event_id, {exact_round_sql("b", 4)} AS baseline_error, {exact_round_sql("r", 4)} AS recent_error,
    least(rn, 100) >= 50 AND least(rn, 25) >= 12 AND r > b + 0.20 AS drift_detected FROM a""",
)
def _drift(spark, sf_dir):
    wrong = F.when(F.col("seq") % 1000 > 600, F.col("k") > 35).otherwise(F.col("k") > 90)
    rows = security_events(spark, sf_dir).withColumns({"label": F.lit(1), "predicted": F.when(wrong, 0).otherwise(1)})
    return drifts.drift(rows, width=DAY).select("event_id", "baseline_error", "recent_error", "drift_detected")
