"""Streaming jobs over the tables, run to the end of the data; results are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.ml.online import learn_batches, load_state
from wardline.operators.stream_features import FEATURE_ORDER
from wardline.plans.behavior_plans import CHAIN_DAYS, DELIVERY, GAP_DAYS, KEYED, ROLLED, incident_feed, rolled_columns
from wardline.plans.data_plans import scratch
from wardline.plans.intake_plans import WINDOWS as INTAKE_WINDOWS
from wardline.plans.intake_plans import windows_records
from wardline.plans.registry import plan
from wardline.plans.scoring_plans import (
    CHAIN,
    FEATURES,
    LOGIN_DAYS,
    MOVES,
    RATES,
    REQUEST_DAYS,
    SCORES,
    featured,
    scored_events,
)
from wardline.plans.tables import DAY, SEC, security_events
from wardline.plans.ueba_plans import RAW_AUTH, UEBA_SQL, raw_auth
from wardline.streaming import jobs
from wardline.session import settle
from wardline.streaming.batches import score_batches
from wardline.streaming.incidents import closed_members, current_incidents, keep_versions
from wardline.streaming.io import stream_sink
from wardline.streaming.lag import lag_rows
from wardline.streaming.process import output, process_stream

LATE = "60 days"  # the tables are one file, so one batch; nothing may count as late


def as_stream(spark, df, name):
    """The frame as a file stream: written once below the shared folder, read back as a stream."""
    folder = scratch(spark, name)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def finished(spark, stream, name):
    """Run a streaming frame over all its data and read what it wrote."""
    place = scratch(spark, f"{name}-out")
    query = stream_sink(stream, f"{place}/checkpoint", path=f"{place}/rows", once=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


WINDOWS = {
    "login_span": LOGIN_DAYS * 86400, "request_span": REQUEST_DAYS * 86400, "chain_span": CHAIN_DAYS * 86400, "lateness": LATE,
}


@plan(
    "streamed_risk_scores",
    f"WITH {CHAIN} SELECT event_id, risk AS risk_score, band AS severity, reason, ip_change_frequency, user_behavior_score FROM banded",
)
def _scores(spark, sf_dir):
    stream = as_stream(spark, security_events(spark, sf_dir), "scores")
    done = finished(spark, jobs.score_stream(stream, **WINDOWS), "scores")
    return done.select(
        "event_id", "risk_score", "severity", F.array_join("reason", ",").alias("reason"), "ip_change_frequency", "user_behavior_score"
    )


@plan(
    "batched_stream_scores",
    f"WITH {CHAIN} SELECT event_id, risk AS risk_score, band AS severity, login_frequency, ip_change_frequency FROM banded",
)
def _batches(spark, sf_dir):
    """Two micro-batches in time order, the second one scored with the rows the first one left."""
    events = security_events(spark, sf_dir)
    place = scratch(spark, "batches")
    middle = events.agg(F.expr("percentile_approx(at, 0.5)")).first()[0]
    sink = lambda scored, number: scored.select(
        "event_id", "risk_score", "severity", "login_frequency", "ip_change_frequency"
    ).write.mode("overwrite").parquet(f"{place}/rows/part={number}")
    spans = {name: value for name, value in WINDOWS.items() if name != "lateness"}
    handle = score_batches(f"{place}/tail", sink, **spans)
    handle(events.filter(F.col("at") <= middle), 0)
    handle(events.filter(F.col("at") > middle), 1)
    return spark.read.parquet(f"{place}/rows").drop("part")


@plan(
    "streamed_suspicious_chains",
    f"""WITH {SEC}, w AS (SELECT event_id, count(*) OVER v AS n, max((event_type = 'login_failure')::INT) OVER v + max((event_type = 'process_create')::INT) OVER v + max((event_type = 'network_connection')::INT) OVER v AS kinds
     FROM sec WINDOW v AS (PARTITION BY host, user_name ORDER BY ts RANGE BETWEEN INTERVAL {CHAIN_DAYS} DAY PRECEDING AND CURRENT ROW))
    SELECT event_id, n AS related_event_count, kinds = 3 AS suspicious_chain FROM w""",
)
def _chains(spark, sf_dir):
    # Every column of the stream goes through the state's Python tasks and back, so only those that are looked at do.
    events = security_events(spark, sf_dir).select("event_id", "seq", "ts", "at", "user_name", "host", "event_type", "ip_address")
    stream = as_stream(spark, events, "chains")
    done = finished(spark, jobs.window_features(stream, **WINDOWS), "chains")
    return done.select("event_id", "related_event_count", "suspicious_chain")


def in_steps(spark, steps, start, name):
    """Run a stream over frames that arrive one after the other; ``start(stream, place)`` starts the query anew each time.

    The frames are written to one folder; the place for results, below which each start has its checkpoint, comes back
    with the progress of all runs.
    """
    folder, place, progress = scratch(spark, name), scratch(spark, f"{name}-out"), []
    for df in steps:
        df.write.mode("append").parquet(folder)
        query = start(spark.readStream.schema(df.schema).parquet(folder), place)
        query.awaitTermination()
        progress += query.recentProgress
    return place, progress


def closing(events, **changed):
    """One far later row, which moves the watermark past every real one."""
    end = events.orderBy(F.desc("at")).limit(1)
    moved = {"at": F.col("at") + 200 * DAY} | ({"ts": F.timestamp_micros(F.col("at") + 200 * DAY)} if "ts" in events.columns else {})
    return end.withColumns(moved | changed).select(*events.columns)


def _incident_versions(spark, sf_dir):
    """Two steps in time order, rows of a step in no order, and a closing row."""
    events = incident_feed(spark, sf_dir)
    middle = F.broadcast(events.agg(F.expr("min(at) + (max(at) - min(at)) div 2").alias("_middle")))
    halves = events.join(middle)
    end = closing(events, user_name=F.lit("closing"), risk_score=F.lit(99.0))
    steps = [halves.filter("at <= _middle"), halves.filter("at > _middle")]

    def start(stream, place):
        versions = jobs.incident_stream(stream, gap=GAP_DAYS * 86400, lateness="1 minute")
        writer = versions.writeStream.foreachBatch(keep_versions(f"{place}/versions")).option("checkpointLocation", f"{place}/checkpoint")
        return writer.trigger(availableNow=True).start()

    place, _ = in_steps(spark, [*(s.select(*events.columns) for s in steps), end], start, "incidents")
    return f"{place}/versions"


@plan("streamed_incidents", f"WITH {ROLLED} SELECT *, 'closed' AS status FROM rolled")
def _incidents(spark, sf_dir):
    found = current_incidents(spark, _incident_versions(spark, sf_dir))
    done = found.filter("user <> 'closing'")
    return rolled_columns(done).join(done.select("incident_id", "status"), "incident_id")


@plan(
    "streamed_incident_members",
    f"""WITH {SEC}, {KEYED} SELECT DISTINCT sha256(key || '|' || CAST(session_start AS VARCHAR)) AS incident_id, event_id FROM sess""",
)
def _members(spark, sf_dir):
    return closed_members(spark, _incident_versions(spark, sf_dir))


@plan("streamed_identity_events", f"""WITH {RAW_AUTH}, {UEBA_SQL} SELECT record_id, "user", event_type, logon_type FROM ueba WHERE lower("user") <> 'system'""")
def _identity(spark, sf_dir):
    stream = as_stream(spark, raw_auth(spark, sf_dir), "identity")
    return finished(spark, jobs.auth_stream(stream), "identity").select("record_id", "user", "event_type", "logon_type")


@plan(
    "ingested_stream",
    f"""WITH {SEC}, d AS (SELECT DISTINCT 'e' || CAST(seq % 5000 AS VARCHAR) AS event_id FROM sec WHERE k % 10 <> 0 AND k % 10 <> 1) SELECT event_id, 1 AS copies FROM d""",
)
def _ingested(spark, sf_dir):
    events, _ = _ingest(spark, sf_dir)
    return finished(spark, events, "ingested").groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@plan(
    "streamed_dead_letters",
    f"""WITH {SEC} SELECT CASE WHEN k % 10 = 0 THEN 'malformed JSON' ELSE 'tenant_id is required' END AS dlq_reason, count(*) AS n FROM sec WHERE k % 10 < 2 GROUP BY 1""",
)
def _rejected(spark, sf_dir):
    _, rejected = _ingest(spark, sf_dir)
    return finished(spark, rejected, "rejected").groupBy("dlq_reason").agg(F.count(F.lit(1)).alias("n"))


def _ingest(spark, sf_dir):
    k = F.col("k")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("e"), (F.col("seq") % 5000).cast("string")).alias("event_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.when(k % 10 != 1, F.col("tenant_id")).alias("tenant_id"), "severity", "event_type",
        )
    )
    lines = security_events(spark, sf_dir).select(F.when(k % 10 == 0, F.substring(body, 1, 25)).otherwise(body).alias("value"))
    folder = scratch(spark, "lines")
    lines.write.text(folder)
    return jobs.ingest_stream(spark.readStream.text(folder), lateness=LATE)


@plan("streamed_alert_delivery", f"WITH RECURSIVE {DELIVERY} SELECT event_id, tenant_id, decision FROM d")
def _alerts(spark, sf_dir):
    scored = scored_events(spark, sf_dir).select(
        "event_id", "seq", "at", "tenant_id", "host", "user_name", "event_type", "source", "attack_type", "severity", "risk_score"
    )
    scored = settle(scored)
    end = closing(scored, tenant_id=F.lit("closing"), risk_score=F.lit(99))

    def start(stream, place):
        found = jobs.alert_stream(stream, span=6 * 3_600_000_000, ttl=DAY, lateness="1 minute", bucket_ms=DAY // 1000)
        return stream_sink(found, f"{place}/checkpoint", path=f"{place}/rows", once=True).start()

    place, _ = in_steps(spark, [scored, end], start, "alerts")
    return spark.read.parquet(f"{place}/rows").select("event_id", "tenant_id", "decision")


# From raw lines ------------------------------------------------------------------------

# What a line says: every tenth is cut short, every tenth has no tenant, every tenth no user, and some come twice.
LINE_ID = "lpad(CAST(seq AS VARCHAR), 12, '0')"
LINE_TEXT = f"""'{{"event_id":"' || {LINE_ID} || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN k % 10 <> 1 THEN '","tenant_id":"' || tenant_id ELSE '' END
  || '","hostname":"' || host || CASE WHEN k % 10 <> 2 THEN '","user":"' || user_name ELSE '' END || '","source":"' || source || '","event_type":"' || event_type
  || '","severity":"' || severity || '","attack_type":"' || attack_type || '","parsed_fields":{{"ip_address":"' || ip_address || '"}},"label":"' || CAST((k > 60)::INT AS VARCHAR) || '"}}'"""
LINE_CHAIN = ", ".join(
    [
        SEC,
        f"""lsec AS (SELECT * REPLACE ({LINE_ID} AS event_id, CASE WHEN k % 10 = 2 THEN 'unknown' ELSE user_name END AS user_name) FROM sec WHERE k % 10 > 1)""",
        RATES.replace("FROM sec)", "FROM lsec)"), MOVES, FEATURES, SCORES,
    ]
)


def raw_lines(spark, sf_dir):
    k = F.col("k")
    body = F.to_json(
        F.struct(
            F.lpad(F.col("seq").cast("string"), 12, "0").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.when(k % 10 != 1, F.col("tenant_id")).alias("tenant_id"), F.col("host").alias("hostname"),
            F.when(k % 10 != 2, F.col("user_name")).alias("user"), "source", "event_type", "severity", "attack_type",
            F.struct("ip_address").alias("parsed_fields"), (k > 60).cast("int").cast("string").alias("label"),
        )
    )
    events = security_events(spark, sf_dir)
    lines = events.select("at", "k", F.when(k % 10 == 0, F.substring(body, 1, 25)).otherwise(body).alias("value"))
    return lines.unionByName(lines.filter(k % 10 == 4))


def _processed(spark, sf_dir):
    """Raw lines in two steps of time, each read once, to events, alerts and dead letters below one folder."""
    lines = raw_lines(spark, sf_dir)
    middle = F.broadcast(lines.agg(F.expr("min(at) + (max(at) - min(at)) div 2").alias("_middle")))
    halves = lines.join(middle)
    spans = {name: value for name, value in WINDOWS.items() if name != "lateness"}

    def start(stream, place):
        return process_stream(stream, f"{place}/out", f"{place}/checkpoint", once=True, remember=60 * 86400.0, **spans)

    steps = [halves.filter("at <= _middle").select("value"), halves.filter("at > _middle").select("value")]
    place, _ = in_steps(spark, steps, start, "process")
    return f"{place}/out"


@plan(
    "processed_events",
    f"""WITH {LINE_CHAIN} SELECT event_id, tenant_id, user_name, login_frequency, request_rate, ip_change_frequency, ml_score, risk AS risk_score, band AS severity,
    reason, CAST(k > 60 AS INTEGER) AS label FROM banded""",
)
def _processed_events(spark, sf_dir):
    return output(spark, _processed(spark, sf_dir), "events").select(
        "event_id", "tenant_id", "user_name", "login_frequency", "request_rate", "ip_change_frequency", "ml_score", "risk_score", "severity",
        F.array_join("reason", ",").alias("reason"), "label",
    )


@plan(
    "processed_alerts",
    f"""WITH {LINE_CHAIN}, al AS (SELECT *, CASE WHEN band = 'critical' THEN 'kill_process' WHEN band = 'high' THEN 'isolate_host'
      WHEN attack_type IN ('brute_force','privilege_escalation') THEN 'block_ip' ELSE 'monitor' END AS action FROM banded WHERE risk >= 30)
    SELECT event_id, tenant_id, band AS severity, risk AS risk_score, action AS recommended_action,
      tenant_id || ':' || host || ':' || user_name || ':' || event_type || ':' || action AS dedup_key FROM al""",
)
def _processed_alerts(spark, sf_dir):
    return output(spark, _processed(spark, sf_dir), "alerts").select("event_id", "tenant_id", "severity", "risk_score", "recommended_action", "dedup_key")


@plan(
    "processed_dead_letters",
    f"""WITH {SEC} SELECT CASE WHEN k % 10 = 0 THEN left({LINE_TEXT}, 25) ELSE {LINE_TEXT} END AS value,
    CASE WHEN k % 10 = 0 THEN 'malformed JSON' ELSE 'tenant_id is required' END AS dlq_reason FROM sec WHERE k % 10 < 2""",
)
def _processed_dead_letters(spark, sf_dir):
    return output(spark, _processed(spark, sf_dir), "dead_letters").select("value", "dlq_reason")


@plan(
    "processed_counts",
    f"""WITH {SEC}, o AS (SELECT CASE WHEN k % 10 = 0 OR k % 10 = 1 THEN NULL ELSE tenant_id END AS tenant_id, k % 10 AS d FROM sec)
    SELECT tenant_id, CASE WHEN d < 2 THEN 'dead_letter' ELSE 'ingested' END AS outcome, count(*) AS n FROM o GROUP BY ALL
    UNION ALL SELECT tenant_id, 'duplicate', count(*) FROM o WHERE d = 4 GROUP BY ALL""",
)
def _processed_counts(spark, sf_dir):
    found = output(spark, _processed(spark, sf_dir), "counts")
    return found.groupBy("tenant_id", "outcome").agg(F.sum("n").alias("n"))


@plan(
    "stream_lag",
    f"""WITH {SEC}, m AS (SELECT min(us) + (max(us) - min(us)) // 2 AS mid FROM sec),
    f AS (SELECT count(*) AS n, max(us) // 1000 AS top FROM sec, m WHERE us <= mid), l AS (SELECT count(*) AS n FROM sec, m WHERE us < mid - {20 * DAY}),
    s AS (SELECT count(*) AS n, max(us) // 1000 AS top FROM sec, m WHERE us > mid)
    SELECT 1 AS step, f.n AS input_rows, 0 AS dropped_rows, CAST(f.top AS DOUBLE) / 1e3 AS watermark_lag_seconds FROM f
    UNION ALL SELECT 2, s.n + l.n, l.n, CAST(s.top - f.top + 86400000 AS DOUBLE) / 1e3 FROM s, l, f""",
)
def _lag(spark, sf_dir):
    """The second step brings rows that are long past the watermark; they are dropped and counted."""
    events = security_events(spark, sf_dir).select("event_id", "ts", "at")
    middle = F.broadcast(events.agg(F.expr("min(at) + (max(at) - min(at)) div 2").alias("_middle")))
    halves = events.join(middle)
    again = halves.filter(F.col("at") < F.col("_middle") - 20 * DAY)
    steps = [halves.filter("at <= _middle").drop("_middle"), halves.filter("at > _middle").unionByName(again).drop("_middle")]

    def start(stream, place):
        once = stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
        return stream_sink(once, f"{place}/checkpoint", path=f"{place}/rows", once=True).start()

    _, progress = in_steps(spark, steps, start, "lag")
    rows = lag_rows(spark, progress).filter("input_rows > 0")
    step = F.row_number().over(Window.orderBy("batch_id")).cast("int")  # a row per batch of a run
    return rows.select(step.alias("step"), "input_rows", F.col("dropped_rows").alias("dropped_rows"), "watermark_lag_seconds")


# The scoring steps of the batch twin, over Windows records instead of the view.
WINDOWS_CHAIN = ", ".join(
    [
        INTAKE_WINDOWS,
        """wsec AS (SELECT CAST(seq AS VARCHAR) AS event_id, seq, us, make_timestamp(us) AS ts, host, "user" AS user_name, source, severity, ip_address, 'none' AS attack_type,
     CASE event_id WHEN 4624 THEN 'login_success' WHEN 4625 THEN 'login_failure' WHEN 4634 THEN 'logout' WHEN 4688 THEN 'process_creation' WHEN 4689 THEN 'process_termination' ELSE 'unknown' END AS event_type
    FROM (SELECT * REPLACE (coalesce("user", 'unknown') AS "user") FROM win))""",
        RATES.replace("FROM sec)", "FROM wsec)"), MOVES, FEATURES, SCORES,
    ]
)


@plan(
    "streamed_windows_scores",
    f"WITH {WINDOWS_CHAIN} SELECT event_id, user_name, event_type, risk AS risk_score, band AS severity, risk >= 30 AS alert FROM banded",
)
def _windows(spark, sf_dir):
    rows = windows_records(spark, sf_dir).join(security_events(spark, sf_dir).select("seq", "at", "ts"), "seq")
    stream = as_stream(spark, rows, "windows")
    done = finished(spark, jobs.windows_stream(stream, **WINDOWS), "windows")
    return done.select("event_id", "user_name", "event_type", "risk_score", "severity", "alert")


@plan("online_learning_batches")
def _online(spark, sf_dir):
    """Batches of six days, as many as there are: each is scored with the model of the batches before, then learned."""
    rows = featured(spark, sf_dir).select("event_id", "at", "seq", *FEATURE_ORDER, (F.col("k") > 60).cast("int").alias("label"))
    place = scratch(spark, "online")
    kept = f"{place}/scored"
    begin, end = rows.agg(F.min("at"), F.max("at")).first()
    sink = lambda scored, number: scored.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{kept}/part={number}")
    handle = learn_batches(f"{place}/state", sink=sink)
    settled = rows.persist()
    for number in range((end - begin) // (6 * DAY) + 1 if end is not None else 0):
        low = begin + number * 6 * DAY
        handle(settled.filter(F.col("at").between(low, low + 6 * DAY - 1)), number)
    settled.unpersist()
    state = load_state(spark, f"{place}/state")
    done = spark.read.parquet(kept)
    return done.groupBy("batch", "model_version").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg((F.col("predicted_label") == F.col("label")).cast("double")), 4).alias("accuracy")
    ).withColumn("final_version", F.lit(state.version))

