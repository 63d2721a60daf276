"""Streams equal the batch operators over several micro-batches; models keep their properties."""

import tempfile
import time

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wardline.ml import forest, isolation, models, online
from wardline.operators import behavior, incidents, throttle
from wardline.operators.stream_features import FEATURE_ORDER, activity_rates, ip_change_frequency
from wardline.plans import PLANS
from wardline.streaming import incidents as stream_incidents
from wardline.streaming import jobs, lag, process
from wardline.streaming.batches import score_batches
from wardline.streaming.io import stream_sink, to_messages

SECOND = 1_000_000


def run_parts(spark, parts, job):
    """Feed the parts one after the other to a stream that is stopped and restarted in between."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    parts[0].limit(0).write.mode("overwrite").parquet(f"{folder}/in")
    stream = job(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream_sink(stream, f"{folder}/checkpoint", path=f"{folder}/out", once=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def made_events(spark):
    rows = []
    for i in range(300):
        kind = ["login_failure", "process_create", "network_connection", "login_success"][i * 7 % 4]
        rows.append((f"e{i}", i, (1 + i * 97 % 40 + i * 30) * SECOND, f"u{i % 3}", f"h{i % 2}", kind, f"10.0.0.{i * i % 5}", "auth", "low", "none", "t0"))
    schema = "event_id string, seq bigint, at bigint, user_name string, host string, event_type string, ip_address string, source string, severity string, attack_type string, tenant_id string"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at"))


def test_window_stream_equals_batch(spark):
    events = made_events(spark).cache()
    cuts = [0, 3000, 6000, 99999]
    parts = [events.filter(F.col("at").between(a * SECOND, b * SECOND - 1)) for a, b in zip(cuts, cuts[1:])]
    done = run_parts(spark, parts, jobs.window_features)
    batch = behavior.suspicious_chain(ip_change_frequency(activity_rates(events)))
    names = ["login_frequency", "request_rate", "ip_change_frequency", "related_event_count", "suspicious_chain"]
    got = {r.event_id: tuple(r[n] for n in names) for r in done.collect()}
    want = {r.event_id: tuple(r[n] for n in names) for r in batch.collect()}
    assert got == want


def test_chain_windows_have_no_limit_of_rows(spark):
    """All rows of the span count, and a type's last row is found behind more than 200 others, also in a later run."""
    kinds = ["login_failure", "process_create", *["network_connection"] * 448]
    rows = [(f"e{i}", i, (1000 + 2 * i) * SECOND, "u", "h", kind, "10.0.0.1") for i, kind in enumerate(kinds)]
    schema = "event_id string, seq bigint, at bigint, user_name string, host string, event_type string, ip_address string"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at")).cache()
    want = {f"e{i}": (i + 1, i >= 2) for i in range(450)}
    late = "1 second"  # so that the watermark is behind most rows of the first part
    done = run_parts(spark, [events.filter("seq < 300"), events.filter("seq >= 300")], lambda s: jobs.window_features(s, lateness=late))
    assert {r.event_id: (r.related_event_count, r.suspicious_chain) for r in done.collect()} == want
    batch = behavior.suspicious_chain(events, with_types=True).collect()
    assert {r.event_id: (r.related_event_count, r.suspicious_chain) for r in batch} == want
    assert all(r.related_types == sorted(set(kinds[: r.seq + 1])) for r in batch)


def test_scored_batches_equal_the_stream(spark):
    """A foreachBatch run over three micro-batches, one of them repeated, against one batch."""
    events = made_events(spark).cache()
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sink = lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/rows/part={number}")
    handle = score_batches(f"{folder}/tail", sink)
    for number, (low, high) in enumerate([(0, 3000), (3000, 6000), (6000, 99999)]):
        part = events.filter(F.col("at").between(low * SECOND, high * SECOND - 1))
        handle(part, number)
        if number == 1:
            handle(part, number)
    whole = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    score_batches(f"{whole}/tail", lambda df, _: df.write.mode("overwrite").parquet(f"{whole}/rows"))(events, 0)
    names = ["event_id", *FEATURE_ORDER, "risk_score", "related_event_count", "suspicious_chain", "response_action"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/rows").select(*names).collect())
    assert got == sorted(tuple(r) for r in spark.read.parquet(f"{whole}/rows").select(*names).collect())


def test_stateless_streams_equal_batch(spark):
    rows = [(i, ["4624", "4625", "1"][i % 3], f"h{i}", f" u{i} ", "2024-01-01 00:00:00") for i in range(30)]
    df = spark.createDataFrame(rows, "event_key int, event_id string, host string, user string, timestamp string")
    typed = df.withColumn("event_id", F.col("event_id").cast("int"))
    done = run_parts(spark, [typed.filter("event_key < 11"), typed.filter("event_key >= 11")], jobs.os_stream)
    assert sorted(map(str, done.collect())) == sorted(map(str, jobs.os_stream(typed).collect()))
    good = run_parts(spark, [typed], lambda s: jobs.validated_stream(s)[0])
    bad = run_parts(spark, [typed], lambda s: jobs.validated_stream(s)[1])
    assert good.count() == 0 and bad.count() == 30


def test_metric_counts_close_with_the_watermark(spark):
    rows = [(i * 10, "t0", "auth", "ingested" if i % 3 else "failed") for i in range(30)] + [(90000, "t0", "auth", "ingested")]
    df = spark.createDataFrame(rows, "second bigint, tenant_id string, source string, outcome string").withColumn(
        "ts", F.timestamp_seconds("second")
    )
    parts = [df.filter("second < 80000"), df.filter("second > 80000")]
    done = run_parts(spark, parts, lambda s: jobs.metrics_stream(s.select("ts", "tenant_id", "source", "outcome")))
    total = done.agg(F.sum("ingested"), F.sum("failed")).first()
    assert tuple(total) == (20, 10)


def test_alert_stream_equals_batch(spark):
    """Rows come in no order within the watermark, over several micro-batches; a far later row closes the last bucket."""
    from wardline.operators.alerts import alert_payload

    scored = made_events(spark).withColumn("risk_score", F.lit(50)).drop("ts").cache()
    end = scored.filter("seq = 0").withColumns({"at": F.lit(10**12), "tenant_id": F.lit("end"), "event_id": F.lit("end")})
    timeless = scored.filter("seq = 1").withColumns({"at": F.lit(None).cast("bigint"), "event_id": F.lit("timeless")})
    early = (F.col("at") < 4600 * SECOND) != (F.col("at").between(4400 * SECOND, 4800 * SECOND) & (F.col("seq") % 3 == 0))
    parts = [scored.filter(early).orderBy(F.desc("seq")).unionByName(timeless), scored.filter(~early).orderBy(F.hash("seq")), end]
    done = run_parts(spark, parts, lambda s: jobs.alert_stream(s, limit=4))
    batch = throttle.throttle_rate(alert_payload(scored), limit=4)
    got = {r.event_id: r.decision for r in done.filter("tenant_id <> 'end'").collect()}
    assert got == {r.event_id: r.decision for r in batch.collect()} and len(set(got.values())) > 1


def test_rows_without_a_time_do_not_end_a_stream(spark):
    events = made_events(spark).cache()
    broken = events.filter("seq < 6").withColumns(
        {"at": F.lit(None).cast("bigint"), "ts": F.lit(None).cast("timestamp"), "event_id": F.concat(F.lit("x"), "seq"), "user_name": F.when(F.col("seq") > 2, F.col("user_name"))}
    )
    parts = [events.filter("seq < 150").unionByName(broken), events.filter("seq >= 150"), broken]
    done = run_parts(spark, parts, jobs.score_stream).cache()
    assert done.filter("event_id LIKE 'e%'").count() == 300
    left = done.filter("event_id LIKE 'x%'").collect()
    assert all(r.login_frequency is None and r.related_event_count is None for r in left)
    batch = ip_change_frequency(activity_rates(events))
    got = {r.event_id: (r.login_frequency, r.ip_change_frequency) for r in done.filter("event_id LIKE 'e%'").collect()}
    assert got == {r.event_id: (r.login_frequency, r.ip_change_frequency) for r in batch.collect()}


def test_missing_users_are_one_user_in_stream_and_batch(spark):
    events = made_events(spark).withColumn("user_name", F.when(F.col("seq") % 2 == 0, F.col("user_name"))).cache()
    done = run_parts(spark, [events], jobs.window_features)
    batch = activity_rates(events)
    assert {r.event_id: (r.user_name, r.login_frequency) for r in done.collect()} == {r.event_id: (r.user_name, r.login_frequency) for r in batch.collect()}


def test_incident_versions_follow_late_events(spark):
    """A late event joins two incidents: the later one is merged, and the newest versions equal the batch."""
    rows = [(f"e{i}", i, at * SECOND, "u", "auth", "login_failure", 50.0 + i) for i, at in enumerate([10_000, 10_500, 11_700, 12_200, 19_000])]
    schema = "event_id string, seq bigint, at bigint, user_name string, source string, event_type string, risk_score double"
    late = [("late", 9, 11_100 * SECOND, "u", "auth", "process_create", 99.0), ("e1", 1, 10_500 * SECOND, "u", "auth", "login_failure", 51.0)]
    first = spark.createDataFrame(rows[:4], schema)
    second = spark.createDataFrame([late[0][:5] + ("login_failure", 99.0), late[1]], schema)
    third = spark.createDataFrame(rows[4:], schema)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    whole = []
    for df in (first, second, third):
        timed = df.withColumns({"severity": F.lit("low"), "ts": F.timestamp_micros("at")})
        whole.append(timed)
        timed.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.incident_stream(spark.readStream.schema(timed.schema).parquet(f"{folder}/in"), lateness="1 hour")
        keep = stream_incidents.keep_versions(f"{folder}/versions")
        writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    current = stream_incidents.current_incidents(spark, f"{folder}/versions")
    names = ["incident_id", "start_at", "end_at", "severity", "risk_score", "event_count", "event_types", "summary"]
    batch = incidents.incident_rollup(incidents.sessionize_incidents(whole[0].unionByName(whole[1]).unionByName(whole[2])))
    assert sorted(map(str, current.select(names).collect())) == sorted(map(str, batch.select(names).collect()))
    by_start = {r.start_at // SECOND: (r.status, r.event_count) for r in current.collect()}
    assert by_start == {10_000: ("closed", 5), 19_000: ("open", 1)}
    members = {r.event_id for r in stream_incidents.closed_members(spark, f"{folder}/versions").collect()}
    assert members == {"e0", "e1", "e2", "e3", "late"}
    stored = spark.read.parquet(f"{folder}/versions")
    assert {r.status for r in stored.collect()} == {"open", "merged", "closed", "member"}
    stream_incidents.compact(spark, f"{folder}/versions", f"{folder}/compact")
    again = stream_incidents.current_incidents(spark, f"{folder}/compact")
    assert sorted(map(str, again.select(names).collect())) == sorted(map(str, current.select(names).collect()))


def lines_of(spark, low, high):
    body = "'{\"event_id\":\"' || id || '\",\"timestamp\":\"' || date_format(timestamp_seconds(id * 60), \"yyyy-MM-dd'T'HH:mm:ss\") || '\",\"tenant_id\":\"t' || id % 3 || '\",\"hostname\":\"h\",\"user\":\"u' || id % 4 || '\",\"event_type\":\"login_failure\",\"source\":\"auth\",\"severity\":\"high\",\"label\":\"' || id % 2 || '\"}'"
    made = spark.range(low, high).selectExpr(f"CASE WHEN id % 9 = 0 THEN '{{broken' WHEN id % 9 = 1 THEN '{{\"tenant_id\":\"t\",\"timestamp\":\"?\"}}' ELSE {body} END AS value")
    return made.repartition(3)


def test_a_repeated_batch_changes_nothing(spark):
    """Two micro-batches, each tried twice, the second with ids of the first: outputs and model are those of one try."""
    kept = {}
    for tries in (1, 2):
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        handle = process.process_lines(f"{folder}/out", model=f"{folder}/model", learn=True)
        for number, lines in enumerate([lines_of(spark, 0, 90), lines_of(spark, 80, 180)]):
            for _ in range(tries):
                handle(lines, number)
        read = lambda name: process.output(spark, f"{folder}/out", name)
        kept[tries] = [
            sorted(map(str, read("events").select("event_id", "batch", "risk_score", "ml_score", "model_version", "login_frequency").collect())),
            sorted(map(str, read("alerts").select("event_id", "batch", "dedup_key").collect())),
            sorted(map(str, read("dead_letters").collect())), sorted(map(str, read("counts").collect())),
            [online.ModelStore(spark, f"{folder}/model").newest().weights, online.ModelStore(spark, f"{folder}/model").newest().version],
        ]
    assert kept[1] == kept[2]
    folder_events = [r for r in kept[1][0]]
    assert len(folder_events) == sum(i % 9 > 1 for i in range(180))
    assert any("duplicate" in r for r in kept[1][3]) and any("timestamp is not readable" in r for r in kept[1][2])
    # A batch that is not marked as done isn't read.
    spark.createDataFrame([("x",)], "event_id string").write.parquet(f"{folder}/out/alerts/batch=7")
    assert process.output(spark, f"{folder}/out", "alerts").filter("batch = 7").count() == 0


def test_the_pointer_leads_to_the_stable_version(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    store = online.ModelStore(spark, folder)
    assert store.pointer() is None and not store.newest().ready
    make = lambda version, drift=False: online.OnlineState(
        count=1.0, mean=[0.0] * 10, square=[1.0] * 10, weights=[float(version)] * 10, version=version, errors=[float(version)], drift_detected=drift
    )
    for batch, state in enumerate([make(1), make(2), make(2, True)]):
        store.publish(state, batch)
    served = store.newest()
    assert store.pointer()["serves"] == 1 and served.weights == [2.0] * 10 and served.drift_detected
    assert store.newest(before=2).version == 2 and not store.newest(before=2).drift_detected
    store.publish(make(3), 2)  # the batch is tried again, with another outcome
    assert store.newest().version == 3 and store.pointer()["serves"] == 2
    import shutil

    shutil.rmtree(f"{folder}/batch=0")  # only what the pointer names is read
    assert store.newest().version == 3


def test_listener_rows_tell_the_lag(spark):
    rows, events = [], made_events(spark).select("event_id", "ts")
    listener = lag.LagListener(rows.append)
    spark.streams.addListener(listener)
    try:
        run_parts(spark, [events, events.filter("event_id < 'e2'")], lambda s: s.withWatermark("ts", "1 minute").dropDuplicatesWithinWatermark(["event_id"]))
        for _ in range(100):
            if sum(r["input_rows"] for r in rows) >= 300 + events.filter("event_id < 'e2'").count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["input_rows"] for r in rows) == 300 + events.filter("event_id < 'e2'").count()
    assert any(r["dropped_rows"] > 0 for r in rows) and any(r["watermark_lag_seconds"] is not None for r in rows)
    assert lag.lag_rows(spark, []).columns == list(rows[0])


def test_messages_are_keyed_by_tenant(spark):
    df = spark.createDataFrame([("a", "t1"), ("b", None)], "event_id string, tenant_id string")
    assert [r.key for r in to_messages(df, processed_at=F.lit(0.0)).orderBy("value").collect()] == ["t1", "default"]


def test_online_learning_improves_and_rolls_back(spark):
    rows = spark.range(600).select(
        F.col("id").alias("seq"), F.col("id").alias("at"),
        *[((F.xxhash64("id", F.lit(i)) % 100) / 100.0).alias(n) for i, n in enumerate(FEATURE_ORDER)],
    ).withColumn("label", (F.col("severity_score") > 0).cast("int")).cache()
    state = online.OnlineState()
    for _ in range(6):
        state = online.online_update(rows, state, rate=2.0)
    assert state.version == 6 and not state.drift_detected
    judged = online.online_predict(rows, state)
    assert judged.filter("predicted_label = label").count() > 540
    turned = rows.withColumn("label", 1 - F.col("label")).filter("seq < 30")
    after = online.online_update(turned, state)
    assert after.drift_detected and after.weights == state.stable["weights"] and after.version == state.version


def test_isolation_forest_ranks_planted_outliers_last(spark):
    rows = spark.range(2000).select(
        F.col("id"), (F.xxhash64("id") % 1000 / 1000.0).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000 / 1000.0).alias("b")
    )
    odd = spark.createDataFrame([(9001, 9.0, -9.0), (9002, -8.0, 8.0)], "id bigint, a double, b double")
    model = isolation.train_isolation_forest(rows, ["a", "b"], "id", 0.05, trees=30, sample=128)
    scored = isolation.anomaly_score(rows.unionByName(odd), model)
    assert scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()[0] >= 0.0
    # Outliers are no part of the training rows: they score like the most extreme of those.
    top = [r.id for r in scored.orderBy("decision").limit(20).collect()]
    assert {9001, 9002} <= set(top)
    assert scored.filter("id > 9000 AND decision < 0").count() == 2
    flagged = scored.filter("decision < 0").count() / 2002
    assert 0.03 < flagged < 0.08


def test_training_saves_and_loads(spark, tables):
    from wardline.operators.features import EVENT_FEATURES
    from wardline.plans.model_plans import labelled_features

    rows = labelled_features(spark, tables)
    model, report = models.train_pipeline(rows, EVENT_FEATURES, "event_id", trees=5, depth=4, isolation_trees=5)
    assert report["status"] == "trained" and report["normal_count"] == report["anomaly_count"]
    assert report["auc"] > 0.9
    place = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    model.save(place)
    again = models.load_model(spark, place)
    a = {r.event_id: r.probability_1 for r in models.predict(rows, model).collect()}
    b = {r.event_id: r.probability_1 for r in models.predict(rows, again).collect()}
    assert a == b
    assert models.load_model(spark, place + "/none") is None
    none, failed = models.train_pipeline(rows.filter("label = 1"), EVENT_FEATURES, "event_id")
    assert none is None and failed["status"] == "invalid_dataset"


def test_a_fitted_forest_predicts_after_counts_were_observed(spark):
    seen = Observation("rows before training")
    rows = spark.range(80).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 80
    model = forest.train_classifier(rows, ["x"], trees=2, depth=2)
    assert model.transform(rows).select("prediction").collect()


def test_online_plan_runs(spark, tables):
    rows = PLANS["online_learning_batches"](spark, tables).collect()
    assert sum(r.events for r in rows) == spark.read.parquet(f"{tables}/events.parquet").count()


def test_late_rows_and_disorder(spark):
    """Rows late within the watermark count the rows up to their time; rows behind it are dropped and counted."""
    events = made_events(spark).cache()
    second = F.col("at") / SECOND
    late, lost = (second >= 2900) & (second < 3000), (second >= 900) & (second < 1000)
    parts = [events.filter((second < 3100) & ~late & ~lost), events.filter(late), events.filter((second >= 3100) & (second < 9000))]
    parts += [events.filter(lost), events.filter(second >= 9000)]
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    parts[0].limit(0).write.mode("overwrite").parquet(f"{folder}/in")
    stream = jobs.window_features(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"))
    dropped = 0
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = stream_sink(stream, f"{folder}/checkpoint", path=f"{folder}/out", once=True).start()
        query.awaitTermination()
        dropped += sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
    names = ["login_frequency", "request_rate", "ip_change_frequency", "related_event_count", "suspicious_chain"]
    got = {r.event_id: tuple(r[n] for n in names) for r in spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()}
    rows = {r.event_id: r.at / SECOND for r in events.collect()}
    gone = {e for e, t in rows.items() if 900 <= t < 1000}
    assert gone and not gone & set(got) and dropped == len(gone)
    batch = behavior.suspicious_chain(ip_change_frequency(activity_rates(events.filter(~lost))))
    want = {r.event_id: tuple(r[n] for n in names) for r in batch.collect()}
    # Rows that were out before a late one came could not count it; all others equal the batch.
    assert {e: v for e, v in got.items() if rows[e] < 3000} == {e: v for e, v in want.items() if rows[e] < 3000}
    assert {e: v for e, v in got.items() if rows[e] >= 9000} == {e: v for e, v in want.items() if rows[e] >= 9000}


def test_dead_letters_keep_the_line_and_can_be_replayed(spark):
    lines = [
        '{"event_id": "a", "tenant_id": "t1", "timestamp": "2024-01-01T00:00:00", "risk_score": "much", "user": "u"}',
        '{"event_id": "b", "timestamp": "2024-01-01T00:00:00"}',
        '{"event_id": "c", "tenant_id": "t1", "timestamp": "soon"}',
        '{"event_id": "d", "tenant_id',
        '{"event_id": "e", "tenant_id": "t1", "timestamp": "2024-01-01T00:00:00"}',
    ]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    bad = {r.value: r.dlq_reason for r in run_parts(spark, [frame], lambda s: jobs.ingest_stream(s)[1]).collect()}
    assert bad == {
        lines[0]: "a number or the severity is not readable", lines[1]: "tenant_id is required",
        lines[2]: "timestamp is not readable", lines[3]: "malformed JSON",
    }
    mended = [x.replace("much", "7").replace('"b"', '"b", "tenant_id": "t2"').replace("soon", "2024-01-02T00:00:00") for x in bad if x != lines[3]]
    again = spark.createDataFrame([(x,) for x in mended], "value string")
    good = run_parts(spark, [frame, again], lambda s: jobs.ingest_stream(s)[0])
    assert {(r.event_id, r.tenant_id) for r in good.collect()} == {("a", "t1"), ("b", "t2"), ("c", "t1"), ("e", "t1")}


def test_rows_without_time_or_key_stay(spark):
    from wardline.operators import slices

    rows = [(None, 5, 1), (None, 7, 2), ("u", None, 3), ("u", 4, 4), ("u", 9, 5), (None, None, 6)]
    frame = spark.createDataFrame(rows, "user_name string, at bigint, seq bigint")
    assert {r.seq for r in slices.newest(frame, ["user_name"], "at", ["seq"], 2, 3).collect()} == {1, 2, 4, 5}
    assert {r.seq for r in slices.newest(frame, ["user_name"], "at", ["seq"], 9, 3).collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.seq for r in slices.newest(frame, [], "at", ["seq"], 4).collect()} == {1, 2, 4, 5}
    hashed = frame.withColumn("h", F.sha2(F.col("seq").cast("string"), 256))
    assert slices.lowest(hashed, ["user_name"], "h", F.lit(9), digits=1).count() == 6
    wide = slices.halo(frame, "at", 3)
    counted = slices.own_rows(wide.withColumn("n", slices.count_back(["user_name"], "at", ["seq"], 3))).collect()
    assert {r.seq: r.n for r in counted} == {1: 1, 2: 2, 3: None, 4: 1, 5: 1, 6: None}
    assert slices.sessions(frame, ["user_name"], "at", ["seq"], 2).count() == 6


def test_exact_quantile(spark):
    values = [0.1] * 50 + [i / 977 for i in range(900)] + [0.5 + 1e-15 * i for i in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for share in (0.0, 0.3, 0.5, 0.92, 1.0):
        wanted = min(v for v in values if sum(w <= v for w in values) >= share * len(values))
        assert isolation.exact_quantile(frame, "x", share) == wanted


class _Map(dict):
    """A map state that counts the characters that are read and written."""

    read = written = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.read += len(str(self[key][0]))
        return self[key]

    def updateValue(self, key, value):
        self.written += len(str(value[0]))
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map())

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, at):
        self.timers.append(at)


def test_waiting_alerts_are_not_read_again_for_every_frame():
    import pandas as pd

    throttle_state, handle = jobs.AlertThrottle(["at", "seq", "dedup_key"], 5, 60 * SECOND, 180 * SECOND, 86_400_000), _Handle()
    throttle_state.init(handle)
    frames = [pd.DataFrame({"at": [(i * 50 + j) * SECOND for j in range(50)], "seq": range(i * 50, i * 50 + 50), "dedup_key": "k"}) for i in range(60)]
    for part in (frames[:30], frames[30:]):
        list(throttle_state.handleInputRows(("t",), iter(part[::-1]), None))
    size = sum(len(frame.to_json(orient="values")) for frame in frames)
    assert sum(m.read for m in handle.maps.values()) < 100 and sum(m.written for m in handle.maps.values()) < size + 100

    class Expired:
        def getExpiryTimeInMs(self):
            return handle.timers[0]

    done = list(throttle_state.handleExpiredTimer(("t",), None, Expired()))
    assert [len(d) for d in done] == [3000] and not handle.maps["waiting"] and not handle.maps["parts"]
    assert done[0]["seq"].tolist() == list(range(3000)) and done[0]["decision"].iat[0] == "sent"


def test_a_new_incident_asks_its_state_little():
    """Most keys have one event: nothing is looked up among members that can't be there, and rows make no frames."""
    from pyspark.sql import Row

    from wardline.streaming.incidents import IncidentState

    asked = []

    class Counted(_Map):
        def containsKey(self, key):
            asked.append(key)
            return super().containsKey(key)

    state, handle = IncidentState(600 * SECOND), _Handle()
    handle.maps["members"] = Counted()
    state.init(handle)
    event = Row(at=5 * SECOND, event_id="e", incident_attack="bruteforce", user="u", source="auth", event_type="login_failure", peak=float("nan"), rank=3, triggers=None)
    (made,) = state.handleInputRows(("k",), iter([event]), None)
    assert (made.status, made.event_count, made._peak, made.start_at) == ("open", 1, None, 5 * SECOND) and not asked
    (again,) = state.handleInputRows(("k",), iter([event]), None)
    assert (again.event_count, again.version) == (1, 2) and asked == [("e",)]


def test_keys_of_a_bucket_share_their_calls_to_the_state():
    """A bucket of many keys asks the store a few times a micro-batch, and makes the versions of a state per key."""
    from pyspark.sql import Row

    from wardline.streaming.incidents import IncidentBuckets, IncidentState

    class Counted:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            self.calls += 1
            return self.kept()

        def change(self, rows):
            self.calls += 1
            self.rows = rows

        def clear(self):
            self.change([])

    class One(Counted):
        def kept(self):
            return self.rows[0] if self.rows else None

        def update(self, row):
            self.change([row])

    class Several(Counted):
        def kept(self):
            return iter(self.rows)

        def put(self, rows):
            self.change(rows)

        def appendList(self, rows):
            self.change(self.rows + rows)

    class Handle:
        def __init__(self):
            self.one, self.several, self.timers = One(), Several(), []

        def getValueState(self, *_):
            return self.one

        def getListState(self, *_):
            return self.several

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    facts = {"incident_attack": "bruteforce", "user": "u", "source": "auth", "event_type": "login_failure", "peak": 5.0, "rank": 3, "triggers": None}
    steps = [
        [Row(incident_key=f"k{k}", at=(at + k) * SECOND, event_id=e, **facts) for k in range(200) for at, e in some]
        for some in ([(0, "a"), (900, "b"), (5000, "z")], [(500, "late"), (900, "b"), (950, None)])
    ]
    handle, bucket, kept, alone = Handle(), IncidentBuckets(600 * SECOND), {}, {}
    bucket.init(handle)
    for rows in steps:
        made = list(bucket.handleInputRows((1,), iter(rows), Clock(0)))
        for k in range(200):
            if k not in alone:
                kept[k], alone[k] = _Handle(), IncidentState(600 * SECOND)
                alone[k].init(kept[k])
        own = [v for k in range(200) for v in alone[k].handleInputRows((f"k{k}",), iter([r for r in rows if r.incident_key == f"k{k}"]), None)]
        assert sorted(map(str, made)) == sorted(map(str, own))
    assert handle.one.calls + handle.several.calls <= 8 and len(handle.timers) <= 2
    for end in (1700 * 1000, 10_000 * 1000):
        assert handle.timers[-1] <= end
        made = list(bucket.handleExpiredTimer((1,), Clock(end), Clock(handle.timers[-1])))
        own = [v for k in range(200) for v in alone[k].handleExpiredTimer((f"k{k}",), None, Clock(end))]
        assert sorted(map(str, made)) == sorted(map(str, own)) and {v.status for v in made} == {"closed", "member"}
    assert not handle.one.rows and not handle.several.rows


def test_a_stored_table_gives_only_the_columns_that_are_read(spark):
    from wardline.session import stored

    rows = spark.range(20).select("id", F.concat(F.lit("v"), "id").alias("text"), F.when(F.col("id") > 5, F.array("id")).alias("list"))
    kept = stored(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


class _Held(dict):
    """A map state and a value state in memory; ``calls`` counts what is asked of it."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def get(self):
        self.calls += 1
        return dict.get(self, "value")

    def update(self, value):
        self.calls += 1
        self["value"] = value

    def clear(self):
        self.pop("value", None)


class _Calls:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Held())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


class _Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _windows():
    made = jobs.UserWindows(["user_name", "seq"], 900 * SECOND, 60 * SECOND, 900 * SECOND, 200)
    handle = _Calls()
    made.init(handle)
    return made, handle


def test_a_bucket_counts_its_users_apart_with_few_calls():
    """Users of one bucket in two micro-batches are counted as alone; a new user costs one call, an old one two."""
    kinds = ["login_failure", "process_create", "network_connection"]
    rows = [(f"u{i % 7}", i, (i * 37 % 400) * SECOND, f"10.0.0.{i % 4}", f"h{i % 2}", kinds[i // 7 % 3]) for i in range(210)]
    frame = pd.DataFrame(rows, columns=["user_name", "seq", "at", "ip_address", "host", "event_type"])
    parts = [frame[frame["at"] < 200 * SECOND], frame[frame["at"] >= 200 * SECOND]]

    def run(parts):
        windows, handle = _windows()
        made = [pd.concat(list(windows.handleInputRows((0,), iter([p.iloc[:9], p.iloc[9:]]), _Watermark(0)))) for p in parts]
        return {row[1]: row for part in made for row in part.itertuples(index=False, name=None)}, handle

    together, handle = run(parts)
    alone = {}
    for user in sorted(set(frame["user_name"])):
        alone |= run([p[p["user_name"] == user] for p in parts])[0]
    assert together == alone and len(together) == len(frame)
    assert sum(store.calls for store in handle.states.values()) == 7 + 14 + 4 and len(handle.timers) == 1


def test_idle_users_of_a_bucket_are_forgotten_and_others_stay():
    windows, handle = _windows()

    def feed(user, at):
        frame = pd.DataFrame([(user, at, at * SECOND, "10.0.0.1", "h", "scan")], columns=["user_name", "seq", "at", "ip_address", "host", "event_type"])
        (out,) = windows.handleInputRows((0,), iter([frame]), _Watermark(0))
        return out["login_frequency"].tolist()

    def fire(at):
        return list(windows.handleExpiredTimer((0,), _Watermark(at), _Watermark(at)))

    users = lambda: {user for (user,) in handle.states["windows"]}
    feed("a", 0), feed("b", 100), feed("c", 50)
    end = 900_000 + jobs.IDLE_MS  # milliseconds for which a user is kept
    assert handle.timers == [end]
    feed("a", 200)
    assert fire(end) == [] and users() == {"a", "b", "c"} and handle.timers[-1] == end + 50_000
    fire(end + 50_000)
    assert users() == {"a", "b"} and handle.timers[-1] == end + 100_000
    fire(end + 150_000)
    assert users() == {"a"} and handle.timers[-1] == end + 200_000
    assert feed("c", 210) == [round(1 / 15, 4)] and feed("a", 220) == [round(3 / 15, 4)]
    fire(end + 300_000)
    assert users() == set() and "value" not in handle.states["kept"]


def test_the_forest_is_trained_on_even_parts(spark, monkeypatch):
    """However few parts the rows come in, each core gets its share of them."""
    sizes = []

    class Spied(forest.Pipeline):
        def fit(self, df):
            sizes.extend(df.select("x").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
            return super().fit(df)

    monkeypatch.setattr(forest, "Pipeline", Spied)
    rows = spark.range(0, 4000, 1, 1).selectExpr("double(id % 97) AS x", "double(id % 31) AS y", "int(id % 97 > 40) AS label")
    model = forest.train_classifier(rows, ["x", "y"], trees=5, depth=4)
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) == cores and sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / cores
    assert model.transform(rows).filter("prediction <> label").count() == 0


def test_a_forest_of_many_rows_is_grown_in_batches_of_trees(spark, monkeypatch):
    """The whole number of trees, at most so many rows x trees at a time, no two batches alike; and it is stored like any other."""
    fitted = []

    class Spied(forest.RandomForestClassifier):
        def fit(self, df):
            fitted.append((self.getNumTrees(), self.getSeed()))
            return super().fit(df)

    monkeypatch.setattr(forest, "RandomForestClassifier", Spied)
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "double(id % 97) AS x", "double(id % 31) AS y", "int(id % 97 > 40) AS label")
    assert forest.train_classifier(rows, ["x", "y"], trees=10, depth=3).stages[-1].getNumTrees == 10 and len(fitted) == 1
    monkeypatch.setattr(forest, "TREE_ROWS", 4 * 4000)
    model = forest.train_classifier(rows, ["x", "y"], trees=10, depth=3)
    whole = model.stages[-1]
    assert [n for n, _ in fitted[1:]] == [4, 4, 2] and len({seed for _, seed in fitted[1:]}) == 3
    assert whole.getNumTrees == len(whole.trees) == 10 and whole.numFeatures == 2 and whole.numClasses == 2
    place = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    model.write().overwrite().save(place)
    again = forest.PipelineModel.load(place)
    first, second = ({r.id: tuple(r.probability) for r in m.transform(rows).collect()} for m in (model, again))
    assert first == second and len(first) == 4000
    assert model.transform(rows).filter("prediction <> label").count() == 0
