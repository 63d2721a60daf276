"""Rows without a key or a time: kept, and a null key is a key of its own, as plain Python has it."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import incidents, slices, throttle, timeline
from wardline.operators.stream_features import stream_features

SECOND = 1_000_000
SCHEMA = "tenant_id string, host string, at bigint, seq bigint"


def plain_dedup(rows, ttl):
    last, out = {}, {}
    for tenant, host, at, seq in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[3])):
        key = (tenant, host)
        if key in last and at - last[key] <= ttl:
            out[seq] = "duplicate"
        else:
            out[seq], last[key] = "sent", at
    return out | {r[3]: None for r in rows if r[2] is None}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    made = []
    for i in range(3000):
        tenant = rng.choice(["hot", "hot", "hot", "b", None])
        at = rng.choice([rng.randrange(0, 40_000), 3600 * rng.randrange(12), None if rng.random() < 0.03 else rng.randrange(20_000, 22_000)])
        made.append((tenant, rng.choice(["h", None]), None if at is None else at * SECOND, i))
    return made


@pytest.mark.parametrize(("ttl", "width"), [(180, None), (180, 400), (7, 14), (0, 5), (5000, None)])
def test_duplicates_follow_the_rows_that_were_sent(spark, rows, ttl, width):
    df = spark.createDataFrame(rows, SCHEMA)
    found = throttle.throttle_dedup(df, ["tenant_id", "host"], ttl=ttl * SECOND, width=width and width * SECOND)
    assert found.columns == [*df.columns, "decision"]
    assert {r.seq: r.decision for r in found.collect()} == plain_dedup(rows, ttl * SECOND)


def test_pointers_take_few_rounds(spark, monkeypatch):
    """Traffic that never pauses: ten thousand sent rows in some fourteen rounds, not one a slice."""
    calls = []
    monkeypatch.setattr(throttle, "settle", lambda df, own=throttle.settle: calls.append(1) or own(df))
    df = spark.range(20_000).selectExpr("'t' AS tenant_id", "'h' AS host", "id * 1000000 AS at", "id AS seq")
    found = throttle.throttle_dedup(df, ["tenant_id", "host"], ttl=SECOND)
    assert found.filter("decision = 'sent'").agg(F.count("*"), F.max(F.col("seq") % 2)).first()[:] == (10_000, 0)
    assert len(calls) <= 2 + 2 * 15


def test_rates_keep_null_keys_and_times(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("dedup_key", F.col("host"))
    calls = throttle.api_rate_limit(df, 5, width=4000 * SECOND).collect()
    assert len(calls) == len(rows)
    assert all((r.decision is None) == (r.at is None) for r in calls)
    admitted = {}
    for r in sorted((r for r in calls if r.at is not None), key=lambda r: (r.at, r.seq)):
        recent = [t for t in admitted.setdefault(r.tenant_id, []) if r.at - t <= 60 * SECOND]
        assert r.decision == ("admitted" if len(recent) < 5 else "rejected")
        admitted[r.tenant_id] = recent + [r.at] * (r.decision == "admitted")
    alerts = throttle.throttle_rate(df).collect()
    assert len(alerts) == len(rows) and {r.tenant_id for r in alerts if r.decision == "sent"} == {"hot", "b", None}


def test_running_values_and_positions_of_null_keys(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    order = lambda r: (r[2] is not None, r[2] or 0, r[3])
    place, before, group = {}, {}, {}
    for r in sorted(rows, key=order):
        own = group.setdefault((r[0], r[1]), [])
        before[r[3]] = own[-1] if own else None
        own.append(r[3])
        place[r[3]] = len(own)
    numbered = slices.numbered(df, ["tenant_id", "host"], "at", ["seq"])
    assert {r.seq: r.row_no for r in numbered.collect()} == place
    previous = slices.previous(df, ["tenant_id", "host"], "at", ["seq"], "seq", "before")
    assert {r.seq: r.before for r in previous.collect()} == before
    found = timeline.positions(df, ["tenant_id", "host"]).collect()
    sizes = {k: len(v) for k, v in group.items()}
    assert {r.seq: (r.position + 1, r.total) for r in found} == {r[3]: (place[r[3]], sizes[r[0], r[1]]) for r in rows}


def test_stream_features_keep_rows_without_a_time(spark):
    rows = [("u", 5 * SECOND, 1), ("u", None, 2), (None, None, 3), (None, 7 * SECOND, 4), ("u", 6 * SECOND, 5)]
    df = spark.createDataFrame(rows, "user_name string, at bigint, seq bigint").selectExpr(
        "*", "'10.0.0.' || seq AS ip_address", "'auth' AS source", "'low' AS severity", "'none' AS attack_type"
    )
    found = {r.seq: r for r in stream_features(df).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    assert found[2].login_frequency is None and found[3].user_name == "unknown" and found[5].login_frequency > 0


def test_sessions_of_a_null_key(spark):
    rows = [(None, "h", 0, 1), (None, "h", 10, 2), (None, "h", 100, 3), ("t", "h", 20, 4), (None, "h", None, 5)]
    found = slices.sessions(spark.createDataFrame(rows, SCHEMA), ["tenant_id"], "at", ["seq"], 50).collect()
    assert {r.seq: r.session_start for r in found} == {1: 0, 2: 0, 3: 100, 4: 20, 5: None}
    assert incidents.GAP_SECONDS == 600
