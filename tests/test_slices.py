"""The sliced operators against plain Python, with ties, dense keys and one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import behavior, scoring, slices, throttle, timeline
from wardline.operators.stream_features import activity_rates, ip_change_frequency
from wardline.session import settle

SECOND = 1_000_000


def test_lowest_refines_only_the_cell_of_the_limit(spark):
    """All ranks in one old cell, keys of their own limits, null keys, and limits of none and of all."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), "abc" + "".join(rng.choice("0123456789abcdef") for _ in range(61)), i) for i in range(3000)]
    limits = {"a": 700, "b": 5000, None: 0}
    limit = F.when(F.col("key") == "a", 700).when(F.col("key") == "b", 5000).otherwise(0)
    df = spark.createDataFrame(rows, "key string, h string, id int")
    got = slices.lowest(df, ["key"], "h", limit, most=3)
    assert got.columns == df.columns
    want = {r[2] for k in limits for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])[: limits[k]]}
    assert {r.id for r in got.collect()} == want
    assert slices.lowest(df, ["key"], "h", F.lit(None).cast("int")).count() == 0 and slices.lowest(df.limit(0), ["key"], "h", F.lit(3)).count() == 0


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        user = "hot" if rng.random() < 0.5 else rng.choice("abc")
        at = rng.choice([rng.randrange(0, 7200), 900 * rng.randrange(0, 8)]) * SECOND
        kind = rng.choice(["login_failure", "process_create", "network_connection", "login_success"])
        rows.append((user, rng.choice(["h1", "h2"]), at, i, kind, f"10.0.0.{rng.randrange(3)}", rng.random() * 100))
    schema = "user_name string, host string, at bigint, seq bigint, event_type string, ip_address string, value double"
    return rows, spark.createDataFrame(rows, schema).cache()


def by_user(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_rates_are_the_ring_buffer_ones(events):
    rows, df = events
    want = {}
    for listed in by_user(rows).values():
        times = []
        for r in listed:
            times.append(r[2])
            n15 = sum(r[2] - t <= 900 * SECOND for t in times[-120:])
            n1 = sum(r[2] - t <= 60 * SECOND for t in times[-120:])
            want[r[3]] = (round(min(n15 / 15, 1.0), 4), round(min(n1 / 10, 1.0), 4))
    got = {r.seq: (r.login_frequency, r.request_rate) for r in activity_rates(df).collect()}
    assert got == want


@pytest.mark.parametrize("per_slice", [20, 64, 100_000])
def test_address_changes_in_the_ring(events, per_slice):
    rows, df = events
    want = {}
    for listed in by_user(rows).values():
        ring = []
        for r in listed:
            ring = (ring + [r[5]])[-20:]
            changes = sum(a != b for a, b in zip(ring, ring[1:]))
            want[r[3]] = round(changes / (len(ring) - 1), 4) if len(ring) > 1 else 0.0
    out = ip_change_frequency(df, width=600 * SECOND, rows_per_slice=per_slice)
    assert {r.seq: r.ip_change_frequency for r in out.collect()} == want


def test_burst_boundary_is_inclusive(spark):
    rows = [("u", i * 225 * SECOND, i, "login_failure") for i in range(5)]  # 0 .. 900 s
    rows += [("v", i * 225 * SECOND + (SECOND if i == 4 else 0), 10 + i, "login_failure") for i in range(5)]
    df = spark.createDataFrame(rows, "user_name string, at bigint, seq bigint, event_type string")
    got = {r.seq: r.burst for r in scoring.failed_login_burst(df).collect()}
    assert got[4] is True and got[14] is False


@pytest.mark.parametrize("cap", [5, 200])
def test_chain_with_row_cap(events, cap):
    rows, df = events
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        groups.setdefault((r[1], r[0]), []).append(r)
    want = {}
    for listed in groups.values():
        for i, r in enumerate(listed):
            recent = [q for q in listed[max(0, i - cap + 1) : i + 1] if r[2] - q[2] <= 900 * SECOND]
            kinds = {q[4] for q in recent}
            want[r[3]] = (len(recent), set(behavior.CHAIN_TYPES) <= kinds, sorted(kinds))
    out = behavior.suspicious_chain(df, rows=cap, with_types=True)
    assert {r.seq: (r.related_event_count, r.suspicious_chain, r.related_types) for r in out.collect()} == want


def test_running_newest_and_previous(events):
    rows, df = events
    groups = by_user(rows)
    out = slices.running(
        df, ["user_name"], "at", ["seq"], {"n": ("sum", F.lit(1)), "top": ("max", F.col("value"))}, 500 * SECOND
    )
    got = {r.seq: (r.n, r.top) for r in out.collect()}
    for listed in groups.values():
        top = 0.0
        for i, r in enumerate(listed):
            top = max(top, r[6])
            assert got[r[3]] == (i + 1, top)
    before = {r.seq: r.before for r in slices.previous(df, ["user_name"], "at", ["seq"], "event_type", "before", 500 * SECOND).collect()}
    for listed in groups.values():
        assert before[listed[0][3]] is None
        for a, b in zip(listed, listed[1:]):
            assert before[b[3]] == a[4]
    for limit in (1, 7, 250, 5000):
        kept = {r.seq for r in slices.newest(df, ["user_name"], "at", ["seq"], limit, 500 * SECOND).collect()}
        assert kept == {r[3] for listed in groups.values() for r in listed[-limit:]}


def test_lowest_takes_exactly_the_smallest_hashes(events):
    rows, df = events
    hashed = df.withColumn("h", F.sha2(F.col("seq").cast("string"), 256))
    got = {r.seq for r in slices.lowest(hashed, ["host"], "h", F.lit(37), digits=1).collect()}
    listed = sorted(((r.host, r.h, r.seq) for r in hashed.collect()))
    want = set()
    for host in ("h1", "h2"):
        want |= {seq for h, _, seq in [x for x in listed if x[0] == host][:37]}
    assert got == want


def test_sessions_split_only_beyond_the_gap(spark):
    times = [0, 600, 1200, 1801, 2401, 9000]
    df = spark.createDataFrame([("k", t * SECOND, i) for i, t in enumerate(times)], "key string, at bigint, seq bigint")
    for width in (600 * SECOND, None):
        got = slices.sessions(df, ["key"], "at", ["seq"], 600 * SECOND, width).orderBy("seq").collect()
        assert [r.session_start // SECOND for r in got] == [0, 0, 0, 1801, 1801, 9000]


def dense_alerts(seed, keys="ab"):
    rng = random.Random(seed)
    rows, clock = [], dict.fromkeys(keys, 0)
    for i in range(900):
        key = rng.choice(keys)
        clock[key] += rng.choice([0, 1, 1, 2, 4, 30, 190]) * SECOND
        rows.append((key, clock[key], i, rng.choice("pqrstuvwxyz")))
    return rows


@pytest.mark.parametrize("width", [180 * SECOND, 700 * SECOND, None])
def test_delivery_is_the_sequential_one(spark, width):
    rows = dense_alerts(3)
    log, sent, want = {}, {}, {}
    for tenant, at, seq, key in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        window = [t for t in log.get(tenant, []) if at - t < 60 * SECOND]
        marks = {k: t for k, t in sent.get(tenant, {}).items() if at - t <= 180 * SECOND}
        if len(window) >= 15:
            want[seq] = "rate_limited"
        else:
            window.append(at)
            if key in marks:
                want[seq] = "duplicate"
            else:
                marks[key] = at
                window.append(at)
                want[seq] = "sent"
        log[tenant], sent[tenant] = window, marks
    df = spark.createDataFrame(rows, "tenant_id string, at bigint, seq int, dedup_key string")
    got = {r.seq: r.decision for r in throttle.throttle_rate(df, width=width).collect()}
    assert got == want and set(want.values()) == {"rate_limited", "duplicate", "sent"}


def test_api_limit_counts_admitted_calls(spark):
    rows = dense_alerts(4, "xyz")
    log, want = {}, {}
    for tenant, at, seq, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        window = [t for t in log.get(tenant, []) if at - t <= 60 * SECOND]
        want[seq] = "rejected" if len(window) >= 6 else "admitted"
        log[tenant] = window + ([at] if want[seq] == "admitted" else [])
    df = spark.createDataFrame(rows, "tenant_id string, at bigint, seq int, other string")
    got = {r.seq: r.decision for r in throttle.api_rate_limit(df, 6, width=400 * SECOND).collect()}
    assert got == want


def test_nearest_events_per_key(spark, events):
    rows, df = events
    probes = [(u, f"{u}{t}", t * SECOND) for u in ("hot", "a", "none") for t in (0, 13, 450, 3601, 9999)]
    out = timeline.nearest_events(
        spark.createDataFrame(probes, "user_name string, probe_id string, at bigint"), df, "user_name", width=300 * SECOND
    )
    for r in out.collect():
        times = sorted({q[2] for q in rows if q[0] == r.user_name})
        want = min(times, key=lambda t: (abs(t - r.probe_at), t)) if times else None
        assert r.event_at == want


def test_rounds_grow_with_the_logarithm_of_the_slices(spark, monkeypatch):
    """Traffic that never pauses: the state of every slice depends on the one before."""
    times = sorted({i * 7 + i * i % 5 for i in range(900)})
    rows = [("a", t * SECOND, i) for i, t in enumerate(times)] + [(None, t * SECOND, 5000 + i) for i, t in enumerate(times[:300])]
    log, want = {}, {}
    for tenant, at, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        window = [t for t in log.get(tenant, []) if at - t <= 60 * SECOND]
        want[seq] = "rejected" if len(window) >= 3 else "admitted"
        log[tenant] = window + ([at] if want[seq] == "admitted" else [])
    written = []
    monkeypatch.setattr(throttle, "settle", lambda df: written.append(1) or settle(df))
    df = spark.createDataFrame(rows, "tenant_id string, at bigint, seq int")
    got = {r.seq: r.decision for r in throttle.api_rate_limit(df, 3, span=60 * SECOND, width=100 * SECOND).collect()}
    assert got == want
    assert len(written) <= 2 + 2 * 6  # 63 slices


def test_rounds_of_delivery_grow_with_the_logarithm_of_the_slices(spark, monkeypatch):
    written = []
    monkeypatch.setattr(throttle, "settle", lambda df: written.append(1) or settle(df))
    rows = [("a", i * 7 * SECOND, i, f"k{i % 4}") for i in range(1600)]
    df = spark.createDataFrame(rows, "tenant_id string, at bigint, seq int, dedup_key string")
    whole = throttle.throttle_rate(df, limit=3, width=20_000 * SECOND).collect()  # one slice
    del written[:]
    got = throttle.throttle_rate(df, limit=3, width=180 * SECOND).collect()
    assert {r.seq: r.decision for r in got} == {r.seq: r.decision for r in whole}
    assert len({r.decision for r in got}) > 1 and len(written) <= 2 + 2 * 6  # 63 slices


def test_scores_of_delivered_alerts_are_computed_once(spark):
    """The rows that an alert is made of are read once, whatever steps the throttle takes; columns may have no type."""
    from wardline.operators import alerts

    rows = [(i, "ab"[i % 2], f"u{i % 3}", "scan", i * 20 * SECOND, 25.0 + i % 10) for i in range(400)]
    schema = "seq long, tenant_id string, user_name string, event_type string, at long, risk_score double"
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scored = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    once = {(r.seq, r.decision) for r in alerts.deliver_alerts(scored).collect()}
    assert seen.value == len(rows)
    untyped = spark.createDataFrame(rows, schema).withColumn("note", F.lit(None))
    assert {(r.seq, r.decision) for r in alerts.deliver_alerts(untyped).collect()} == once
    assert {seq for seq, _ in once} == {r[0] for r in rows if r[5] >= 30} and len({d for _, d in once}) > 1
