"""Streaming jobs.  Each takes a streaming frame and returns one (or more) to be written.

Event time counts: within a micro-batch a key's rows are handled in (time, id) order. Rows older than the
watermark are dropped by Spark and show in its progress (``wardline.streaming.lag``).
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.functions import risk
from wardline.functions.casts import instant, seconds_to_micros
from wardline.operators import alerts, behavior, normalize, quality, scoring, ueba
from wardline.operators.incidents import GAP_SECONDS
from wardline.operators.stream_features import (
    ADDRESS_RING,
    LOGIN_FULL,
    LOGIN_SPAN,
    REQUEST_FULL,
    REQUEST_SPAN,
    cold_start_score,
    user_behavior_score,
)
from wardline.operators.throttle import DEDUP_TTL, RATE_LIMIT, RATE_SPAN
from wardline.session import ship_package
from wardline.sources.files import json_fields
from wardline.sources.schemas import CANONICAL_EVENT
from wardline.streaming.incidents import BUCKETS, incident_versions
from wardline.streaming.io import use_rocksdb

USER_STATE = "body string"
# A user's addresses are forgotten when no row came for this long after the windows have passed.
IDLE_MS = 30 * 24 * 3600 * 1000
WINDOW_SCHEMA = (
    "login_frequency double, request_rate double, ip_change_frequency double, related_event_count bigint, suspicious_chain boolean"
)


def _kept(rows: list, watermark: int, limit: int | None, span: int = 0) -> list:
    """What later rows may look back on: rows after the watermark, and before it the last ``limit`` if there is one
    (of those that a look-back of ``span`` from the watermark reaches, if there is a span)."""
    old = 0 if limit is None else bisect_left(rows, [watermark]) - limit
    reached = bisect_left(rows, [watermark - span]) if span else 0
    return rows[max(old, reached, 0) :]


class UserWindows(StatefulProcessor):
    """Window features of the users of a bucket, row by row in event time.

    A row counts its user's rows at or before it only, however late it comes within the watermark. A user's state
    holds the rows after the watermark, and of those before it as many as rates and the ring of addresses can look
    back on, and all rows of the span of a host's chain check. Rows behind the watermark are dropped and counted by Spark;
    a timer clears the state of a user that has been idle for the chain window.

    There are many users with few rows each, and calls to the state store and for a frame of few rows take longer than
    the rows do. So users are dealt to buckets: their rows come together, each user's state is one entry of a map, and
    the times up to which they are kept are one value, with one timer at the earliest.
    """

    def __init__(self, columns: list[str], login: int, request: int, chain: int, chain_rows: int | None = None) -> None:
        self.columns, self.login, self.request = columns, login, request
        self.chain, self.chain_rows = chain, chain_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("windows", "user_name string", USER_STATE)
        self.kept = handle.getValueState("kept", "timer bigint, until string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in WINDOW_SCHEMA.split(", ")]
        frame = pd.concat(list(rows))
        timeless = frame[frame["at"].isna()]
        if len(timeless):
            # A row without a time looks back on nothing and is not looked back on.
            yield timeless[self.columns].assign(**dict.fromkeys(names))
            frame = frame[frame["at"].notna()]
            if not len(frame):
                return
            frame = frame.assign(at=frame["at"].astype("int64"))
        frame = frame.sort_values(["user_name", "at", "seq"], kind="stable").reset_index(drop=True)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        timer, until = self._read()
        made = []
        read = [frame[name].tolist() for name in ("at", "seq", "ip_address", "host", "event_type")]
        users = frame["user_name"].tolist()
        first = 0
        while first < len(users):
            user = users[first]
            end = bisect_right(users, user, first)
            held = json.loads(self.state.getValue((user,))[0]) if user in until else {"seen": [], "hosts": {}}
            made += self._counted(held, zip(*(column[first:end] for column in read)))
            trails = {host: _kept(trail, watermark, self.chain_rows, self.chain) for host, trail in held["hosts"].items()}
            seen = _kept(held["seen"], watermark, max(LOGIN_FULL, REQUEST_FULL, ADDRESS_RING))
            self.state.updateValue((user,), (json.dumps({"seen": seen, "hosts": {h: t for h, t in trails.items() if t}}),))
            until[user] = int(seen[-1][0] + max(self.chain, self.login, self.request)) // 1000 + IDLE_MS
            first = end
        self._write(timer, until)
        yield pd.concat([frame[self.columns], pd.DataFrame(made, columns=names)], axis=1)

    def _counted(self, held: dict, rows: Iterator[tuple]) -> list[tuple]:
        """The features of a user's rows in order; the rows are put into ``held``."""
        seen, hosts, made = held["seen"], held["hosts"], []
        # The rows of each needed type, so that the span isn't gone through for each row.
        typed = {}
        for at, seq, address, host, kind in rows:
            row = [at, seq, address if address is not None else "unknown"]
            here = bisect_right(seen, row)
            seen.insert(here, row)
            logins = here + 1 - bisect_left(seen, [at - self.login])
            requests = here + 1 - bisect_left(seen, [at - self.request])
            ips = [r[2] for r in seen[max(here + 1 - ADDRESS_RING, 0) : here + 1]]
            changes = sum(a != b for a, b in zip(ips, ips[1:]))
            trail = hosts.setdefault(str(host), [])
            if str(host) not in typed:
                typed[str(host)] = {t: [r for r in trail if r[2] == t] for t in behavior.CHAIN_TYPES}
            kinds = typed[str(host)]
            step = [at, seq, kind if kind in kinds else ""]
            place = bisect_right(trail, step)
            trail.insert(place, step)
            if kind in kinds:
                insort(kinds[kind], step)
            first = bisect_left(trail, [at - self.chain])
            if self.chain_rows is not None:
                first = max(first, place + 1 - self.chain_rows)
            latest = [(of, bisect_right(of, step) - 1) for of in kinds.values()]
            made.append(
                (
                    round(min(logins / LOGIN_FULL, 1.0), 4),
                    round(min(requests / REQUEST_FULL, 1.0), 4),
                    round(changes / (len(ips) - 1), 4) if len(ips) > 1 else 0.0,
                    place + 1 - first,
                    all(last >= 0 and of[last] >= trail[first] for of, last in latest),
                )
            )
        return made

    def _read(self) -> tuple[int | None, dict[str, int]]:
        """When the bucket's timer expires, and the time up to which each user's state is kept."""
        stored = self.kept.get()
        return (None, {}) if stored is None else (stored[0], json.loads(stored[1]))

    def _write(self, timer: int | None, until: dict[str, int]) -> None:
        if not until:
            self.kept.clear()
            return
        earliest = min(until.values())
        if timer is None or earliest < timer:
            timer = earliest
            self.handle.registerTimer(timer)
        self.kept.update((timer, json.dumps(until)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(int(timerValues.getCurrentWatermarkInMs()), int(expiredTimerInfo.getExpiryTimeInMs()))
        timer, until = self._read()
        for user in [user for user, end in until.items() if end <= now]:
            self.state.removeKey((user,))
            del until[user]
        self._write(None if timer is not None and timer <= now else timer, until)
        return iter([])

    def close(self) -> None:
        pass


def window_features(
    events: DataFrame,
    login_span: float = LOGIN_SPAN,
    request_span: float = REQUEST_SPAN,
    chain_span: float = behavior.CHAIN_SPAN,
    lateness: str = "10 minutes",
) -> DataFrame:
    """A stream of events (with ``ts``, ``at``, ``seq``) and their window features, state kept in buckets of users.

    A missing user is "unknown", as in the batch operators; the features of rows without a time are null.
    """
    use_rocksdb(events.sparkSession)
    ship_package(events.sparkSession)
    events = events.withColumn("user_name", F.coalesce("user_name", F.lit("unknown")))
    columns = events.columns
    schema = ", ".join(f"`{name}` {kind}" for name, kind in events.dtypes) + ", " + WINDOW_SCHEMA
    windows = UserWindows(
        columns, seconds_to_micros(login_span), seconds_to_micros(request_span), seconds_to_micros(chain_span)
    )
    return (
        events.withColumn("_bucket", F.pmod(F.xxhash64("user_name"), F.lit(BUCKETS)))
        .withWatermark("ts", lateness)
        .groupBy("_bucket")
        .transformWithStateInPandas(windows, schema, outputMode="Append", timeMode="EventTime")
    )


def score_stream(events: DataFrame, **windows) -> DataFrame:
    """Events with features, model score before any learning, risk, alert flag, stage and response.

    A learned model replaces the first score in ``foreachBatch`` (see ``wardline.ml.online``).
    """
    featured = window_features(events, **windows)
    clock = F.timestamp_micros("at")
    hour, minute = F.hour(clock), F.minute(clock)
    source = F.lower("source")
    fed = featured.withColumns(
        {
            "severity_score": risk.severity_weight("severity"),
            "hour_fraction": F.bround(hour / F.lit(23.0), 4),
            "minute_fraction": F.bround(minute / F.lit(59.0), 4),
            "is_after_hours": F.when((hour < 6) | (hour > 20), 1.0).otherwise(0.0),
            "source_auth": (source == "auth").cast("double"),
            "source_network": (source == "network").cast("double"),
            "attack_weight": risk.attack_weight("attack_type"),
            "input_severity": F.col("severity"),
        }
    )
    modelled = fed.withColumns({"ml_score": cold_start_score(), "user_behavior_score": user_behavior_score()})
    responded = behavior.recommended_response(modelled)
    scored = scoring.risk_score(responded)
    return behavior.mitre_map(scored).withColumn("kill_chain_stage", behavior.kill_chain_stage())


def windows_stream(records: DataFrame, **windows) -> DataFrame:
    """Windows telemetry scored like any event; needs ``ts``, ``at``, ``seq`` next to its fields."""
    code = F.col("event_id").cast("int")
    normal = normalize.normalize_windows(records.withColumn("event_id", code).withColumn(
        "timestamp", F.struct("ts", "at", "seq", "timestamp")
    ))
    events = normal.select(
        F.col("timestamp.seq").cast("string").alias("event_id"), F.col("event_id").alias("windows_event_id"),
        "timestamp.ts", "timestamp.at", "timestamp.seq", "tenant_id", "host", F.col("user").alias("user_name"),
        "event_type", "source", "severity", "ip_address", "process_name", "attack_stage",
        F.lit("none").alias("attack_type"),
    )
    return score_stream(events, **windows)


def judge_lines(lines: DataFrame, schema: str = CANONICAL_EVENT) -> DataFrame:
    """Each JSON line (``value``) with its canonical event, ``tenant_id``, ``ts``, and ``dlq_reason`` if it is none.

    Events without a tenant, a readable time or readable numbers are none. One pass: both sorts are told
    apart by the reason.
    """
    fields = json_fields(lines.select(F.col("value").alias("_line")), schema, "_line")
    tenant = F.nullif(F.coalesce(F.col("tenant_id"), F.try_element_at("metadata", F.lit("tenant_id"))), F.lit(""))
    keep = ["_line", "_broken", "_tenant"]
    checked = normalize.canonicalize(fields.withColumn("_tenant", tenant).drop("tenant_id"), keep=keep)
    timed = checked.withColumns({"tenant_id": F.col("_tenant"), "ts": instant("timestamp")})
    reason = (
        F.when(F.col("_broken"), "malformed JSON")
        .when(F.col("tenant_id").isNull(), "tenant_id is required")
        .when(F.col("ts").isNull(), "timestamp is not readable")
        .when(F.col("event_id") == normalize.FALLBACK["event_id"], "a number or the severity is not readable")
    )
    return timed.withColumn("dlq_reason", reason).withColumnRenamed("_line", "value").drop("_broken", "_tenant")


def ingest_stream(lines: DataFrame, schema: str = CANONICAL_EVENT, lateness: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(canonical events, dead letters) of a stream of JSON lines; write each with its own query.

    Dead letters are the line as it came and the reason, so that they can be mended and replayed.  Repeated
    ids are dropped while the watermark remembers them.  ``process.process_lines`` does both in one query.
    """
    judged = judge_lines(lines, schema)
    events = (
        judged.filter("dlq_reason IS NULL").drop("dlq_reason", "value")
        .withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
    return events, judged.filter("dlq_reason IS NOT NULL").select("value", "dlq_reason")


def incident_stream(
    scored: DataFrame, gap: float = GAP_SECONDS, lateness: str = "10 minutes", user: str = "user_name"
) -> DataFrame:
    """Versions of incidents and, once an incident is closed, its members; see ``wardline.streaming.incidents``."""
    return incident_versions(scored, gap, lateness, user)


#: Alerts of so much event time are decided together, once the watermark has passed them.
BUCKET_MS = 10_000


class AlertThrottle(StatefulProcessor):
    """Delivery decisions of one tenant's alerts in event time.

    Alerts wait in buckets of event time until the watermark has passed their bucket, so disorder within the watermark
    changes nothing; later ones are dropped and counted by Spark. The tokens of the last ``span`` are a short
    list; the times of sent alerts are kept by dedup key, each on its own, and cleared ``ttl`` after the watermark
    has passed them.
    """

    def __init__(self, columns: list[str], limit: int, span: int, ttl: int, bucket_ms: int) -> None:
        self.columns, self.limit, self.span, self.ttl, self.bucket = columns, limit, span, ttl, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", "rows string")
        self.parts = handle.getMapState("parts", "bucket bigint", "number bigint")
        self.sent = handle.getMapState("sent", "name string", "at bigint")
        self.tokens = handle.getValueState("tokens", "times array<bigint>, swept bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # What waits in a bucket is not read again until it is decided: each frame leaves a part of its own.
        numbers = {}
        for frame in rows:
            for bucket, part in frame.groupby(frame["at"].astype("int64") // 1000 // self.bucket):
                bucket = int(bucket)
                if bucket not in numbers:
                    numbers[bucket] = int(self.parts.getValue((bucket,))[0]) if self.parts.containsKey((bucket,)) else 0
                    self.handle.registerTimer((bucket + 1) * self.bucket)
                self.waiting.updateValue((bucket, numbers[bucket]), (part[self.columns].to_json(orient="values"),))
                numbers[bucket] += 1
        for bucket, number in numbers.items():
            self.parts.updateValue((bucket,), (number,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        for bucket, number in sorted((b, n) for (b,), (n,) in self.parts.iterator() if (b + 1) * self.bucket <= now):
            rows = []
            for part in range(number):
                rows += json.loads(self.waiting.getValue((bucket, part))[0])
                self.waiting.removeKey((bucket, part))
            self.parts.removeKey((bucket,))
            self.handle.registerTimer(now + self.ttl // 1000 + self.bucket)  # by then its alerts can be forgotten
            yield self._decided(rows)
        times, swept = self.tokens.get() if self.tokens.exists() else ([], 0)
        passed = now * 1000
        if passed - swept > self.ttl:
            for name, at in [(n, a) for (n,), (a,) in self.sent.iterator()]:
                if passed - at > self.ttl:
                    self.sent.removeKey((name,))
            self.tokens.update(([t for t in times if passed - t < self.span], passed))

    def _decided(self, rows: list[list]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.columns).sort_values(["at", "seq"], kind="stable")
        times, swept = self.tokens.get() if self.tokens.exists() else ([], 0)
        times, decisions = [int(t) for t in times], []
        for at, name in zip(frame["at"].tolist(), frame["dedup_key"].tolist()):
            times = [t for t in times if at - t < self.span]
            if len(times) >= self.limit:
                decisions.append("rate_limited")
                continue
            times.append(at)
            known = (name or "",)
            if self.sent.containsKey(known) and at - int(self.sent.getValue(known)[0]) <= self.ttl:
                decisions.append("duplicate")
                continue
            self.sent.updateValue(known, (at,))
            times.append(at)
            decisions.append("sent")
        self.tokens.update((times, swept))
        return frame.assign(decision=decisions)

    def close(self) -> None:
        pass


def alert_stream(
    scored: DataFrame, user: str = "user_name", limit: int = RATE_LIMIT, span: int = RATE_SPAN, ttl: int = DEDUP_TTL,
    lateness: str = "10 minutes", bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Risky rows as alerts with their delivery decision, state keyed by tenant; decided once the watermark has passed.

    Rows without a time are left out: they have no decision (``throttle_rate`` gives them none either).
    """
    use_rocksdb(scored.sparkSession)
    ship_package(scored.sparkSession)
    risky = scored.filter((F.col("risk_score") >= 30) & F.col("at").isNotNull())
    payload = alerts.alert_payload(risky, user).select(
        "event_id", "tenant_id", "at", "seq", "severity", "risk_score", "recommended_action", "description", "dedup_key"
    )
    schema = ", ".join(f"{name} {kind}" for name, kind in payload.dtypes) + ", decision string"
    timed = payload.withColumn("_ts", F.timestamp_micros("at")).withWatermark("_ts", lateness)
    return timed.groupBy("tenant_id").transformWithStateInPandas(
        AlertThrottle(payload.columns, limit, span, ttl, bucket_ms), schema, outputMode="Append", timeMode="EventTime"
    )


def auth_stream(records: DataFrame) -> DataFrame:
    """Windows authentication records to filtered identity events, ready for the baseline store."""
    return ueba.ueba_filter(ueba.to_ueba(records))


def os_stream(records: DataFrame) -> DataFrame:
    """Operating-system telemetry, unified and routed."""
    return normalize.os_batch_route(normalize.unify_os_telemetry(records))


def metrics_stream(events: DataFrame, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Counters per tenant, source and window of a stream with ``ts`` and ``outcome``."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), "tenant_id", "source")
        .agg(
            F.count_if(F.col("outcome") == "ingested").alias("ingested"),
            F.count_if(F.col("outcome") == "failed").alias("failed"),
            F.count_if(F.col("outcome") == "dead_letter").alias("dead_lettered"),
        )
    )


def validated_stream(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) Windows telemetry of a stream."""
    return quality.dead_letter(quality.validate_telemetry(records))
