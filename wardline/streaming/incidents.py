"""Incidents of a stream as versions: opened, updated, closed; kept by id in a table of versions.

What makes an incident one (attack, user, source, device) is its key. An event opens an incident or extends the
one within the gap; a late one, within the watermark, may join two incidents, of which the later is then merged into
the earlier. A timer closes an incident once the watermark is a gap past its last event, and lists its members.

There are many keys with few events each, and each call to the state store takes longer than an event does. So keys are
dealt to buckets, and a bucket's open incidents are read and written together.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from math import isnan

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.functions import risk
from wardline.functions.casts import seconds_to_micros
from wardline.operators.incidents import GAP_SECONDS, described, risky_events
from wardline.session import ship_package
from wardline.streaming.io import use_rocksdb

#: What the state keeps of an incident; start_at is its key there.
_FACTS = (
    "incident_attack string, user string, source string, end_at bigint, _rank int, _peak double, event_count bigint, "
    "event_types array<string>, triggers array<string>, version bigint"
)
_NAMES = [part.split()[0] for part in _FACTS.split(", ")]
VERSION_SCHEMA = f"incident_key string, start_at bigint, {_FACTS}, status string, event_id string"
_VERSION = Row("incident_key", "start_at", *_NAMES, "status", "event_id")
#: Rows of one key and micro-batch that are put in order together.
ROWS_IN_ORDER = 10_000
#: Buckets that keys are dealt to by hash. A query must go on with the number it was begun with.
BUCKETS = 4096
#: Members of a bucket that are stored as one text.
MEMBERS_TOGETHER = 10_000


class IncidentState(StatefulProcessor):
    """The open incidents of one key."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start_at bigint", "facts string")
        self.members = handle.getMapState("members", "event_id string", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.begin()
        while part := [row.asDict() for row in islice(rows, ROWS_IN_ORDER)]:
            self.take(part)
        yield from self.end(key[0])

    def begin(self) -> None:
        self.held = {int(s): json.loads(f) for (s,), (f,) in self.open.iterator()}
        self.before, self.changed = set(self.held), set()

    def take(self, part: list[dict]) -> None:
        for row in sorted(part, key=lambda r: (r["at"], r["event_id"] is None, r["event_id"] or "")):
            self.changed.add(self._taken(self.held, row))

    def end(self, key: str) -> list[Row]:
        """Store what has changed since ``begin``; its versions."""
        held, changed = self.held, self.changed
        gone = self.before - set(held)
        for start in gone:
            self.open.removeKey((start,))
        for start in changed & set(held):
            held[start]["version"] += 1
            self.open.updateValue((start,), (json.dumps(held[start]),))
            self.handle.registerTimer(self._deadline(held[start]))
        out = [self._version(key, start, held[start], "open") for start in sorted(changed & set(held))]
        return out + [self._version(key, start, None, "merged") for start in sorted(gone)]

    def _taken(self, held: dict[int, dict], row: dict) -> int:
        """Put an event where it belongs; the start of its incident."""
        at = int(row["at"])
        near = [s for s, f in held.items() if s - self.gap <= at <= f["end_at"] + self.gap]
        facts = {
            "incident_attack": row["incident_attack"], "user": row["user"], "source": row["source"], "end_at": at, "_rank": int(row["rank"]),
            "_peak": None if row["peak"] is None or isnan(row["peak"]) else float(row["peak"]), "event_count": 0, "event_types": [], "triggers": [], "version": 0,
        }
        facts["event_types"] = [row["event_type"]] if row["event_type"] is not None else []
        facts["triggers"] = sorted({t for t in row["triggers"] if t is not None}) if row["triggers"] is not None else []
        # An id counts once, wherever it comes again within an incident that is still open.
        # Where no incident is open there are no members to look through.
        if row["event_id"] is not None and not (held and self.members.containsKey((row["event_id"],))):
            self.members.updateValue((row["event_id"],), (at,))
            facts["event_count"] = 1
        start = at
        for other in near:
            found = held.pop(other)
            start = min(start, other)
            peaks = [p for p in (found["_peak"], facts["_peak"]) if p is not None]
            facts |= {
                "end_at": max(found["end_at"], facts["end_at"]), "_rank": max(found["_rank"], facts["_rank"]), "_peak": max(peaks, default=None),
                "event_count": found["event_count"] + facts["event_count"], "version": max(found["version"], facts["version"]),
                "event_types": sorted({*found["event_types"], *facts["event_types"]}), "triggers": sorted({*found["triggers"], *facts["triggers"]}),
            }
        held[start] = facts
        return start

    def _deadline(self, facts: dict) -> int:
        return (facts["end_at"] + self.gap) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        for start, facts in [(int(s), json.loads(f)) for (s,), (f,) in self.open.iterator()]:
            if self._deadline(facts) > now:
                continue  # extended since; it has a later timer
            self.open.removeKey((start,))
            facts["version"] += 1
            ids = [e for (e,), (at,) in self.members.iterator() if start <= at <= facts["end_at"]]
            out = [self._version(key[0], start, facts, "closed")]
            out += [self._version(key[0], start, facts, "member", e) for e in ids]
            for e in ids:
                self.members.removeKey((e,))
            yield from out

    def _version(self, key: str, start: int, facts: dict | None, status: str, event_id: str | None = None) -> Row:
        empty = {name: None for name in _NAMES} | {"end_at": start, "_rank": 0, "event_count": 0, "version": 1 << 62}
        return _VERSION(key, start, *((facts or empty)[name] for name in _NAMES), status, event_id)

    def close(self) -> None:
        pass


class _Kept(dict):
    """The calls of a map state on entries in memory; ``log`` takes what is put in."""

    def __init__(self, log: Callable[[tuple, tuple], None] | None = None) -> None:
        super().__init__()
        self.log = log

    def containsKey(self, key: tuple) -> bool:
        return key in self

    def updateValue(self, key: tuple, value: tuple) -> None:
        self[key] = value
        if self.log:
            self.log(key, value)

    def removeKey(self, key: tuple) -> None:
        self.pop(key, None)

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter(list(self.items()))


class _Now:
    """A timer that has expired at the watermark."""

    def __init__(self, at: int) -> None:
        self.at = at

    def getExpiryTimeInMs(self) -> int:
        return self.at


class IncidentBuckets(StatefulProcessor):
    """The open incidents of many keys; each key is an ``IncidentState`` on what the bucket keeps for it.

    The facts of open incidents are one value, written once a micro-batch. Members are appended, and written anew only
    when incidents are closed. One timer a bucket stands at its earliest deadline.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer bigint, facts string")
        self.members = handle.getListState("members", "rows string")

    def _state(self, key: str) -> IncidentState:
        """The state of a key that has none so far; its new members are noted in ``fresh``, its deadlines in ``deadlines``."""
        state = IncidentState(self.gap)
        state.handle, state.open = self, _Kept()
        state.members = _Kept(lambda event, at: self.fresh.append((key, event[0], at[0])))
        return state

    def registerTimer(self, at: int) -> None:
        self.deadlines.append(at)

    def _read(self) -> dict[str, IncidentState]:
        self.fresh: list[tuple[str, str, int]] = []
        self.deadlines: list[int] = []
        self.timer, states = None, {}
        stored = self.open.get()
        if stored is not None:
            self.timer = stored[0]
            for key, facts in json.loads(stored[1]).items():
                state = states[key] = self._state(key)
                state.open.update({(int(start),): (text,) for start, text in facts.items()})
            for (rows,) in self.members.get():
                for key, event_id, at in json.loads(rows):
                    states[key].members[(event_id,)] = (at,)
        return states

    def _write(self, states: dict[str, IncidentState]) -> None:
        facts = {key: {start: text for (start,), (text,) in state.open.items()} for key, state in states.items() if state.open}
        if not facts:
            self.open.clear()
            return
        earliest = min(self.deadlines, default=self.timer)
        if self.timer is None or earliest < self.timer:
            self.timer = earliest
            self.handle.registerTimer(earliest)
        self.open.update((self.timer, json.dumps(facts)))

    @staticmethod
    def _texts(members: list[tuple[str, str, int]]) -> list[tuple[str]]:
        return [(json.dumps(members[i : i + MEMBERS_TOGETHER]),) for i in range(0, len(members), MEMBERS_TOGETHER)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        states, waiting = self._read(), {}
        for row in rows:
            row = row.asDict()
            name = row["incident_key"]
            if name not in waiting:
                waiting[name] = []
                states[name] = states.get(name) or self._state(name)
                states[name].begin()
            waiting[name].append(row)
            if len(waiting[name]) == ROWS_IN_ORDER:
                states[name].take(waiting[name])
                waiting[name] = []
        for name, part in waiting.items():
            states[name].take(part)
            yield from states[name].end(name)
        if texts := self._texts(self.fresh):
            self.members.appendList(texts)
        self._write(states)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        states = self._read()
        now = _Now(max(int(timerValues.getCurrentWatermarkInMs()), int(expiredTimerInfo.getExpiryTimeInMs())))
        before = sum(len(state.open) for state in states.values())
        for name, state in states.items():
            yield from state.handleExpiredTimer((name,), timerValues, now)
            self.deadlines += [state._deadline(json.loads(text)) for (text,) in state.open.values()]
        if before > sum(len(state.open) for state in states.values()):
            left = self._texts([(name, e, at) for name, state in states.items() for (e,), (at,) in state.members.items()])
            if left:
                self.members.put(left)
            else:
                self.members.clear()
        if states:
            self.timer = None
            self._write(states)

    def close(self) -> None:
        pass


def incident_versions(
    scored: DataFrame, gap: float = GAP_SECONDS, lateness: str = "10 minutes", user: str = "user_name"
) -> DataFrame:
    """A stream of scored events (with ``ts``, ``at``, ``event_id``) as versions and members of incidents.

    ``status`` is open, closed, merged (into an earlier incident) or member; a member row names an event of a
    closed incident. All other columns are those of ``incident_rollup``. Events without a time are in no incident.
    """
    use_rocksdb(scored.sparkSession)
    ship_package(scored.sparkSession)
    risky = risky_events(scored, user).filter(F.col("at").isNotNull())
    triggers = F.col("triggers") if "triggers" in scored.columns else F.array().cast("array<string>")
    slim = risky.select(
        "ts", "at", "incident_key", "incident_attack", F.col(user).alias("user"), "source", "event_type", "event_id",
        F.col("risk_score").cast("double").alias("peak"), risk.severity_rank("severity").cast("int").alias("rank"), triggers.alias("triggers"),
    )
    dealt = slim.withColumn("_bucket", F.pmod(F.xxhash64("incident_key"), F.lit(BUCKETS)))
    versions = dealt.withWatermark("ts", lateness).groupBy("_bucket").transformWithState(
        IncidentBuckets(seconds_to_micros(gap)), VERSION_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    return described(versions.withColumn("session_start", F.col("start_at")), F.col("status"), "version", "event_id")


def keep_versions(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores a batch's versions; a repeated batch overwrites only itself."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return handle


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def current_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of each incident; those merged into another are gone."""
    versions = _stored(spark, folder).filter("status <> 'member'").drop("event_id", "batch")
    rest = [name for name in versions.columns if name != "incident_id"]
    newest = versions.groupBy("incident_id").agg(F.max_by(F.struct(*rest), F.struct("version", "status")).alias("_row"))
    return newest.select("incident_id", "_row.*").filter("status <> 'merged'")


def closed_members(spark: SparkSession, folder: str) -> DataFrame:
    """(incident_id, event_id) of the closed incidents."""
    return _stored(spark, folder).filter("status = 'member' AND event_id <> ''").select("incident_id", "event_id")


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Write the newest versions and all members to ``target`` as one batch, to go on from there."""
    stored = _stored(spark, folder)
    of_id = Window.partitionBy("incident_id").orderBy(F.desc("version"), F.desc("status"))
    newest = stored.filter("status <> 'member'").withColumn("_nth", F.row_number().over(of_id)).filter("_nth = 1").drop("_nth")
    members = stored.filter("status = 'member'")
    newest.unionByName(members).drop("batch").write.mode("overwrite").parquet(f"{target}/batch=0")
