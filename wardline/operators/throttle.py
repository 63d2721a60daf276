"""Throttles, whose decisions depend on the rows accepted before.

Duplicates (``throttle_dedup``): what a key sends next is a function of what it sent last, namely the first row
after the lifetime. Rows after a quiet stretch longer than the lifetime are always sent; from them the sent rows are
followed by pointers that double their length each round, so a stretch of n sent rows takes log n rounds of joins.

Rates (``throttle_rate``, ``api_rate_limit``) carry a small state of tokens instead. Each (key, time slice) is
folded on its own, from the empty state. Then neighbours are put together, two slices, four, eight and so on: where the
left half hands over another state than the right half was folded with, the right half is folded again, up to the
slice that begins as before. So n slices take log n rounds at most, also in traffic that never pauses; there the last
round folds half of a key in one task, which is the cost of the definition.  A task reads its rows sorted, in
Arrow batches, and holds only the state; the state of a slice travels in a row of its own before the slice's rows.

A null key is a key of its own. Rows without a time have no decision, and none is made because of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.slices import KEY, OWN, SLICE, in_slice, slice_of
from wardline.session import settle, ship_package

# Duplicate time, rate window and size, in microseconds and tokens.
DEDUP_TTL = 180_000_000
RATE_SPAN, RATE_LIMIT = 60_000_000, 15
DAY = 86_400_000_000
STATE = "array<struct<name:string,at:bigint>>"

# A fold takes (entries, time, name) and returns the decision; entries is the state, a list of
# (name, time) it may change.  ``alive`` gives the age up to which an entry of a name counts.
Fold = Callable[[list, int, str], str]


def expired(entries: list, now: int, alive: Callable[[str], int]) -> list:
    return [entry for entry in entries if now - entry[1] <= alive(entry[0])]


def _entries(text: str | None) -> list | None:
    return None if text is None else [(e["name"], e["at"]) for e in json.loads(text)]


def _folded(entries: list, times: list, names: list, fold: Fold, alive: Callable[[str], int]) -> tuple[list, list[str]]:
    """The state after some rows in order, and their decisions; entries are looked through only when one has expired."""
    decisions, until = [], min((at + alive(name) for name, at in entries), default=None)
    for now, label in zip(times, names):
        if until is not None and now > until:
            entries = expired(entries, now, alive)
            until = min((at + alive(name) for name, at in entries), default=None)
        known = len(entries)
        decisions.append(fold(entries, now, label))
        for name, at in entries[known:]:
            until = at + alive(name) if until is None else min(until, at + alive(name))
    return entries, decisions


def _pieces(frame: pd.DataFrame, group: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key and slice, first, last) of the runs of one slice in a sorted batch; a row that opens a slice begins a run."""
    opens = frame["_opens"].to_numpy().copy()
    opens[:1] = True
    edges = opens.nonzero()[0]
    heads = zip(*[frame[column].iloc[edges].tolist() for column in group])
    edges = [*edges.tolist(), len(opens)]
    yield from zip(heads, edges, edges[1:])


def named_key(keys: Sequence[str]) -> Column:
    """The key columns as one text that is never null; a null column is left out of it."""
    return F.to_json(F.struct(*[F.col(key) for key in keys]))


def sliced_fold(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    name: str,
    fold: Fold,
    alive: Callable[[str], int],
    longest: int,
    width: int | None = None,
) -> DataFrame:
    """``df`` with a ``decision`` per row.  ``name`` is the entry name a row may leave in the state.

    The default slice is a day, or twenty times ``longest`` if that is more.  ``tie`` tells rows of one key and
    time apart.
    """
    ship_package(df.sparkSession)
    width = max(width or max(DAY, 20 * longest), longest)
    keyed = df.withColumn(KEY, named_key(keys))
    slim = settle(
        keyed.filter(F.col(at).isNotNull()).select(KEY, F.col(at), F.col(tie), F.col(name)).withColumn(SLICE, slice_of(at, width))
    )
    group = [KEY, SLICE]
    kinds = {column.name: column.dataType.simpleString() for column in slim.schema}
    state_schema = f"{KEY} string, {SLICE} bigint, _begin bigint, _tie {kinds[tie]}, _used {STATE}, _end {STATE}"
    mark_schema = f"{KEY} string, `{at}` {kinds[at]}, `{tie}` {kinds[tie]}, decision string"
    empty = F.array().cast(STATE)

    def state(entries: list) -> list[dict]:
        return [{"name": n, "at": t} for n, t in entries]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The states of slices; from a slice with ``_state`` on those of the same stretch are folded one after the other,
        until one begins with the state that it was folded with before."""
        names = [*group, "_begin", "_tie", "_used", "_end"]
        at_slice, stretch, folding, entries, facts = None, None, False, [], None
        for frame in batches:
            done = []
            times, labels, ties, blocks = (frame[column].tolist() for column in (at, name, tie, "_block"))
            for here, first, last in _pieces(frame, group):
                if here != at_slice:
                    if folding:
                        done.append((*at_slice, *facts, state(sorted(entries))))
                    given, used = _entries(frame["_state"].iat[first]), _entries(frame["_used"].iat[first])
                    begin, block = int(times[first]), (here[0], blocks[first])
                    if given is None and folding and block == stretch:
                        given = [entry for entry in sorted(entries) if begin - entry[1] <= longest]
                        folding = given != used
                    else:
                        folding = given is not None
                    at_slice, stretch = here, block
                    if folding:
                        entries, facts = given, (begin, ties[first], state(given))
                    first += 1
                if folding:
                    entries, _ = _folded(entries, times[first:last], labels[first:last], fold, alive)
            if done:
                yield pd.DataFrame(done, columns=names)
        if folding:
            yield pd.DataFrame([(*at_slice, *facts, state(sorted(entries)))], columns=names)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_slice, entries = None, []
        for frame in batches:
            decisions, times, labels = [], frame[at].tolist(), frame[name].tolist()
            for here, first, last in _pieces(frame, group):
                if here != at_slice:
                    at_slice, entries = here, _entries(frame["_state"].iat[first])
                    first += 1
                entries, made = _folded(entries, times[first:last], labels[first:last], fold, alive)
                decisions += made
            yield frame.loc[~frame["_opens"], [KEY, at, tie]].assign(decision=decisions)

    def in_order(rows: DataFrame, opening: DataFrame, block: Column) -> DataFrame:
        """Rows in time order, each slice opened by a row that holds its state as text, so that no other row carries one."""
        nothing = F.lit(None).cast("string")
        plain = rows.select(*group, at, tie, name, F.lit(False).alias("_opens"), nothing.alias("_used"), nothing.alias("_state"))
        opened = opening.select(
            *group, F.col("_begin").cast(kinds[at]).alias(at), F.col("_tie").alias(tie), F.lit("").alias(name),
            F.lit(True).alias("_opens"), F.to_json("_used").alias("_used"), F.to_json("_state").alias("_state"),
        )
        both = plain.unionByName(opened).withColumn("_block", block)
        return both.repartition(KEY, "_block").sortWithinPartitions(KEY, "_block", SLICE, F.desc("_opens"), at, tie)

    first = F.min(F.struct(F.col(at).cast("bigint").alias("_begin"), F.col(tie).alias("_tie")))
    opening = slim.groupBy(*group).agg(first.alias("_first")).select(*group, "_first.*")
    opening = opening.withColumns({"_used": empty, "_state": empty})
    # Every slice is folded on its own at first, from the empty state.
    states = settle(in_order(slim, opening, F.col(SLICE)).mapInPandas(ends, state_schema))
    least = states.agg(F.min(SLICE)).first()[0]
    place = F.col(SLICE) - F.lit(least or 0)
    order = Window.partitionBy(KEY).orderBy(SLICE)
    alive_at = F.filter(F.coalesce(F.lag("_end").over(order), empty), lambda e: F.col("_begin") - e["at"] <= F.lit(longest))
    # Two slices meet at the level of the highest binary digit in which their numbers differ.
    level = F.length(F.bin(place.bitwiseXOR(F.lag(place).over(order)))) - 1

    while True:
        # ``states`` is a settled table with one row per key and slice; this check is cheap.
        linked = states.withColumns({"_state": alive_at, "_level": level})
        stale = linked.filter(~F.col("_state").eqNullSafe(F.col("_used")))
        lowest = stale.agg(F.min("_level")).first()[0]
        if lowest is None:
            break
        # Stretches of 2 ** lowest slices are right in themselves; those begun with a wrong state are folded again.
        block = F.shiftright(place, lowest)
        heads = stale.filter(F.col("_level") == lowest).select(*group, "_state")
        stretches = heads.select(KEY, block.alias("_block")).distinct()
        again = states.withColumn("_block", block).join(stretches, [KEY, "_block"], "left_semi").drop("_block")
        rows = slim.join(again.select(*group), group, "left_semi")
        fresh = in_order(rows, again.join(heads, group, "left"), block).mapInPandas(ends, state_schema)
        fresh = settle(fresh)
        states = settle(states.join(fresh.select(*group), group, "left_anti").unionByName(fresh))
    starts = states.withColumn("_state", F.col("_used"))
    decided = in_order(slim, starts, F.col(SLICE)).mapInPandas(marks, mark_schema)
    return keyed.join(decided, [KEY, at, tie], "left").select(*df.columns, "decision")


def _links(moments: DataFrame, at: str, ttl: int, width: int) -> DataFrame:
    """(key, at, head, to) of each moment of a key: whether it follows a quiet stretch, and the moment that is
    sent next if this one is; ``to`` is null where a quiet stretch comes before that.

    A moment stands in its slice and, near an edge, in the neighbour; the end of its lifetime stands only in the slice
    that holds it. Sorted backwards, the least moment so far is the first one after such an end.
    """
    home = slice_of("_t", width)
    start = home * F.lit(width)
    near = F.array_compact(
        F.array(home, F.when(F.col("_t") - start <= ttl, home - 1), F.when(start + width - F.col("_t") <= ttl, home + 1))
    )
    moment = moments.select(KEY, F.col(at).alias("_t"), F.lit(1).alias("_kind"))
    spread = moment.withColumn(SLICE, F.explode(near)).withColumn(OWN, F.col(SLICE) == home)
    before = F.max("_t").over(in_slice([KEY], "_t").rowsBetween(Window.unboundedPreceding, -1))
    marked = spread.withColumn("_head", before.isNull() | (F.col("_t") - before > ttl))
    ends = moments.select(KEY, (F.col(at) + ttl).alias("_t"), F.lit(0).alias("_kind")).withColumns(
        {SLICE: slice_of("_t", width), OWN: F.lit(True), "_head": F.lit(False)}
    )
    whole = marked.unionByName(ends.select(*marked.columns))
    later = F.when(F.col("_kind") == 1, F.struct("_t", "_head"))
    following = F.min(later).over(in_slice([KEY], F.desc("_t"), "_kind").rowsBetween(Window.unboundedPreceding, 0))
    linked = whole.withColumn("_next", following)
    heads = linked.filter((F.col("_kind") == 1) & F.col(OWN) & F.col("_head")).select(KEY, F.col("_t").alias(at), F.lit(True).alias("head"))
    reached = (F.col("_next._t") - F.col("_t") <= ttl) & ~F.col("_next._head")
    hops = linked.filter((F.col("_kind") == 0) & reached).select(
        KEY, (F.col("_t") - ttl).alias(at), F.lit(False).alias("head"), F.col("_next._t").alias("to")
    )
    return heads.withColumn("to", F.lit(None).cast("bigint")).unionByName(hops)


def throttle_dedup(
    alerts: DataFrame, keys: Sequence[str], at: str = "at", tie: str = "seq", ttl: int = DEDUP_TTL, width: int | None = None
) -> DataFrame:
    """``decision`` is sent, or duplicate up to ``ttl`` after the last sent row of the key.

    Of rows at one time the first by ``tie`` is sent.  Keys are cut into slices of ``width`` to find where each
    sent row leads; then rounds of joins follow the pointers, twice as far in each.
    """
    width = max(width or 20 * ttl, 2 * ttl, 1)
    keyed = alerts.withColumn(KEY, named_key(keys))
    moments = settle(keyed.filter(F.col(at).isNotNull()).groupBy(KEY, at).agg(F.min(tie).alias("_first")))
    links = settle(_links(moments, at, ttl, width))
    sent = links.filter("head").select(KEY, at)
    hops = links.filter("NOT head").select(KEY, at, "to")
    while not hops.isEmpty():
        # ``sent`` holds the first moments of each stretch, as many as a hop is long; a hop leads to as many more.
        led = sent.join(hops, [KEY, at]).select(KEY, F.col("to").alias(at))
        sent = settle(sent.unionByName(led))
        further = hops.select(KEY, F.col(at).alias("to"), F.col("to").alias("_far"))
        hops = settle(hops.join(further, [KEY, "to"]).select(KEY, at, F.col("_far").alias("to")))
    first = moments.join(sent, [KEY, at]).select(KEY, at, "_first", F.lit(True).alias("_sent"))
    joined = keyed.join(first, [KEY, at], "left")
    is_first = F.col("_sent") & F.col(tie).eqNullSafe(F.col("_first"))
    decision = F.when(F.col(at).isNotNull(), F.when(is_first, "sent").otherwise("duplicate"))
    return joined.withColumn("decision", decision).select(*alerts.columns, "decision")


def spaced_out(df: DataFrame, keys: Sequence[str], at: str, spacing: int, width: int | None = None) -> DataFrame:
    """The rows left when each kept row silences its key for less than ``spacing``."""
    numbered_rows = df.withColumn("_tie", F.lit(0))
    kept = throttle_dedup(numbered_rows, keys, at, "_tie", spacing - 1, width)
    return kept.filter("decision = 'sent'").drop("_tie", "decision")


def api_rate_limit(
    calls: DataFrame, limit: int, key: str = "tenant_id", at: str = "at", tie: str = "seq",
    span: int = RATE_SPAN, width: int | None = None,
) -> DataFrame:
    """``decision`` is admitted while fewer than ``limit`` calls were admitted in the last ``span``."""

    def fold(entries, now, label):
        if len(entries) >= limit:
            return "rejected"
        entries.append(("", now))
        return "admitted"

    named = calls.withColumn("_name", F.lit(""))
    return sliced_fold(named, [key], at, tie, "_name", fold, lambda _: span, span, width).drop("_name")


def rate_fold(limit: int) -> Fold:
    """The delivery decision: entries with an empty name are tokens, others mark sent alert keys."""

    def fold(entries, now, label):
        if sum(1 for name, _ in entries if name == "") >= limit:
            return "rate_limited"
        entries.append(("", now))
        if any(name == label for name, _ in entries):
            return "duplicate"
        entries.append((label, now))
        entries.append(("", now))
        return "sent"

    return fold


def throttle_rate(
    alerts: DataFrame,
    dedup_key: str = "dedup_key",
    tenant: str = "tenant_id",
    at: str = "at",
    tie: str = "seq",
    limit: int = RATE_LIMIT,
    span: int = RATE_SPAN,
    ttl: int = DEDUP_TTL,
    width: int | None = None,
) -> DataFrame:
    """``decision`` is rate_limited, duplicate or sent, checked in that order.

    An alert that passes the tenant's rate check costs one token, a sent one another; tokens
    last less than ``span``, duplicates are held back up to ``ttl`` after the last sent alert
    of the same key.
    """

    # Token names are empty; alert keys get a prefix so that none is.
    named = alerts.withColumn("_name", F.concat(F.lit("k"), F.coalesce(F.col(dedup_key), F.lit(""))))
    alive = lambda name: ttl if name else span - 1
    return sliced_fold(named, [tenant], at, tie, "_name", rate_fold(limit), alive, max(ttl, span), width).drop("_name")
