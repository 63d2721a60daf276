"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task.  Here a key
is cut into slices of its order column (time, or row number), each (key, slice) is
its own task, and what crosses a slice edge travels in one of three exact ways:

``halo``      copies the rows of the look-back span into the following slice;
``running``   adds the total of all earlier slices (one row per key and slice) to
              the running value inside the slice;
``newest``    uses the per-slice counts to leave out whole slices before rows are
              ranked inside the slices that stay.

Rows without a time form a slice of their own: they are kept, counts of a look-back are null
for them, and they are the oldest rows of their key. A null key is a key of its own everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import settle

SLICE = "_slice"
OWN = "_own"
KEY = "_key"
#: The slice of rows without a time; it comes before all others.
TIMELESS = -(1 << 62)
HOUR = 3_600_000_000
_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def slice_of(at: str, width: int) -> Column:
    """Index of the slice of ``width`` that holds ``at``, by whole-number division; TIMELESS without a time."""
    return F.coalesce(F.expr(f"(`{at}` - pmod(`{at}`, {width}L)) div {width}L"), F.lit(TIMELESS))


def key_of(keys: Sequence[str]) -> Column:
    """The key columns as one value that is never null, so that joins on it match null keys too."""
    return F.struct(*[F.col(key) for key in keys]) if keys else F.struct(F.lit(0))


def halo(df: DataFrame, at: str, back: int, width: int | None = None) -> DataFrame:
    """Each row in its slice, and again in the next one when within ``back`` of its edge.

    Adds the slice and a flag that is true on the row's own copy.  Every look-back of up
    to ``back`` then sees all its rows inside (key, slice).  About back/width rows are
    copied; the default width keeps that at an eighth.  Rows whose ``at`` is null are own
    rows of the slice TIMELESS.
    """
    width = max(width or 8 * back, back, 1)
    home = slice_of(at, width)
    edge = (home + 1) * F.lit(width) - F.lit(back)
    copies = F.when(F.col(at) >= edge, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn(SLICE, F.explode(copies))
    return spread.withColumn(OWN, F.col(SLICE).eqNullSafe(slice_of(at, width)))


def halo_numbers(wide: DataFrame, df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str], name: str, width: int) -> DataFrame:
    """1-based row numbers per key on the own rows of a ``halo`` frame of ``df``; its keys are not null.

    The frame is already spread by (key, slice), so only the small table of slice counts moves.
    """
    counts = df.groupBy(*keys, slice_of(at, width).alias(SLICE)).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    so_far = in_slice(keys, at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    counted = wide.withColumn("_here", F.sum(F.col(OWN).cast("bigint")).over(so_far))
    joined = counted.join(carried, [*keys, SLICE])
    return joined.withColumn(name, F.col("_from") + F.col("_here")).drop("_from", "_here")


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(OWN, SLICE)


def in_slice(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def count_back(keys: Sequence[str], at: str, ties: Sequence[str], span: int, test: Column | None = None) -> Column:
    """Rows of the key at or before this one, in (at, ties) order, with at >= now - span.

    To be used on a ``halo`` frame.  Rows so far minus rows that are too old, so rows with
    an equal time that come later in the order are not counted.
    """
    unit = F.lit(1) if test is None else F.when(test, 1)
    so_far = F.count(unit).over(in_slice(keys, at, *ties).rowsBetween(Window.unboundedPreceding, 0))
    too_old = F.count(unit).over(
        in_slice(keys, at).rangeBetween(Window.unboundedPreceding, -span - 1)
    )
    return F.when(F.col(at).isNotNull(), so_far - too_old)


def _with_room(rows: DataFrame, room: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the slices that have room, with ``_n`` and ``_room``; null keys and slices match themselves."""
    names = [*keys, SLICE]
    other = room.select(*[F.col(name).alias(f"_of_{name}") for name in names], "_n", "_room")
    same = F.lit(True)
    for name in names:
        same = same & rows[name].eqNullSafe(other[f"_of_{name}"])
    return rows.join(other, same).drop(*[f"_of_{name}" for name in names])


def running(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    ties: Sequence[str],
    measures: Mapping[str, tuple[str, Column]],
    width: int = HOUR,
) -> DataFrame:
    """Adds running values per key in (at, ties) order, the row itself included.

    ``measures`` maps an output name to ("sum" | "max" | "min", column).
    """
    inputs = {name: f"_in_{name}" for name in measures}
    sliced = df.withColumns({KEY: key_of(keys), SLICE: slice_of(at, width)}).withColumns(
        {inputs[name]: column for name, (_, column) in measures.items()}
    )
    totals = sliced.groupBy(KEY, SLICE).agg(
        *[_FOLDS[fold](inputs[name]).alias(f"_all_{name}") for name, (fold, _) in measures.items()]
    )
    earlier = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        KEY,
        SLICE,
        *[
            _FOLDS[fold](f"_all_{name}").over(earlier).alias(f"_from_{name}")
            for name, (fold, _) in measures.items()
        ],
    )
    inside = in_slice([KEY], at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    here = sliced.withColumns(
        {f"_here_{name}": _FOLDS[fold](inputs[name]).over(inside) for name, (fold, _) in measures.items()}
    )
    joined = here.join(carried, [KEY, SLICE], "left")
    result = {}
    for name, (fold, _) in measures.items():
        before, now = F.col(f"_from_{name}"), F.col(f"_here_{name}")
        if fold == "sum":
            result[name] = F.when(before.isNull(), now).otherwise(before + F.coalesce(now, F.lit(0)))
        else:
            result[name] = (F.greatest if fold == "max" else F.least)(before, now)
    scratch = [f"{mark}{name}" for name in measures for mark in ("_in_", "_from_", "_here_")]
    return joined.withColumns(result).drop(KEY, SLICE, *scratch)


def numbered(
    df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str], name: str = "row_no", width: int = HOUR
) -> DataFrame:
    """1-based row number per key without sorting a whole key in one task."""
    return running(df, keys, at, ties, {name: ("sum", F.lit(1).cast("bigint"))}, width)


def newest(
    df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str], limit: int, width: int = HOUR
) -> DataFrame:
    """The last ``limit`` rows of each key in (at, ties) order; without keys, of all rows."""
    if not keys:
        return df.orderBy(F.desc(at), *[F.desc(t) for t in ties]).limit(limit)
    sliced = df.withColumn(SLICE, slice_of(at, width))
    later = Window.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    room = (
        counts.withColumn("_room", F.lit(limit) - F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .filter("_room > 0")
    )
    rank = F.row_number().over(in_slice(keys, F.desc(at), *[F.desc(t) for t in ties]))
    ranked = _with_room(sliced, room, keys).withColumn("_rank", rank).filter("_rank <= _room")
    return ranked.drop(SLICE, "_n", "_room", "_rank")


#: Rows that are ranked in one task to find the last ones that ``lowest`` takes.
CELL_ROWS = 1_000_000
MANY_KEYS = 100_000


def _small(per_key: DataFrame) -> DataFrame:
    """A settled table with a row per key, to be broadcast if there are at most MANY_KEYS of them."""
    return F.broadcast(per_key) if per_key.count() <= MANY_KEYS else per_key


def _edges(df: DataFrame, rank_hex: str, digits: int, most: int) -> DataFrame:
    """(_key, _cell, _room): the cell of hashes in which each key's limit falls, and the rows it takes there.

    Cells are counted by their leading digits; where the limit falls in one of more than ``most`` rows, that cell alone
    is counted again by more digits. Keys whose rows all fit have a cell after every hash.
    """
    length = digits
    cells = df.groupBy(KEY, F.substring(rank_hex, 1, length).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.max("_limit").alias("_top"))
    settled = None
    while True:
        so_far = Window.partitionBy(KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        summed = cells.withColumn("_end", F.sum("_n").over(so_far))
        # The first cell that the limit doesn't pass; none if the key has no more rows than that.
        over = F.when(F.col("_end") > F.col("_top"), F.struct("_cell", (F.col("_top") - F.col("_end") + F.col("_n")).alias("_room"), "_n"))
        edge = summed.groupBy(KEY).agg(F.min(over).alias("_edge"))
        edge = settle(
            edge.select(
                KEY, F.coalesce("_edge._cell", F.lit("~")).alias("_cell"), F.coalesce("_edge._room", F.lit(0)).alias("_room"),
                F.coalesce("_edge._n", F.lit(0)).alias("_n"),
            )
        )
        wide = edge.filter((F.col("_n") > most) & (F.length("_cell") == length) & F.lit(length < 64))
        done = edge.join(wide.select(KEY), KEY, "left_anti").select(KEY, "_cell", "_room")
        settled = done if settled is None else settled.unionByName(done)
        if wide.isEmpty():
            return settled
        length += digits
        inside = df.select(KEY, rank_hex).join(_small(wide.select(KEY, "_cell", F.col("_room").alias("_top"))), KEY).filter(F.startswith(F.col(rank_hex), F.col("_cell")))
        cells = inside.groupBy(KEY, F.substring(rank_hex, 1, length).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.max("_top").alias("_top"))


def lowest(
    df: DataFrame, keys: Sequence[str], rank_hex: str, limit: Column, digits: int = 3, most: int = CELL_ROWS
) -> DataFrame:
    """The rows with the smallest hex rank of each key, up to the column ``limit``.

    Ranks are counted by their leading digits, and only the cell in which the limit falls is counted by more digits, until
    it has at most ``most`` rows. Rows below it are taken unsorted in one pass; those in it are ranked. A null limit takes no row.
    """
    celled = df.withColumns({KEY: key_of(keys), "_limit": F.coalesce(limit, F.lit(0))})
    edges = _edges(celled, rank_hex, digits, most)
    met = celled.join(_small(edges), KEY).drop("_limit")
    below = met.filter(F.col(rank_hex) < F.col("_cell")).drop(KEY, "_cell", "_room")
    at_edge = met.filter(F.startswith(F.col(rank_hex), F.col("_cell")) & (F.col("_room") > 0))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(rank_hex))
    return below.unionByName(at_edge.withColumn("_rank", rank).filter("_rank <= _room").drop(KEY, "_cell", "_room", "_rank"))


def sessions(
    df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str], gap: int, width: int | None = None
) -> DataFrame:
    """Adds ``session_start``: a new session opens when more than ``gap`` passed since the
    key's previous row.  (keys, session_start) names the session; rows without a time are in none."""
    keyed = df.withColumn(KEY, key_of(keys))
    before = F.lag(at).over(in_slice([KEY], at, *ties))
    opening = F.col(OWN) & (before.isNull() | (F.col(at) - before > F.lit(gap)))

    def opened(rows: DataFrame) -> DataFrame:
        return halo(rows, at, gap, width).withColumn("_opens", F.when(opening, F.col(at)))

    # The latest opening of earlier slices: one row per key and slice, from the order columns alone.
    last = opened(keyed.select(KEY, at, *ties)).groupBy(KEY, SLICE).agg(F.max("_opens").alias("_last"))
    earlier = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(KEY, SLICE, F.max("_last").over(earlier).alias("_from"))
    so_far = in_slice([KEY], at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    here = opened(keyed).withColumn("_here", F.max("_opens").over(so_far))
    joined = own_rows(here.join(carried, [KEY, SLICE], "left"))
    return joined.withColumn("session_start", F.coalesce("_here", "_from")).drop(KEY, "_opens", "_here", "_from")


def previous(
    df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str], value: str, name: str, width: int = HOUR
) -> DataFrame:
    """Adds ``value`` of the key's row just before this one, however far back it is."""
    sliced = df.withColumns({KEY: key_of(keys), SLICE: slice_of(at, width)})
    order = F.struct(at, *ties, F.col(value).alias("_value"))
    last = sliced.groupBy(KEY, SLICE).agg(F.max(order).alias("_last"))
    earlier = Window.partitionBy(KEY).orderBy(SLICE)
    carried = last.select(KEY, SLICE, F.lag("_last").over(earlier)["_value"].alias("_carried"))
    frame = in_slice([KEY], at, *ties)
    here = sliced.withColumns({"_before": F.lag(value).over(frame), "_nth": F.row_number().over(frame)})
    joined = here.join(carried, [KEY, SLICE], "left")
    found = F.when(F.col("_nth") > 1, F.col("_before")).otherwise(F.col("_carried"))
    return joined.withColumn(name, found).drop(KEY, SLICE, "_carried", "_before", "_nth")
