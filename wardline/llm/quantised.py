"""Near-duplicate embeddings by product quantisation over coarse inverted lists.

Every vector is filed under its nearest coarse centre, with its residual coded by sub-space. Each vector
then asks every list that geometry allows to hold a vector at the threshold: table look-ups give its
approximate cosine to the coded vectors, the length of what the code leaves out bounds the error, and only
pairs that may reach the threshold are compared exactly, in double precision. So no link is lost, however
the vectors lie. Centres and codes are fitted on a bounded sample; all rows are indexed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.graph import components
from wardline.llm.shared import Scratch, ready_python

#: Vectors of the lowest hash that centres and codes are fitted on.
SAMPLE = 20_000
#: Lists: the square root of the number of vectors, at most so many.
MOST_LISTS = 2000
SUBSPACES, CODES, ROUNDS = 8, 256, 8
#: Short lists are put together to blocks of at most so many vectors and long ones cut, and those that ask
#: are cut into blocks too: a task compares one block with one. Blocks change nothing in the result.
FILED_BLOCK, ASKING_BLOCK, SLICE = 8192, 8192, 256
#: Fewer vectors are still dealt to about so many blocks, of LEAST_BLOCK vectors or more.
BLOCKS, LEAST_BLOCK = 12, 64
#: Room for rounding in angles and distances.
_ROUNDING = 1e-6


@dataclass
class Index:
    """Unit centres (lists, size) and codebooks (subspaces, codes, width) over zero-padded vectors."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def unit(self, vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), self.size))
        for row, vector in zip(out, vectors):
            row[: len(vector)] = vector
        return unit(out)

    def nearest(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists, nearest first; equal ones by number."""
        return np.argsort(-(rows @ self.centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """(subspace, row, width) with zeros at the end of the last subspace."""
        count, _, width = self.books.shape
        wide = np.zeros((len(rows), count * width))
        wide[:, : rows.shape[1]] = rows
        return wide.reshape(len(rows), count, width).transpose(1, 0, 2)

    def code(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([nearest_point(p, b) for p, b in zip(self.parts(residuals), self.books)], axis=1)

    def approximate(self, codes: np.ndarray) -> np.ndarray:
        picked = [book[codes[:, i]] for i, book in enumerate(self.books)]
        return np.concatenate(picked, axis=1)[:, : self.size]


@dataclass
class Regions:
    """Lists put together to regions, by number, with the blocks of each and what can lie within reach.

    Lists within reach of a vector are bounded twice. A list's vectors are within its largest angle of its
    centre (triangle inequality), and they are nearer to its centre than to that of the vector's own list,
    so the vector's distance to the plane between both centres is at most its distance to any of them.
    """

    index: Index
    cosine: float
    angles: np.ndarray  # the largest of each list, below 0 if it is empty
    region: np.ndarray  # of each list, rising
    turns: np.ndarray  # blocks that ask and blocks that are filed, by region
    lots: np.ndarray

    @classmethod
    def of(cls, index: Index, cosine: float, filed: np.ndarray, angles: np.ndarray) -> Regions:
        """``filed`` are the vectors of each list."""
        even = max(LEAST_BLOCK, math.ceil(filed.sum() / BLOCKS))
        held, asking = min(FILED_BLOCK, even), min(ASKING_BLOCK, even)
        region, last, size = np.zeros(len(filed), int), 0, 0
        for i, n in enumerate(filed):
            if size and size + n > held:
                last, size = last + 1, 0
            region[i] = last
            size += n
        rows = np.bincount(region, filed, last + 1)
        return cls(index, cosine, angles, region, *(np.maximum(1, np.ceil(rows / b)).astype(int) for b in (asking, held)))

    def _by_region(self, lists: np.ndarray) -> np.ndarray:
        """Of a table (row, list) whether any list of a region is set."""
        return np.logical_or.reduceat(lists, np.searchsorted(self.region, np.arange(len(self.lots))), axis=1)

    @cached_property
    def apart(self) -> np.ndarray:
        """(list, list): the angles between the centres."""
        return np.arccos(np.clip(self.index.centres @ self.index.centres.T, -1, 1))

    @cached_property
    def near(self) -> np.ndarray:
        """(region, later or same region): whether some vectors of both may be linked."""
        full = self.angles >= 0
        near = self.apart - self.angles[:, None] - self.angles <= math.acos(min(1.0, self.cosine)) + _ROUNDING
        return np.triu(self._by_region(self._by_region(near & full[:, None] & full).T).T)

    def asked(self, rows: np.ndarray, home: np.ndarray) -> np.ndarray:
        """(row, region) for unit vectors of the lists ``home``: whether a list may hold a linked vector."""
        dots = rows @ self.index.centres.T
        ball = np.arccos(np.clip(dots, -1, 1)) - self.angles <= math.acos(min(1.0, self.cosine)) + _ROUNDING
        between = 2 * np.sin(self.apart[home] / 2)
        gap = dots[np.arange(len(rows)), home][:, None] - dots
        plane = gap <= (math.sqrt(max(0.0, 2 - 2 * self.cosine)) + _ROUNDING) * between + _ROUNDING
        return self._by_region(ball & plane & (self.angles >= 0)) & self.near[self.region[home]]

    @staticmethod
    def block(gids: np.ndarray, region: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The block of each vector, numbered over all regions; vectors of a region are dealt by a hash."""
        mixed = (gids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        dealt = (mixed >> np.uint64(33)).astype(np.int64) % blocks[region]
        return (np.cumsum(blocks) - blocks)[region] + dealt

    @staticmethod
    def blocks_of(regions: np.ndarray, blocks: np.ndarray) -> list[np.ndarray]:
        """For each row of a table (row, region) the blocks of the regions set."""
        owner = np.repeat(np.arange(len(blocks)), blocks)
        return [np.nonzero(row[owner])[0].astype(np.int32) for row in regions]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled first so that no square overflows or vanishes."""
    top = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    rows = rows / np.where(top == 0, 1, top)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1, length)


def nearest_point(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points * points).sum(axis=1) - 2 * rows @ points.T).argmin(axis=1)


def centred(rows: np.ndarray, n: int, unit_length: bool, seed: int = 7) -> np.ndarray:
    """k-means centres, started from rows drawn evenly; with no rows, one centre of zeros."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    points = rows[np.random.default_rng(seed).permutation(len(rows))[:n]].copy()
    for _ in range(ROUNDS):
        own = nearest_point(rows, points)
        sums = np.zeros_like(points)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=len(points))[:, None]
        points = np.where(counts > 0, sums / np.maximum(counts, 1), points)
        if unit_length:
            points = unit(points)
    return points


def fit(sample: np.ndarray, lists: int) -> Index:
    """Fit on rows of a sample (any length of row above 0)."""
    rows = unit(sample.astype(float))
    centres = centred(rows, lists, True)
    count = min(SUBSPACES, rows.shape[1])
    width = math.ceil(rows.shape[1] / count)
    index = Index(centres, np.zeros((count, 1, width)))
    residuals = rows - centres[index.nearest(rows, 1)[:, 0]] if len(rows) else rows
    books = [centred(p, CODES, False) for p in index.parts(residuals)]
    return Index(centres, np.stack(books))


def linked(asking: pd.DataFrame, filed: pd.DataFrame, index: Index, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (asking, filed) of the pairs of two blocks at ``cosine`` or more; within a region each pair once."""
    codes = np.stack(filed["codes"].to_numpy()).astype(np.int64)
    exact = index.unit(filed["vector"])
    slack = filed["left_out"].to_numpy()
    gids, lengths, regions = (filed[c].to_numpy() for c in ("gid", "length", "region"))
    # The sums of the table look-ups, as one product with the decoded vectors. It is taken in single precision, whose
    # rounding is at most size x 2^-24 of the product of both lengths, and a decoded vector's is at most 1 + what is left out.
    decoded = (index.centres[filed["home"].to_numpy()] + index.approximate(codes)).astype(np.float32)
    room = (index.size + 8) * 2.0**-23 * (2 + slack)
    enough = (cosine - 1e-9 - slack - room).astype(np.float32)
    short = exact.astype(np.float32)
    ones, others = [], []
    for start in range(0, len(asking), SLICE):
        part = asking.iloc[start : start + SLICE]
        rows = index.unit(part["vector"])
        own_gids, own_lengths, own_regions = (part[c].to_numpy() for c in ("gid", "length", "region"))
        short_rows = rows.astype(np.float32)
        a, b = divmod(np.flatnonzero(short_rows @ decoded.T >= enough), len(filed))
        may = ((own_gids[a] < gids[b]) | (own_regions[a] < regions[b])) & (own_lengths[a] == lengths[b])
        a, b = a[may], b[may]
        for at in range(0, len(a), 1 << 16):
            one, other = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            # Most of them are told apart by the vectors in single precision, too.
            close = np.einsum("ij,ij->i", short_rows[one], short[other]) >= cosine - 1e-9 - 2 * room.max()
            one, other = one[close], other[close]
            true = (rows[one] * exact[other]).sum(axis=1) >= cosine
            ones.append(one[true] + start)
            others.append(other[true])
    return np.concatenate([*ones, np.empty(0, int)]), np.concatenate([*others, np.empty(0, int)])


def least_linked(one: np.ndarray, other: np.ndarray, names: np.ndarray) -> np.ndarray:
    """By position the smallest name that the pairs reach."""
    label = names.copy()
    while len(one):
        before = label.copy()
        low = np.minimum(label[one], label[other])
        np.minimum.at(label, one, low)
        np.minimum.at(label, other, low)
        if (before == label).all():
            break
    return label


def _compared(asking: pd.DataFrame, filed: pd.DataFrame, index: Index, cosine: float) -> pd.DataFrame:
    """(gid, n, least): links that these blocks add to each vector, and the smallest vector it is linked to."""
    one, other = linked(asking, filed, index, cosine)
    if not len(one):
        return pd.DataFrame({"gid": [], "n": [], "least": []}).astype("int64")
    gids = np.concatenate([asking["gid"].to_numpy(), filed["gid"].to_numpy()])
    names, at = np.unique(gids, return_inverse=True)
    one_at, other_at = at[one], at[len(asking) + other]
    n = np.bincount(one_at, filed["n"].to_numpy()[other], len(names))
    n += np.bincount(other_at, asking["n"].to_numpy()[one], len(names))
    least = least_linked(one_at, other_at, np.arange(len(names)))
    met = np.unique(np.concatenate([one_at, other_at]))
    return pd.DataFrame({"gid": names[met], "n": n[met].astype(np.int64), "least": names[least[met]]})


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) for every row, repeated ones included.

    Linked are rows whose cosine is ``cosine`` (above 0) or more; n_links counts the other rows linked
    directly, component_id is the smallest key reached, kept tells whether that is the row's own. Vectors
    that are null, empty or zero, or have null or non-finite components, link with nothing, and vectors of
    different length don't link with each other. Equal vectors are compared once, with their number. Rows
    with a null key link but never name a component. Other columns are left out.
    """
    spark = rows.sparkSession
    ready_python(spark)
    scratch = Scratch(spark)
    valid = F.expr("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    named = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    # 0.0 and -0.0 are one value, so that equal vectors meet in one group.
    marked = named.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("valid", F.coalesce(valid, F.lit(False)))
    groups = marked.where("valid").groupBy("vector").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    groups = scratch.keep(groups.withColumn("gid", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "groups")
    count, longest = groups.agg(F.count("*"), F.max("length")).first()
    if not count:
        return named.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    sample = groups.select("vector", F.xxhash64("vector").alias("mark")).orderBy("mark", "vector").limit(SAMPLE).collect()
    padded = np.zeros((len(sample), longest))
    for row, r in zip(padded, sample):
        row[: len(r.vector)] = r.vector
    lists = min(math.ceil(math.sqrt(count)), MOST_LISTS)
    shared = spark.sparkContext.broadcast(fit(padded, lists))  # at most MOST_LISTS centres and 8 * 256 codes

    @F.pandas_udf("home int, angle double, codes array<int>, left_out double")
    def filing(vectors: pd.Series) -> pd.DataFrame:
        index = shared.value
        units = index.unit(vectors)
        home = index.nearest(units, 1)[:, 0]
        angle = np.arccos(np.clip((units * index.centres[home]).sum(axis=1), -1, 1))
        residuals = units - index.centres[home] if len(units) else units
        codes = index.code(residuals)
        left_out = np.sqrt(((residuals - index.approximate(codes)) ** 2).sum(axis=1))
        return pd.DataFrame({"home": home, "angle": angle, "codes": list(codes.astype(np.int32)), "left_out": left_out})

    filed = scratch.keep(groups.withColumn("f", filing("vector")).select("gid", "n", "length", "vector", "f.*"), "filed")
    sizes, angles = np.zeros(lists), np.full(lists, -1.0)
    for r in filed.groupBy("home").agg(F.count("*").alias("filed"), F.max("angle").alias("angle")).collect():  # a row per list
        sizes[r.home], angles[r.home] = r.filed, r.angle
    regions = spark.sparkContext.broadcast(Regions.of(shared.value, cosine, sizes, angles))

    @F.pandas_udf("region int, turn int, lots array<int>")
    def asking(gids: pd.Series, homes: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        r, home = regions.value, homes.to_numpy()
        region = r.region[home]
        lots = r.blocks_of(r.asked(r.index.unit(vectors), home), r.lots)
        return pd.DataFrame({"region": region, "turn": r.block(gids.to_numpy(), region, r.turns), "lots": lots})

    @F.pandas_udf("region int, lot int, turns array<int>")
    def holding(gids: pd.Series, homes: pd.Series) -> pd.DataFrame:
        r = regions.value
        region = r.region[homes.to_numpy()]
        turns = r.blocks_of(r.near.T[region], r.turns)
        return pd.DataFrame({"region": region, "lot": r.block(gids.to_numpy(), region, r.lots), "turns": turns})

    left = filed.withColumn("a", asking("gid", "home", "vector")).select("gid", "n", "length", "vector", "a.region", "a.turn", F.explode("a.lots").alias("lot"))
    right = scratch.again(filed).withColumn("h", holding("gid", "home"))
    right = right.select("gid", "n", "length", "vector", "home", "codes", "left_out", "h.region", "h.lot", F.explode("h.turns").alias("turn"))

    def compared(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"gid": [], "n": [], "least": []}).astype("int64")
        return _compared(asking, held, shared.value, cosine)

    by = ["turn", "lot"]
    met = left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(compared, "gid long, n long, least long")
    met = scratch.keep(met, "met")
    counts = met.groupBy("gid").agg(F.sum("n").alias("others"))
    roots = components(met.select(F.col("gid").alias("a"), F.col("least").alias("b")), scratch)
    rooted = groups.select("gid", "vector", "n", "first").join(roots, F.col("gid") == F.col("node"), "left")
    rooted = rooted.withColumn("root", F.coalesce("component", "gid")).join(counts, "gid", "left")
    rooted = scratch.keep(rooted.select("vector", "root", "first", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of_vector = scratch.keep(rooted.join(least, "root").select("vector", "n_links", "component_id"), "classes")
    linking = marked.where("valid").select("key", "vector").join(of_vector, "vector").select("key", "n_links", "component_id")
    alone = marked.where("NOT valid").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linking.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
