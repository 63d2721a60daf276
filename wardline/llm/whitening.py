"""Whitening of embeddings by the covariance of distinct vectors, each weighted by how often it comes.

Vectors are put on a grid of whole numbers. Equal ones are grouped by an aggregate, with their number; sums, the
centred covariance (one matrix product per batch of distinct vectors) and the projections are then taken once per
distinct vector, and every row gets those of its vector back by the digest of its whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.shared import Scratch, ready_python

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: An eigenvalue below this share of the largest is the rounding of a direction without spread.
FLAT = 1e-12
_MOST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def gridded(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * entry) + offset of each entry, as longs; what is beyond a long stays at its end."""
    return F.transform(vector, lambda e: F.least(F.floor(e.cast("double") * scale), F.lit(_MOST - offset)) + offset)


def _digest(grid: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", grid.cast("array<string>")), 256))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _fits(values: np.ndarray, factor: int) -> bool:
    """Whether ``factor`` times any of the values stays well within a long."""
    return max(abs(int(values.max())), abs(int(values.min()))) * factor < 1 << 62


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(place, total): exact weighted sums of one task, a row per dimension."""
    totals = [0] * size
    for batch in batches:
        if not batch.num_rows:
            continue
        x, weight = _matrix(batch), batch.column("weight").to_numpy(zero_copy_only=False)
        if not _fits(x, int(weight.sum())):
            x, weight = x.astype(object), weight.astype(object)
        totals = [a + int(b) for a, b in zip(totals, (x * weight[:, None]).sum(axis=0))]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], ["place", "total"]
    )


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(place, row): the weighted product of the centred vectors of one task, a row per dimension."""
    total = np.zeros((len(mean), len(mean)))
    for batch in batches:
        centred = _matrix(batch).astype(np.float64) - mean
        weight = batch.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)
        total += (centred * weight[:, None]).T @ centred
    yield pa.RecordBatch.from_arrays([pa.array(range(len(mean)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["place", "row"])


def _projected(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(digest, copies, weight, deviation, whitened) of each distinct vector."""
    exact = np.array(sums, dtype=object)
    for batch in batches:
        x = _matrix(batch)
        # n * x - S, by whole numbers of machine size where those hold them and their squares' sum.
        most = max((abs(n * int(v) - s) for v, s in zip([*x.max(axis=0), *x.min(axis=0)], [*sums, *sums])), default=0) if batch.num_rows else 0
        if most * most * len(sums) <= _MOST and batch.num_rows and _fits(x, n):
            gap = x * n - exact.astype(np.int64)
            deviation = pa.array((gap * gap).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        else:
            gap = x.astype(object) * n - exact
            found = [int(v) for v in (gap * gap).sum(axis=1)] if batch.num_rows else []
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in found], pa.decimal128(38, 0))
        whitened = (x.astype(np.float64) - mean) @ axes
        rows = [[v if ok else None for v, ok in zip(row, np.isfinite(row))] for row in whitened.tolist()]
        columns = [batch.column("digest"), batch.column("copies"), batch.column("weight"), deviation, pa.array(rows, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["digest", "copies", "weight", "deviation", "whitened"])


@dataclass
class Whitening:
    """A fit: its size, sums and components, and the rows.

    ``rows`` has (key, copies, deviation, whitened): how often the row's vector comes, sum of (n*x-S)^2 as
    decimal(38,0), and an entry per component.
    """

    n: int
    sums: list[int]
    eigenvalues: list[float]
    explained: list[float | None]
    identity_error: float | None
    rows: DataFrame


def _covariance_error(whitened: DataFrame, n: int, used: list[int]) -> float | None:
    """Largest entry by which the covariance of the used components differs from the identity."""
    if not used:
        return None
    of = {i: F.element_at("whitened", i + 1) for i in used}
    means = whitened.agg(*(F.sum(F.col("weight") * of[i]).alias(f"m{i}") for i in used)).first()
    centred = {i: of[i] - means[f"m{i}"] / n for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = whitened.agg(*(F.sum(F.col("weight") * centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, offset: int = OFFSET, weighted: bool = True,
) -> Whitening:
    """Fit on all usable vectors and whiten each of them.

    Rows whose vector is null, empty or has a null or non-finite entry are left out. Vectors have one length: the
    most frequent among the usable ones, of equally frequent ones the longest; others are left out. Repeated rows
    and rows with a null key count and stay. ``weighted`` weighs a distinct vector by its number of rows, else each
    counts once. Components are unit eigenvectors by falling eigenvalue, turned so that the entry of largest size
    is positive; at most as many as dimensions. Directions without spread (one vector only, or all alike there)
    have null in ``whitened``, and the identity error leaves them out. Without usable vectors n is 0 and there are
    no rows. Entries beyond a long's range stay at its end; a deviation of 39 digits or more is null. Other
    columns are left out.

    To the driver come a sum per dimension and the covariance, whose size is that of a vector squared. Shuffled
    are distinct vectors after a map-side count, then a digest per row; a vector that a third of all rows have is
    one row of the first, and skewed only in the last join, which adaptive execution splits.
    """
    spark = vectors.sparkSession
    ready_python(spark)
    scratch = Scratch(spark)
    kept = vectors.where(usable(F.col(vector))).select(F.col(key).alias("key"), gridded(F.col(vector), scale, offset).alias("x"))
    distinct = kept.groupBy("x").agg(F.count("*").alias("copies"))
    weight = F.col("copies") if weighted else F.lit(1).cast("long")
    distinct = scratch.keep(distinct.select(_digest(F.col("x")).alias("digest"), "x", "copies", weight.alias("weight")), "distinct")
    lengths = distinct.groupBy(F.size("x").alias("size")).agg(F.sum("copies").alias("rows"), F.sum("weight").alias("weight"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("size")).first()
    size, n = (usual["size"], int(usual["weight"])) if usual else (0, 0)
    distinct = distinct.where(F.size("x") == size)
    sums, mean, eigenvalues, trace, axes = [], np.zeros(size), [], 0.0, np.zeros((size, 0))
    used: list[int] = []
    if n:
        partial = distinct.select("x", "weight").mapInArrow(lambda b: _sums(b, size), "place int, total decimal(38,0)")
        sums = [int(r["total"]) for r in partial.groupBy("place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("place").collect()]
        # Whole part and rest apart: the quotient of two large whole numbers, rounded once.
        mean = np.array([s // n + (s % n) / n for s in sums])
        partial = distinct.select("x", "weight").mapInArrow(lambda b: _products(b, mean), "place int, row array<double>")
        entries = partial.select("place", F.posexplode("row").alias("other", "value")).groupBy("place", "other").agg(F.sum("value").alias("value"))
        covariance = np.zeros((size, size))
        for r in entries.collect():
            covariance[r["place"], r["other"]] = r["value"] / n
        values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[: min(components, size)]
        eigenvalues, trace = [max(float(v), 0.0) for v in values[order]], float(np.trace(covariance))
        used = [i for i, v in enumerate(eigenvalues) if v > FLAT * eigenvalues[0]]
        axes = columns[:, order]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        axes = axes / np.array([math.sqrt(v) if i in used else math.nan for i, v in enumerate(eigenvalues)])
    whitened = distinct.select("digest", "x", "copies", "weight").mapInArrow(
        lambda b: _projected(b, n, sums, mean, axes),
        "digest binary, copies long, weight long, deviation decimal(38,0), whitened array<double>",
    )
    whitened = scratch.keep(whitened, "whitened")
    rows = kept.where(F.size("x") == size).select("key", _digest(F.col("x")).alias("digest"))
    joined = rows.join(whitened.drop("weight"), "digest").select(F.col("key").alias(key), "copies", "deviation", "whitened")
    explained = [v / trace if trace > 0 else None for v in eigenvalues]
    return Whitening(n, sums, eigenvalues, explained, _covariance_error(whitened, n, used), joined)
