"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint is a ring of ``SEGMENTS`` bytes. If two of them differ in at most ``t`` bits, some segment
starts a chain whose every prefix of ``l`` segments differs in at most ``l * t / SEGMENTS`` bits (the
pigeonring principle). Prefixes whose budget is below one bit must be equal, so they are the join key; the
longer prefixes prune before the full Hamming distance is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.graph import components
from wardline.llm.shared import Scratch, ready_python

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Buckets of more fingerprints than this are linked by ``_cover`` instead of pair by pair; both are exact.
PAIRWISE = 64
_ROWS = 1 << 15


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words (one hash of the whole sequence when there are fewer)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], seed) for i, j in zip(starts, ends[words - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _ROWS):
        part = hashes[i : i + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> Column:
    """A column with the fingerprint of ``text`` as a signed long."""
    ready_python(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        prints = [majority(shingle_hashes(t, words)) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))

    return fingerprint(F.col(text))


def _ring(print_: str, start: int) -> Column:
    """The fingerprint turned so that segment ``start`` has its lowest bits."""
    bits, turn = F.col(print_), start * WIDTH
    if not turn:
        return bits
    return F.shiftrightunsigned(bits, turn).bitwiseOR(F.shiftleft(bits, 64 - turn))


def _low(segments: int) -> int:
    """Mask of the lowest segments, as a signed long."""
    mask = (1 << segments * WIDTH) - 1
    return mask - (1 << 64) if mask >> 63 else mask


def _within(left: Column, right: Column, differing: int) -> Column:
    """All prefixes of the chain, and with the last one all bits, keep to their budgets.

    A chain whose segment before its start is equal too can begin there as well: its sums are those of a
    shorter prefix. So chains begin where the segment before differs, and a pair is met less often.
    """
    odd = left.bitwiseXOR(right)
    keeps = (F.shiftrightunsigned(odd, 64 - WIDTH) != 0) | (odd == 0)
    for length in range(1, SEGMENTS + 1):
        keeps &= F.bit_count(odd.bitwiseAND(F.lit(_low(length)))) <= length * differing // SEGMENTS
    return keeps


def _exact_segments(differing: int) -> int:
    return max(1, max((n for n in range(SEGMENTS + 1) if n * differing // SEGMENTS == 0), default=1))


def chains(prints: DataFrame, differing: int) -> DataFrame:
    """(turn, key, ring, print) once per start of a chain; ``prints`` has distinct ``print``."""
    if not 0 <= differing < SEGMENTS:
        raise ValueError(f"chains start with an equal segment only below {SEGMENTS} differing bits")
    exact = _exact_segments(differing)
    turns = F.array(*(F.struct(F.lit(i).alias("turn"), _ring("print", i).alias("ring")) for i in range(SEGMENTS)))
    return prints.select("print", F.explode(turns).alias("c")).select(
        F.col("c.turn").alias("turn"), F.col("c.ring").bitwiseAND(F.lit(_low(exact))).alias("key"), F.col("c.ring").alias("ring"), "print"
    )


def _cover(crowded: DataFrame, differing: int) -> DataFrame:
    """Links inside crowded buckets without pairs, for two differing bits.

    Fingerprints at two or fewer differing bits share a point at one bit or less from both, and all that
    share such a point are at two or fewer from each other: each hangs on the smallest one at its points.
    A point has at most 1 + 64 fingerprints, so its window is small.
    """
    exact = _exact_segments(differing) * WIDTH
    flips = [0] + [(1 << j) - (1 << 64) * (j == 63) for j in range(exact, 64)]
    points = crowded.withColumn("point", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("ring").bitwiseXOR(f))))
    least = F.min("print").over(Window.partitionBy("turn", "point"))
    return points.select(F.col("print").alias("a"), least.alias("b")).where("a <> b").distinct()


def links(prints: DataFrame, differing: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect just what pairs within ``differing`` (0 to 2) bits connect."""
    if differing > 2:
        raise ValueError("crowded buckets are covered for at most 2 differing bits")
    rows = chains(prints, differing)
    sizes = rows.groupBy("turn", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.keep(rows.join(scratch.keep(sizes, "sizes"), ["turn", "key"]), "chains")
    few, many = shared.where(F.col("size") <= PAIRWISE), shared.where(F.col("size") > PAIRWISE)
    other = few.select("turn", "key", F.col("ring").alias("ring_b"), F.col("print").alias("b"))
    pairs = few.join(other, ["turn", "key"]).where(
        (F.col("print") < F.col("b")) & _within(F.col("ring"), F.col("ring_b"), differing)
    )
    found = pairs.select(F.col("print").alias("a"), "b")
    if differing == 2:
        return found.unionByName(_cover(many, differing))
    # One bit or none: a point of the cover may join fingerprints at two bits, so compare it on the pair.
    wide = many.select("turn", "key", F.col("ring").alias("ring_b"), F.col("print").alias("b"))
    flips = [0] + [(1 << j) - (1 << 64) * (j == 63) for j in range(64)] * (differing == 1)
    near = many.withColumn("ring_b", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("ring").bitwiseXOR(f))))
    near = near.select("turn", "ring_b", F.col("print").alias("a")).join(wide.select("turn", "ring_b", "b"), ["turn", "ring_b"])
    return found.unionByName(near.where("a <> b").select("a", "b"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, differing: int = 2) -> DataFrame:
    """(key, print, component): fingerprint of each row and the smallest key that links reach.

    One row per input row, repeated rows included; other columns are left out, so their names can't clash.
    Null and empty texts have fingerprint 0 and link like any other. Rows with a null key take part in
    linking but never name a component; a component of such rows only is null. An empty table gives an
    empty one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.col(key).alias("key"), fingerprints(docs, text, words).alias("print")), "prints")
    prints = scratch.keep(rows.groupBy("print").agg(F.min("key").alias("first")), "distinct")
    roots = components(links(prints, differing, scratch), scratch)
    rooted = scratch.keep(
        prints.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("component", "print").alias("root")), "roots"
    )
    named = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("component")), "named")
    of_print = scratch.keep(rooted.join(named, "root").select("print", "component"), "classes")
    return rows.join(of_print, "print").select(F.col("key").alias(key), "print", "component")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, differing: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of ``near_groups`` stays: that of the smallest key.

    Of rows with the same key the first stays; null keys come last. Rows without words (null texts too) have
    fingerprint zero and are linked like any other. Columns may have any names. Rows are written once with a number,
    by which groups meet their rows.
    """
    scratch = Scratch(docs.sparkSession)
    number = "row number of near copies"
    numbered = scratch.numbered(docs, number)
    groups = near_groups(numbered, number, text, words, differing).select(F.col(number).alias("row"), F.col("component").alias("group"))
    keyed = numbered.select(F.col(number).alias("row"), F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(number).alias("row")).alias("place"))
    stay = keyed.join(groups, "row").groupBy("group").agg(F.min("place").alias("first")).select(F.col("first.row").alias(number))
    # What stays grows with the documents, so it is merged with them at every size, not broadcast while it is small.
    return numbered.join(scratch.keep(stay, "stay").hint("merge"), number, "left_semi").drop(number)
