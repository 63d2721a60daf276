"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. For each context of 0 to ``depth`` bytes and each decision, the corpus
gives counts of zeros and ones and with them a Krichevsky-Trofimov estimate. Every tree of contexts is
weighed in by its code length (half for stopping at a node, half for going one byte deeper), which settles
how much each depth adds to a prediction; a byte's code length is that of its eight decisions.

Counts are gathered, and the tree is built bottom-up and read top-down, by aggregates and joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.shared import Scratch, ready_python

DEPTH = 4
#: Entries (of 16 bytes) of the tables that go to every worker at a time. Larger tables go part by part; each part
#: prices what falls in it, and the sums of a text are added up.
PART_ENTRIES = 4 << 20
#: Bytes of a text that are worked on at a time, and entries that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 1 << 20
GRAM, WORD = 0, 1
#: Parts are cut between keys that differ above their lowest bits, as doubles tell those apart.
RANK_BITS = 16
#: The token at the end of each text; no word has its empty spelling.
END = xxhash.xxh64_intdigest(b"")


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def words_of(data: bytes) -> Counter:
    """Words of a text in UTF-8, A-Z in lower case, by spelling."""
    return Counter(data.lower().split())


def word_keys(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes that stand for the words, the end token last, and how often each comes."""
    digest = xxhash.xxh64_intdigest
    keys = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    times = np.fromiter(words.values(), np.int64, len(words))
    return np.append(keys, np.uint64(END)), np.append(times, 1)


def grams(data: bytes, depth: int) -> Iterator[np.ndarray]:
    """For each byte the number made of the ``depth`` bytes before it (zeros before the text) and itself."""
    padded = np.frombuffer(bytes(depth) + data, np.uint8)
    for start in range(0, len(data), PIECE):
        size = min(PIECE, len(data) - start)
        key = np.zeros(size, np.int64)
        for j in range(depth + 1):
            key <<= 8
            key |= padded[start + j : start + j + size]
        yield key


class _Tally:
    """Counts by key, with the keys sorted and added up from time to time."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw: list[np.ndarray] = []
        self.waiting = self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting >= HELD:
            self.settle()

    def settle(self) -> None:
        if self.raw:
            self.parts.append(np.unique(np.concatenate(self.raw), return_counts=True))
            self.raw, self.waiting = [], 0
        if len(self.parts) > 1:
            keys = np.concatenate([k for k, _ in self.parts])
            keys, at = np.unique(keys, return_inverse=True)
            times = np.bincount(at, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)
            self.parts = [(keys, times)]
        self.size = sum(len(k) for k, _ in self.parts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.parts, self.size = [], 0
        return out


def _rows(kind: int, keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 1 << 16):
        part, n = keys[i : i + (1 << 16)], times[i : i + (1 << 16)]
        kinds = pa.array(np.full(len(part), kind, np.int32))
        yield pa.RecordBatch.from_arrays([kinds, pa.array(part), pa.array(n)], ["kind", "key", "n"])


def _gather(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Counts of one task's texts: grams of all texts (0 for those not learnt from), words of learnt ones."""
    learnt, seen, words = _Tally(), _Tally(), Counter()

    def out_grams() -> Iterator[pa.RecordBatch]:
        yield from _rows(GRAM, *learnt.take())
        keys, _ = seen.take()
        yield from _rows(GRAM, keys, np.zeros(len(keys), np.int64))

    def out_words() -> Iterator[pa.RecordBatch]:
        keys, times = word_keys(words)
        yield from _rows(WORD, _signed(keys)[:-1], times[:-1])
        words.clear()

    ends = 0
    for batch in batches:
        for text, learn in zip(batch.column("text"), batch.column("learn")):
            data = text.as_py() or b""
            for keys in grams(data, depth):
                (learnt if learn.as_py() else seen).add(keys)
            if learn.as_py():
                words.update(data.lower().split())
                ends += 1
            if learnt.size + seen.size > 2 * HELD:
                yield from out_grams()
            if len(words) > HELD // 4:
                yield from out_words()
    yield from out_grams()
    yield from out_words()
    yield from _rows(WORD, _signed(np.array([END], np.uint64)), np.array([ends]))


def gather(docs: DataFrame, learn: Column, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): how often each gram and each word comes in the texts to learn from."""
    ready_python(docs.sparkSession)
    rows = docs.select(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"), learn.alias("learn"))
    partial = rows.mapInArrow(lambda batches: _gather(batches, depth), "kind int, key long, n long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps of recurrence; good to twelve digits for x >= 0.5."""
    steps = F.lit(1.0)
    for i in range(8):
        steps = steps * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(steps)


def _estimate(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - 1.1447298858494002


def code_lengths(counted: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(key, value): log10 of the probability of the last byte of each gram after the others.

    ``counted`` has (key, n). Grams with n = 0 are priced without changing the model.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step")
    byte = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    bits = counted.select("key", "n", byte.alias("byte"), F.shiftright("key", 8).alias("context"), steps).select(
        "key", "n", "context",
        F.expr("shiftright(byte, 8 - step) + shiftleft(1, step)").alias("node"),
        F.expr("shiftright(byte, 7 - step) & 1").alias("bit"),
    )
    tree = bits.groupBy("context", "node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("ones"),
    )
    tree = tree.withColumn("weighed", _estimate(F.col("zeros"), F.col("ones"))).withColumn("stop", F.lit(1.0))
    levels = [scratch.keep(tree, f"depth{depth}")]
    for d in range(depth - 1, -1, -1):
        up = levels[-1].groupBy(F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context"), "node").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighed").alias("deeper")
        )
        up = up.withColumn("own", _estimate(F.col("zeros"), F.col("ones")))
        most = F.greatest("own", "deeper")
        total = most + F.log(F.exp(F.col("own") - most) + F.exp(F.col("deeper") - most))
        up = up.withColumn("stop", F.exp(F.col("own") - total)).withColumn("weighed", total - float(np.log(2)))
        levels.append(scratch.keep(up.select("context", "node", "zeros", "ones", "weighed", "stop"), f"depth{d}"))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    down = levels[-1].select("context", "node", (F.col("stop") * one).alias("share"), (1 - F.col("stop")).alias("rest"))
    for d, level in enumerate(reversed(levels[:-1]), 1):
        above = down.select(F.col("context").alias("above"), F.col("node").alias("at"), "share", "rest")
        shorter = F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))
        joined = level.join(above, (shorter == F.col("above")) & (F.col("node") == F.col("at")))
        down = scratch.keep(
            joined.select(
                "context", "node",
                (F.col("share") + F.col("rest") * F.col("stop") * one).alias("share"),
                (F.col("rest") * (1 - F.col("stop"))).alias("rest"),
            ),
            f"mixed{d}",
        )
    mixed = down.select("context", "node", "share")
    chance = F.when(F.col("bit") == 1, F.col("share")).otherwise(1 - F.col("share"))
    return bits.join(mixed, ["context", "node"]).groupBy("key").agg(F.sum(F.log10(chance)).alias("value"))


class _Sums:
    """Sums of the table's values over the keys of each text.

    Keys of many texts are sorted and looked up together: neighbours lie near each other in the table, equal ones
    are looked up once.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, texts: int) -> None:
        self.keys, self.values, self.sums = keys, values, np.zeros(texts)
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.size = 0

    def add(self, text: int, keys: np.ndarray) -> None:
        if len(keys):
            self.waiting.append((text, keys))
            self.size += len(keys)
        if self.size >= HELD:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([k for _, k in self.waiting])
        texts = np.repeat([t for t, _ in self.waiting], [len(k) for _, k in self.waiting])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.append(True, keys[1:] != keys[:-1])
        found = self.values[np.searchsorted(self.keys, keys[first])][np.cumsum(first) - 1]
        self.sums += np.bincount(texts[order], found, len(self.sums))
        self.waiting, self.size = [], 0

    def take(self) -> list[float]:
        self.settle()
        return self.sums.tolist()


def _priced(batches: Iterator[pa.RecordBatch], depth: int, tables: dict, unit: float, first: bool) -> Iterator[pa.RecordBatch]:
    """(row, n_bytes, n_tokens, n_known, base_score, score): what the keys of one part add to each text.

    ``tables`` has for each kind (low, high, keys, values): the part's keys are from low to below high. A word of that
    range that isn't in the table is unknown. The sizes count in the first part only.
    """
    low, high, gram_keys, gram_values = tables[GRAM]
    word_low, word_high, keys_of, counts_of = tables[WORD]
    for batch in batches:
        out, sums = [], _Sums(gram_keys, gram_values, len(batch))
        for n, text in enumerate(batch.column("text")):
            data = text.as_py() or b""
            for keys in grams(data, depth):
                sums.add(n, keys if low is None and high is None else keys[_within(keys, low, high)])
            keys, times = word_keys(words_of(data))
            keys, size = _signed(keys), int(times.sum())
            held = _within(keys, word_low, word_high)
            keys, times = keys[held], times[held]
            at = np.minimum(np.searchsorted(keys_of, keys), max(len(keys_of) - 1, 0))
            counts = np.where(keys_of[at] == keys, counts_of[at], 0) if len(keys_of) else np.zeros(len(keys), np.int64)
            base = float((times * np.log10((counts + 0.5) / unit)).sum())
            out.append((len(data) * first, size * first, int(times[counts > 0].sum()), base))
        columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(),) * 3 + (pa.float64(),))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns, pa.array(sums.take())], ["row", "n_bytes", "n_tokens", "n_known", "base_score", "score"])


def _within(keys: np.ndarray, low: int | None, high: int | None) -> np.ndarray:
    held = np.ones(len(keys), bool)
    if low is not None:
        held &= keys >= low
    if high is not None:
        held &= keys < high
    return held


def _cuts(table: DataFrame, parts: int) -> list[tuple[int | None, int | None]]:
    """Ranges of ``key`` that hold about as many rows each and together every key."""
    found = table.approxQuantile("rank", [n / parts for n in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    cuts = sorted({int(c) << RANK_BITS for c in found})
    return list(zip([None, *cuts], [*cuts, None]))


def _part(table: DataFrame, low: int | None, high: int | None, value: str) -> tuple:
    if low is not None:
        table = table.where(F.col("key") >= low)
    if high is not None:
        table = table.where(F.col("key") < high)
    whole = table.select("key", value).toArrow()
    keys, values = (c.to_numpy() for c in whole.columns)
    order = np.argsort(keys)
    return low, high, keys[order], values[order]


def score(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, part_entries: int = PART_ENTRIES,
) -> DataFrame:
    """Score every row: (key, n_bytes, n_tokens, n_known, train_tokens, base_score, score).

    ``learn`` marks the rows to learn from. ``base_score`` is the log10 probability of the words and the
    end token by their smoothed counts, ``score`` that of the text's bytes by the weighted context tree
    (0 for a null or empty text). Repeated rows are rows of their own; other columns are left out. Depth
    is 1 to 6 bytes. With nothing to learn from, every estimate is the prior's. An empty table gives none.

    The priced grams and the counted words are read part by part: the driver and the workers hold about
    ``part_entries`` of them at a time, and each part costs one more pass over the texts, in which a byte is
    looked up only in the part that its gram falls in.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6 bytes")
    spark = docs.sparkSession
    ready_python(spark)
    scratch = Scratch(spark)
    counted = scratch.keep(gather(docs, learn, text, depth), "counted")
    words = counted.where(F.col("kind") == WORD).where("n > 0")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, vocabulary = int(facts[0]), int(facts[1])
    unit = train_tokens + 0.5 * (vocabulary + 1)
    priced = scratch.keep(code_lengths(counted.where(F.col("kind") == GRAM).select("key", "n"), depth, scratch), "priced")
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text")
    rows = scratch.numbered(docs.select(F.col(key).alias("key"), data), "row")
    parts = max(1, -(-(vocabulary + priced.count()) // part_entries))
    ranked = F.shiftright("key", RANK_BITS).alias("rank")
    cuts = [_cuts(table.select(ranked), parts) for table in (priced, words)]
    sums = []
    # The two kinds may have been cut into unlike numbers of ranges; an empty range prices nothing.
    for n in range(max(map(len, cuts))):
        tables = {
            kind: _part(table, *own[n], value) if n < len(own) else (0, 0, np.empty(0, np.int64), np.empty(0))
            for kind, table, own, value in ((GRAM, priced, cuts[0], "value"), (WORD, words, cuts[1], "n"))
        }
        shared = spark.sparkContext.broadcast(tables)
        found = rows.select("row", "text").mapInArrow(
            lambda batches, shared=shared, n=n: _priced(batches, depth, shared.value, unit, n == 0),
            "row long, n_bytes long, n_tokens long, n_known long, base_score double, score double",
        )
        sums.append(scratch.keep(found, "sums"))
        shared.unpersist()
    names = ["n_bytes", "n_tokens", "n_known", "base_score", "score"]
    whole = sums[0]
    for more in sums[1:]:
        whole = whole.unionByName(more)
    whole = whole.groupBy("row").agg(*(F.sum(c).alias(c) for c in names))
    return rows.select("row", "key").join(whole, "row").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
