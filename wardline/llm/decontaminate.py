"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs with at most k edits shares at least m + 1 - q - kq of its q-grams
with the text, on diagonals (text position less passage position) that spread over no more than k + 1.
Shared q-grams are counted in overlapping bands of diagonals; bands that reach the bound are verified by a
banded alignment. Items too short for a bound are looked for as they stand, between word borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardline.llm.shared import Scratch, ready_python

Q = 8
#: Edits allowed, as a share of a passage.
ERROR = 0.1
#: Longer items are looked for by overlapping passages, so that a part of an item counts too: any 99 characters of an
#: item hold a whole passage.
PASSAGE, STRIDE = 80, 20
#: Items of fewer characters must occur without edits, between word borders.
LEAST_CHARS = 50
#: The benchmark is held against the documents in blocks of about so many characters, one after the other.
BLOCK_CHARS = 8 << 20
#: Characters of a text that are worked on at a time; pieces overlap by more than a passage with its edits.
PIECE, OVERLAP = 1 << 19, 256
#: A piece with more shared q-grams than this is halved, down to LEAST_PIECE characters.
HITS, LEAST_PIECE = 1 << 21, 4 * OVERLAP
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 22


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with each run of white space as one space, and their places in the text."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    chars = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    space = (chars == 32) | ((chars >= 9) & (chars <= 13)) | (chars == 0xA0) | (chars == 0x3000)
    chars[space] = 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    at = np.nonzero(keep)[0]
    return chars[at], at


def gram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each q-gram."""
    size = max(len(chars) - q + 1, 0)
    out = np.zeros(size, np.uint64)
    for j in range(q):
        out = (out + chars[j : j + size]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def passages(text: str | None) -> list[np.ndarray]:
    chars = normal((text or "").strip())[0]
    if len(chars) < LEAST_CHARS:
        return []
    starts = list(range(0, max(len(chars) - PASSAGE, 0) + 1, STRIDE))
    if starts[-1] + PASSAGE < len(chars):
        starts.append(len(chars) - PASSAGE)
    return [chars[s : s + PASSAGE] for s in starts]


def edits_allowed(size: int, error: float) -> int:
    return int(size * error)


def shared_needed(size: int, error: float, q: int = Q) -> int:
    return max(size + 1 - q - edits_allowed(size, error) * q, 1)


def short_item(text: str | None) -> str | None:
    """The normal form of an item that has no passages; None for one that has some, or no characters."""
    chars = normal((text or "").strip())[0]
    return _string(chars) if 0 < len(chars) < LEAST_CHARS else None


def _string(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Index:
    """The q-grams of a block of items: sorted hashes with their passage and place, and a sieve before them.

    Equal passages are one, with all their items as owners. ``short`` finds the short items.
    """

    items: list
    owners: list[list[int]]
    texts: list[np.ndarray]
    hashes: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    step: np.ndarray
    needed: np.ndarray
    error: float
    short: ahocorasick.Automaton | None

    @classmethod
    def of(cls, items: list[tuple], error: float) -> Index:
        own: dict[bytes, list[int]] = {}
        short: dict[str, list[int]] = {}
        for i, (_, text) in enumerate(items):
            for part in passages(text):
                owners = own.setdefault(part.tobytes(), [])
                if i not in owners[-1:]:
                    owners.append(i)
            if (word := short_item(text)) is not None:
                short.setdefault(word, []).append(i)
        texts = [np.frombuffer(data, "<u4") for data in own]
        hashes = [gram_hashes(t) for t in texts]
        sizes = [len(h) for h in hashes]
        joined = np.concatenate([*hashes, np.empty(0, np.uint64)])
        passage = np.repeat(np.arange(len(texts)), sizes)
        place = np.concatenate([*(np.arange(n) for n in sizes), np.empty(0, int)])
        order = np.argsort(joined, kind="stable")
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[joined >> np.uint64(64 - _SIEVE_BITS)] = True
        lengths = [len(t) for t in texts]
        step = np.array([edits_allowed(n, error) + 1 for n in lengths], int)
        needed = np.array([shared_needed(n, error) for n in lengths], int)
        keys = [key for key, _ in items]
        exact = None
        if short:
            exact = ahocorasick.Automaton()
            for word, owners in short.items():
                exact.add_word(word, (len(word), owners))
            exact.make_automaton()
        return cls(keys, list(own.values()), texts, joined[order], passage[order], place[order], sieve, step, needed, error, exact)

    def shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, first entry, number of entries) of each q-gram that the text shares with a passage."""
        found = gram_hashes(chars)
        at = np.nonzero(self.sieve[found >> np.uint64(64 - _SIEVE_BITS)])[0]
        low = np.searchsorted(self.hashes, found[at], "left")
        count = np.searchsorted(self.hashes, found[at], "right") - low
        return at[count > 0], low[count > 0], count[count > 0]

    def pieces(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple]]:
        """(begin, characters, shared q-grams) of overlapping pieces with a bounded number of hits each.

        Text that repeats itself meets a passage that does so too at very many places; such pieces are halved.
        """
        todo = [(begin, min(begin + PIECE + OVERLAP, len(chars))) for begin in range(0, max(len(chars) - OVERLAP, 1), PIECE)][::-1]
        while todo:
            begin, end = todo.pop()
            shared = self.shared(chars[begin:end])
            if shared[2].sum() > HITS and end - begin > LEAST_PIECE:
                middle = (begin + end) // 2
                todo += [(middle - OVERLAP // 2, end), (begin, middle + OVERLAP // 2)]
            else:
                yield begin, chars[begin:end], shared

    def hits(self, shared: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, place in it, diagonal) of each shared q-gram."""
        at, low, count = shared
        each = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.passage[each], self.place[each], np.repeat(at, count) - self.place[each]

    def whole_words(self, chars: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the short items between word borders, in the whole text."""
        if self.short is None:
            return
        for begin in range(0, max(len(chars) - OVERLAP, 1), PIECE):
            for last, (size, owners) in self.short.iter(_string(chars[begin : begin + PIECE + OVERLAP])):
                start, end = begin + last + 1 - size, begin + last + 1
                if not _joined(chars, start) and not _joined(chars, end):
                    for item in owners:
                        yield item, start, end

    def bands(self, shared: tuple) -> Iterator[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of the bands that reach the bound."""
        passage, place, diagonal = self.hits(shared)
        if not len(passage):
            return
        step, needed = self.step, self.needed
        # A passage with few hits in the whole piece can't reach its bound in a band.
        enough = np.bincount(passage, minlength=len(step)) >= needed
        if not enough.any():
            return
        stay = enough[passage]
        passage, place, diagonal = passage[stay], place[stay], diagonal[stay]
        # Each hit is in two bands of two steps, so any spread of one step lies within one band.
        own = step[passage]
        number = np.floor_divide(diagonal, own)
        key = np.concatenate([passage, passage]).astype(np.int64) << 32
        key += np.concatenate([number, number - 1]) + (1 << 30)
        keys, times = np.unique(key, return_counts=True)
        keys = keys[times >= needed[keys >> 32]]
        if not len(keys):
            return
        # A q-gram of the passage counts once in a band, however often the text repeats it.
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        inside = keys[at] == key
        once = np.unique(at[inside] * PASSAGE + np.concatenate([place, place])[inside]) // PASSAGE
        times = np.bincount(once, minlength=len(keys))
        for key in keys[times >= needed[keys >> 32]].tolist():
            p, n = key >> 32, (key & 0xFFFFFFFF) - (1 << 30)
            yield p, n * int(step[p]), (n + 2) * int(step[p]) - 1


def _joined(chars: np.ndarray, at: int) -> bool:
    """Whether a letter or digit stands on both sides of this place."""
    return 0 < at < len(chars) and chr(chars[at - 1]).isalnum() and chr(chars[at]).isalnum()


def _banded(pattern: np.ndarray, text: np.ndarray, low: int, cost: np.ndarray) -> np.ndarray:
    """Edits of the whole pattern by the diagonal it ends on; the band is ``low`` and those after it, entered at ``cost``.

    Places outside the text hold a character of their own, so leaving them unmatched costs an edit each.
    """
    width, steps = len(cost), np.arange(len(cost))
    before = max(-low, 0)
    after = max(low + width + len(pattern) - len(text), 0)
    padded = np.pad(text.astype(np.int64), (before, after), constant_values=-1)
    places = np.lib.stride_tricks.sliding_window_view(padded, width)[low + before : low + before + len(pattern)]
    misses = places != pattern.astype(np.int64)[:, None]
    far = len(pattern) + width
    above = np.empty(width, np.int64)
    for miss in misses:
        above[:-1] = cost[1:]
        above[-1] = far
        # A pattern character against one of the text, or against none; then text characters left over.
        cost = np.minimum(cost + miss, above + 1)
        cost = np.minimum.accumulate(cost - steps) + steps
    return cost


def _exact(pattern: np.ndarray, text: np.ndarray) -> int:
    """The first place of the pattern without edits, or -1."""
    needle, hay, at = pattern.tobytes(), text.tobytes(), -1
    while True:
        at = hay.find(needle, at + 1)
        if at < 0 or at % pattern.itemsize == 0:
            return at // pattern.itemsize


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the pattern on diagonals low to high, if within ``edits``.

    The band is widened by the edits on both sides. Ties: the first end, then the shortest place.
    """
    place = _exact(pattern, text)
    if place >= 0:
        return 0, place, place + len(pattern)
    first = low - edits
    ends = _banded(pattern, text, first, np.zeros(high - low + 2 * edits + 1, np.int64))
    cost = int(ends.min())
    if cost > edits:
        return None
    end = min(int(ends.argmin()) + first + len(pattern), len(text))
    # Back from that end, on the reversed strings, to where it starts.
    back = np.abs(np.arange(-edits, edits + 1))
    starts = _banded(pattern[::-1], text[:end][::-1], -edits, back)
    start = max(end - (int(starts.argmin()) - edits + len(pattern)), 0)
    return cost, start, end


def found_in(text: str | None, index: Index) -> list[tuple]:
    """(item, start, end, edits) of the items that the whole text holds, each at its best place."""
    chars, places = normal(text or "")
    best: dict[int, tuple] = {}

    def candidate(item: int, cost: int, start: int, end: int) -> None:
        place = (cost, int(places[start]), int(places[end - 1]) + 1)
        best[item] = min(best.get(item, place), place)

    for begin, piece, shared in index.pieces(chars):
        for p, low, high in index.bands(shared):
            pattern = index.texts[p]
            edits = edits_allowed(len(pattern), index.error)
            from_, to = max(low - edits, 0), high + len(pattern) + 2 * edits + 1
            region = piece[from_:to]
            match = aligned(pattern, region, low - from_, high - from_, edits)
            if match:
                cost, start, end = match
                for item in index.owners[p]:
                    candidate(item, cost, begin + from_ + start, begin + from_ + end)
    for item, start, end in index.whole_words(chars):
        candidate(item, 0, start, end)
    return [(index.items[i], start, end, cost) for i, (cost, start, end) in sorted(best.items())]


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", error: float = ERROR,
) -> DataFrame:
    """(key, item, start, end, edits): a row for each document row and item that it holds.

    An item counts as held if one of its passages occurs with at most ``error`` of its length in edits,
    letter case and the amount of white space aside; start and end are code points of the whole text, of
    the passage with the fewest edits, the first among equals. Items of fewer than ``LEAST_CHARS`` characters count if
    they occur without edits (case and white space aside) where no letter or digit goes on at either end. Items with null or
    empty texts and null or empty documents match nothing. Items of equal text are told apart by their id. Repeated rows give repeated results; other columns are left out. Empty tables give none.
    """
    spark = docs.sparkSession
    ready_python(spark)
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = total // BLOCK_CHARS + 1
    kinds = {c: t for c, t in [*docs.select(F.col(key).alias("key")).dtypes, *items.dtypes]}
    types = [to_arrow_type(items.schema["item"].dataType), *[pa.int64()] * 3]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = None
    for block in range(blocks):
        # A block's items reach the driver and then every worker; its size is bounded whatever the benchmark's.
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        own = sorted(((r["item"], r["text"]) for r in own), key=lambda r: (r[0] is None, () if r[0] is None else (r[0],), r[1]))
        shared = spark.sparkContext.broadcast(Index.of(own, error))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("key")
                at, out = [], []
                for i, text in enumerate(batch.column("text")):
                    for match in found_in(text.as_py(), shared.value):
                        at.append(i)
                        out.append(match)
                columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, types)]
                columns = [keys.take(pa.array(at, pa.int64())), *columns]
                yield pa.RecordBatch.from_arrays(columns, ["key", "item", "start", "end", "edits"])

        part = rows.mapInArrow(searched, f"key {kinds['key']}, item {kinds['item']}, start long, end long, edits long")
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "start", "end", "edits")


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; ``settings`` as for ``matches``.

    Rows are written once with a number that tells them apart, so null and repeated keys don't matter.
    """
    number = "row number of matches"
    scratch = Scratch(docs.sparkSession)
    numbered = scratch.numbered(docs, number)
    held = matches(numbered, benchmark, number, text, **settings).select(number).distinct()
    held = scratch.keep(held, "held")
    return numbered.join(held, number, "left_anti").drop(number)
