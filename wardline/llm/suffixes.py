"""Removal of long byte strings that occur more than once, by sorted suffixes.

Where a string of ``length`` bytes occurs twice, both places choose the same anchor in it: the GRAM bytes of
lowest hash, leftmost among equals. So starts of strings are filed under their anchor, with the bytes that
those strings cover (a segment); only segments of one anchor can share a string. Equal segments are found
by counting. Of the others, the suffixes from the anchor and the mirrored prefixes before it are sorted
(multikey quicksort to a shallow depth, blind tries beyond it), and neighbours in the two orders give the
longest strings that each segment shares. Anchors of very many segments are cut into ranges of starts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.passages import shared_words
from wardline.llm.rolling import gram_hashes, lowest
from wardline.llm.shared import Scratch, ready_python

LENGTH, GRAM = 400, 64
#: Anchors with more segments than this are cut into ranges before a task sorts them; the result is the same.
CROWD = 1000
#: Starts of a text that are worked on at a time; their number fits in the low bits of an order value.
PIECE = (1 << 20) - 4096
#: Bytes of texts in a bucket, about.
BUCKET_BYTES = 64 << 20
_PLACE = np.uint64((1 << 20) - 1)
_STEP = 8
#: Depth, in bytes beyond the gram, to which quicksort goes.
SHALLOW = 32


def anchors(data: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, hash, low, high): anchors with the starts filed there, as distances low to high before them."""
    whole = np.frombuffer(data, np.uint8)
    starts = len(data) - length + 1
    for base in range(0, max(starts, 0), PIECE):
        count = min(PIECE, starts - base)
        hashes = gram_hashes(whole[base : base + count - 1 + length], gram)
        order = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (lowest(order, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.nonzero(np.diff(chosen, prepend=-1))[0]
        last = np.append(first[1:], len(chosen)) - 1
        at = chosen[first]
        yield from zip((at + base).tolist(), hashes[at].view(np.int64).tolist(), (at - last).tolist(), (at - first).tolist())


def segment(data: bytes, place: int, low: int, high: int, length: int) -> bytes:
    return data[place - high : place - low + length]


def name(content: bytes, low: int, high: int) -> int:
    """A signed 64-bit hash of a segment; it stands for the segment together with the anchor's hash."""
    hashed = xxhash.xxh3_64_intdigest(content, low << 16 | high)
    return hashed - (1 << 64) if hashed >> 63 else hashed


def shared_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    odd = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return size - (odd.bit_length() + 7) // 8


class _Branch:
    __slots__ = ("depth", "next")

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.next: dict[int, _Branch | list[int]] = {}


def blind_sorted(texts: list[bytes], members: list[int]) -> list[int]:
    """Order members by text with a blind trie: go down by branching bytes only, then compare once with the
    text found there to see where to branch off."""
    root: _Branch | list[int] = [members[0]]
    for member in members[1:]:
        text, node = texts[member], root
        while isinstance(node, _Branch):
            byte = text[node.depth] if node.depth < len(text) else -1
            node = node.next.get(byte) or next(iter(node.next.values()))
        other = texts[node[0]]
        depth = shared_prefix(text, other)
        if depth == len(text) == len(other):
            node.append(member)
            continue
        above, below = None, root
        while isinstance(below, _Branch) and below.depth < depth:
            above, below = below, below.next[text[below.depth]]
        byte = text[depth] if depth < len(text) else -1
        if isinstance(below, _Branch) and below.depth == depth:
            below.next[byte] = [member]
            continue
        branch = _Branch(depth)
        branch.next[other[depth] if depth < len(other) else -1] = below
        branch.next[byte] = [member]
        if above is None:
            root = branch
        else:
            above.next[text[above.depth]] = branch
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, _Branch):
            todo.extend(node.next[b] for b in sorted(node.next, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(texts: list[bytes], depth: int, limit: int) -> list[int]:
    """Numbers of the texts in order; their first ``depth`` bytes are known to be equal.

    Multikey quicksort takes ``_STEP`` bytes at a time down to ``limit``; what is still equal there goes to
    a blind trie.
    """
    out: list[int] = []
    todo = [(list(range(len(texts))), depth)]
    while todo:
        members, at = todo.pop()
        if len(members) < 2:
            out.extend(members)
        elif at >= limit:
            out.extend(blind_sorted(texts, members))
        else:
            keys = [texts[m][at : at + _STEP] for m in members]
            pivot = keys[len(keys) // 2]
            below = [m for m, k in zip(members, keys) if k < pivot]
            equal = [m for m, k in zip(members, keys) if k == pivot]
            above = [m for m, k in zip(members, keys) if k > pivot]
            todo += [(above, at), (equal, at + _STEP if len(pivot) == _STEP else limit), (below, at)]
    return out


def reaches(segments: list[tuple[bytes, int, int]], length: int, gram: int) -> list[tuple[int, int]]:
    """For each (content, low, high) of one anchor: how far before and after the anchor the strings reach
    that it shares with another one; (0, 0) if there is none.

    Suffixes join in the order of their common prefixes, longest first, so two groups that meet share just
    that much after the anchor. Each member of the smaller group looks for its neighbours in the larger by
    the order of the mirrored prefixes; no other member shares more before the anchor.
    """
    after = [content[high:] for content, _, high in segments]
    before = [content[:high][::-1] for content, _, high in segments]
    order = deep_shallow(after, 0, gram + SHALLOW)
    mirrored = deep_shallow(before, 0, SHALLOW)
    rank = [0] * len(segments)
    for n, member in enumerate(mirrored):
        rank[member] = n
    common = [shared_prefix(after[a], after[b]) for a, b in zip(order, order[1:])]
    group = {member: [rank[member]] for member in order}
    top = list(range(len(segments)))

    def find(member: int) -> int:
        while top[member] != member:
            top[member] = top[top[member]]
            member = top[member]
        return member

    left, right = [0] * len(segments), [0] * len(segments)
    for i in sorted(range(len(common)), key=lambda i: -common[i]):
        reach = common[i]
        a, b = find(order[i]), find(order[i + 1])
        small, large = (a, b) if len(group[a]) < len(group[b]) else (b, a)
        ranks = group[large]
        for r in group.pop(small):
            at = bisect_left(ranks, r)
            for near in ranks[max(at - 1, 0) : at + 1]:
                one, other = mirrored[r], mirrored[near]
                back = shared_prefix(before[one], before[other])
                if back + reach >= length:
                    for member in (one, other):
                        left[member] = max(left[member], back)
                        right[member] = max(right[member], reach)
            ranks.insert(at, r)
        top[small] = large
    return list(zip(left, right))


def _filed(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(row, anchor, name, n, low, high): the different segments of each text, with their number."""
    for batch in batches:
        columns: list[list[int]] = [[] for _ in range(6)]
        for row, data in zip(batch.column("row").to_pylist(), batch.column("data")):
            data, seen = data.as_py(), {}
            for place, anchor, low, high in anchors(data, length, gram):
                key = (anchor, name(segment(data, place, low, high, length), low, high), low, high)
                seen[key] = seen.get(key, 0) + 1
            for (anchor, own, low, high), n in seen.items():
                for column, value in zip(columns, (row, anchor, own, n, low, high)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "anchor", "name", "n", "low", "high"])


def _fetched(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(anchor, name, low, high, content) of the segments that a text is asked for."""
    for batch in batches:
        rows, size = [], 0
        for data, wanted in zip(batch.column("data"), batch.column("wanted")):
            data, wanted = data.as_py(), {(w["anchor"], w["name"]) for w in wanted.as_py()}
            for place, anchor, low, high in anchors(data, length, gram):
                content = segment(data, place, low, high, length)
                key = (anchor, name(content, low, high))
                if key in wanted:
                    wanted.discard(key)
                    rows.append((*key, low, high, content))
                    size += len(content)
                    if size > 8 << 20:
                        yield _segments(rows)
                        rows, size = [], 0
        yield _segments(rows)


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "name", "low", "high", "content"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(anchor, name, before, after) of rows that come sorted by ``part``, one group after the other."""
    part, members = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if len(members) > 1:
            found = reaches([m[2:] for m in members], length, gram)
            rows = [(m[0], m[1], a, b) for m, (a, b) in zip(members, found) if a + b >= length]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "name", "before", "after"])

    for batch in batches:
        columns = [batch.column(c) for c in ("part", "anchor", "name", "content", "low", "high")]
        for own, *member in zip(*(c.to_pylist() for c in columns)):
            if own != part:
                yield from done()
                part, members = own, []
            members.append(tuple(member))
    yield from done()


def _halved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Cut the range of starts of each row in two. A half's strings all hold the bytes that the half's first
    and last string share, so these tell its parts apart."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            middle = (r["first"] + r["last"]) // 2
            for first, last in ((r["first"], middle), (middle + 1, r["last"])):
                low, high = max(r["low"], first), min(r["high"], last)
                if first > last or low > high:
                    continue
                # The anchor stands ``high`` bytes into the content of its row.
                content = r["content"][r["high"] - high : r["high"] - low + length]
                core = content[high - first : high - last + length]
                part = xxhash.xxh3_64_intdigest(core + last.to_bytes(4), r["part"] & ((1 << 64) - 1)) >> 1
                rows.append((part, r["anchor"], r["name"], first, last, low, high, content, name(content, low, high)))
        columns = list(zip(*rows)) or [()] * 9
        types = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
        names = ["part", "anchor", "name", "first", "last", "low", "high", "content", "own"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_ROW = "part long, anchor long, name long, first long, last long, low long, high long, content binary, own long"


def shared_strings(segments: DataFrame, scratch: Scratch, length: int, gram: int) -> list[DataFrame]:
    """Tables of (anchor, name, before, after) for different segments (anchor, name, low, high, content)."""
    found = []
    rows = scratch.keep(
        segments.select(
            F.col("anchor").alias("part"), "anchor", "name", F.lit(0).cast("long").alias("first"),
            F.lit(length - gram).cast("long").alias("last"), "low", "high", "content", F.col("name").alias("own"),
        ),
        "segments",
    )
    while True:
        sizes = scratch.keep(rows.groupBy("part").agg(F.count("*").alias("size")).where(F.col("size") > 1), "sizes")
        crowds = sizes.where(F.col("size") > CROWD).select("part")
        few = rows.join(sizes.where(F.col("size") <= CROWD).select("part"), "part", "left_semi")
        # A part has at most CROWD segments here, so a task may hold it.
        parts = few.select("part", "anchor", "name", "content", "low", "high").repartition("part").sortWithinPartitions("part")
        sorted_ = parts.mapInArrow(lambda b: _sorted_groups(b, length, gram), "anchor long, name long, before long, after long")
        found.append(scratch.keep(sorted_, "reaches"))
        if crowds.isEmpty():
            return found
        many = rows.join(crowds, "part", "left_semi")
        halves = scratch.keep(many.mapInArrow(lambda b: _halved(b, length), _ROW), "halves")
        # Segments may have become equal; then all their strings are shared, and one of them goes on.
        same = halves.groupBy("part", "own").agg(F.count("*").alias("n"), F.min(F.struct("anchor", "name")).alias("keeper"))
        same = scratch.keep(same, "same")
        equal = halves.join(same.where("n > 1").select("part", "own"), ["part", "own"])
        found.append(scratch.keep(equal.select("anchor", "name", F.col("high").alias("before"), (length - F.col("low")).alias("after")), "equal"))
        keepers = same.select("part", "own", F.col("keeper.anchor").alias("anchor"), F.col("keeper.name").alias("name"))
        rows = scratch.keep(halves.join(keepers, ["part", "own", "anchor", "name"], "left_semi").select(*(c.split()[0] for c in _ROW.split(", "))), "parts")


def _cut(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Sizes and the hash of what is left of each text."""
    for batch in batches:
        out = []
        for data, held in zip(batch.column("data"), batch.column("reaches")):
            data, spans, removed = data.as_py(), 0, 0
            reach = {(r["anchor"], r["name"]): (r["before"], r["after"]) for r in held.as_py() or ()}
            kept = hashlib.sha256()
            if reach:
                edges = np.zeros(len(data) + 1, np.int32)
                for place, anchor, low, high in anchors(data, length, gram):
                    own = reach.get((anchor, name(segment(data, place, low, high, length), low, high)))
                    if own:
                        edges[place - own[0]] += 1
                        edges[place + own[1]] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                removed = int(gone.sum())
                spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
                kept.update(np.frombuffer(data, np.uint8)[~gone].tobytes())
            else:
                kept.update(data)
            out.append((len(data), removed, spans, kept.hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])]
        names = ["row", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), *columns], names)


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, words: int | None = None
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row; with ``words`` also n_shared_words.

    Removed is each byte of a string of ``length`` bytes that starts anywhere else too, in the same text or
    another; strings overlap and are judged on the whole input. Texts are UTF-8, null is empty; texts
    shorter than ``length`` lose nothing. Repeated rows are texts of their own, so long ones go entirely.
    Other columns are left out.

    ``n_shared_words`` counts the words of a row in passages of ``words`` words that another row has too, however few
    bytes they are; nothing is removed for it.
    """
    spark = docs.sparkSession
    ready_python(spark)
    scratch = Scratch(spark)
    shape = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    # Texts are written once, in buckets by row: what is later known of a row meets its text without
    # another shuffle of texts.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    # A bucket is one task later on, so there are more of them for more bytes.
    size = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    table = f"texts_{scratch.folder[-32:]}"
    rows.repartition(buckets, "row").write.bucketBy(buckets, "row").option("path", scratch.path("texts")).format("parquet").saveAsTable(table)
    texts = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the frame reads them
    filed = texts.select("row", "data").mapInArrow(
        lambda b: _filed(b, length, gram), "row long, anchor long, name long, n long, low long, high long"
    )
    filed = scratch.keep(filed, "filed")
    names = filed.groupBy("anchor", "name").agg(
        F.sum("n").alias("n"), F.min("row").alias("row"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    names = scratch.keep(names, "names")
    shared = names.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1").select("anchor")
    wanted = names.join(shared, "anchor", "left_semi").groupBy("row").agg(F.collect_list(F.struct("anchor", "name")).alias("wanted"))
    segments = texts.select("row", "data").join(wanted.hint("shuffle_merge"), "row").select("data", "wanted").mapInArrow(
        lambda b: _fetched(b, length, gram), "anchor long, name long, low long, high long, content binary"
    )
    found = names.where("n > 1").select("anchor", "name", F.col("high").alias("before"), (length - F.col("low")).alias("after"))
    for part in shared_strings(segments, scratch, length, gram):
        found = found.unionByName(part)
    reached = found.groupBy("anchor", "name").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    reached = scratch.keep(reached, "reached")
    held = filed.select("row", "anchor", "name").join(reached, ["anchor", "name"])
    held = held.groupBy("row").agg(F.collect_list(F.struct("anchor", "name", "before", "after")).alias("reaches"))
    found = texts.join(held.hint("shuffle_merge"), "row", "left").select("row", "key", "data", "reaches").mapInArrow(
        lambda b: _cut(b, length, gram), f"row long, key {shape}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if words is not None:
        found = found.join(shared_words(texts, scratch, words), "row", "left").fillna(0, ["n_shared_words"])
        names.append("n_shared_words")
    return found.select(F.col("key").alias(key), *names)
