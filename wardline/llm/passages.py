"""Passages of many words that stand in more than one text.

A passage of ``words`` words has the same shingle of lowest hash in every text that holds it (winnowing), so only
those shingles are compared first. Around the ones that two texts have in common, whole passages are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.rolling import gram_hashes, lowest, run_hashes
from wardline.llm.shared import Scratch

WORDS = 50
#: Shingles of a text that are worked on at a time; their number fits in the low bits of an order value.
PIECE = (1 << 20) - 4096
_PLACE = np.uint64((1 << 20) - 1)
#: Words that are hashed together, and the bytes of a word that count for its hash. Passages are compared whole later,
#: so words of one hash cost time only.
WORDS_TOGETHER, HASHED_BYTES = 1 << 16, 256


def word_hashes(parts: list[bytes]) -> np.ndarray:
    """A hash of each word, by sums over the bytes of many."""
    found = [np.empty(0, np.uint64)]
    for i in range(0, len(parts), WORDS_TOGETHER):
        some = parts[i : i + WORDS_TOGETHER]
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        if sizes.max() > HASHED_BYTES:
            some = [word[:HASHED_BYTES] for word in some]
            sizes = np.minimum(sizes, HASHED_BYTES)
        found.append(run_hashes(np.frombuffer(b"".join(some), np.uint8), sizes))
    return np.concatenate(found)


def winnowed(parts: list[bytes], words: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen shingles: the lowest hash, leftmost among equals, of each passage's shingles."""
    places, prints = [], []
    hashes = word_hashes(parts)
    width = words - shingle + 1
    for base in range(0, max(len(parts) - words + 1, 0), PIECE):
        found = gram_hashes(hashes[base : base + PIECE + words - 1], shingle)
        order = (found & ~_PLACE) | np.arange(len(found), dtype=np.uint64)
        chosen = lowest(order, width)
        # Choices come in rising places, so equal ones stand together.
        at = (chosen[np.diff(chosen, prepend=~chosen[:1]) != 0] & _PLACE).astype(np.int64)
        places.append(at + base)
        prints.append(found[at].view(np.int64))
    return np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(prints or [np.empty(0, np.int64)])


def _lines(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(row, size, line): words and a digest of each text of ``words`` words or more, whatever parts the words."""
    for batch in batches:
        out = []
        for row, data in zip(batch.column("row").to_pylist(), batch.column("data")):
            parts = data.as_py().split()
            if len(parts) >= words:
                out.append((row, len(parts), hashlib.sha256(b" ".join(parts)).digest()))
        columns = list(zip(*out)) or [()] * 3
        types = [pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "size", "line"])


def _chosen(batches: Iterator[pa.RecordBatch], words: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(row, print): the chosen shingles of each text, each once."""
    for batch in batches:
        own = [np.unique(winnowed(data.as_py().split(), words, shingle)[1]) for data in batch.column("data")]
        rows = np.repeat(batch.column("row").to_numpy(), np.array([len(o) for o in own], np.int64))
        prints = np.concatenate(own or [np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(prints, pa.int64())], ["row", "print"])


def _whole(batches: Iterator[pa.RecordBatch], words: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(row, start, passage): place and digest of each passage around a shingle that another text has too."""
    for batch in batches:
        for row, data, wanted in zip(batch.column("row").to_pylist(), batch.column("data"), batch.column("prints")):
            parts = data.as_py().split()
            places, prints = winnowed(parts, words, shingle)
            starts: set[int] = set()
            for place in places[np.isin(prints, wanted.values.to_numpy())].tolist():
                starts.update(range(max(place - words + shingle, 0), min(place, len(parts) - words) + 1))
            ordered = sorted(starts)
            for i in range(0, len(ordered), 1 << 16):
                some = ordered[i : i + (1 << 16)]
                digests = [xxhash.xxh3_128_digest(b" ".join(parts[s : s + words])) for s in some]
                columns = [pa.array([row] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "start", "passage"])


def _of_several(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that more than one row has; very common ones are counted before they are shuffled."""
    return rows.groupBy(key).agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last").select(key)


def shared_words(texts: DataFrame, scratch: Scratch, words: int = WORDS, shingle: int | None = None) -> DataFrame:
    """(row, n_shared_words) of the texts that hold words of a passage of ``words`` words that another text has too.

    ``texts`` is a written table with (row, data), a number and UTF-8 bytes. Words are what white space of ASCII
    parts, compared as they stand. Texts of the same words are compared by one digest; of each such class one text
    meets the others. Shorter texts have no passage. Lists per text grow with the text only. Shingles have half as many
    words as passages unless told otherwise.
    """
    shingle = shingle or max(words // 2, 1)
    classed = texts.select("row", "data").mapInArrow(lambda b: _lines(b, words), "row long, size long, line binary")
    classed = scratch.keep(classed, "classed")
    classes = scratch.keep(classed.groupBy("line").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.count("*").alias("n")), "classes")
    heads = texts.select("row", "data").join(classes.select("row"), "row", "left_semi")
    prints = scratch.keep(heads.mapInArrow(lambda b: _chosen(b, words, shingle), "row long, print long"), "prints")
    common = scratch.keep(_of_several(prints, "print"), "common")
    wanted = prints.join(common, "print", "left_semi").groupBy("row").agg(F.collect_list("print").alias("prints"))
    around = texts.select("row", "data").join(wanted, "row").mapInArrow(lambda b: _whole(b, words, shingle), "row long, start long, passage binary")
    around = scratch.keep(around, "around")
    scratch.drop(prints, common)
    held = around.join(scratch.keep(_of_several(around, "passage"), "repeated"), "passage", "left_semi")
    starts = held.groupBy("row").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    # From one start to the next at most a passage of words is covered; from the last one, a whole passage.
    covered = F.expr(f"aggregate(sequence(1, size(starts)), 0L, (sum, i) -> sum + least({words}L, coalesce(get(starts, i) - starts[i - 1], {words}L)))")
    found = classes.join(starts.select("row", covered.alias("covered")), "row", "left").select(
        "line", F.when(F.col("n") > 1, F.col("size")).otherwise(F.col("covered")).alias("n_shared_words")
    )
    return classed.select("row", "line").join(found.where("n_shared_words > 0"), "line").select("row", "n_shared_words")
