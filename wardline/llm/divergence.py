"""How the vocabularies of sources differ, by exact whole-number arithmetic.

Counting works on 64-bit digests of terms: texts of terms are not shuffled with the counts. The smallest and the
largest term of each kept digest tell where different terms share one; only there terms are counted anew, by text.
Texts are joined back at the end, for the terms that are put out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.shared import Scratch, ready_python

LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: Fixed value: bytes of terms are letters, put in lower case, and all that is beyond ASCII; others become spaces.
SPACED = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Different terms (by group) that a task holds before it hands their counts on.
HELD = 1 << 20
#: Texts of more bytes are counted piece by piece, without a list of all their terms.
LONG = 1 << 20
#: Groups (of a language and a source) whose numbers go to every worker, and kept terms whose digests do; more of them
#: are joined with a shuffle.
BROADCAST_GROUPS, BROADCAST_TERMS = 100_000, 1_000_000


def count_terms(text: bytes, times: Counter, docs: Counter) -> None:
    """Add the terms of a text in UTF-8 to ``times``, each as often as it occurs, and to ``docs`` once.

    Letters and bytes beyond ASCII stay, all else parts them. A very long text is split piece by piece.
    """
    spaced, begin, seen = text.translate(SPACED), 0, set()
    while begin < len(spaced):
        end = spaced.find(b" ", begin + LONG)
        terms = (spaced[begin:end] if end >= 0 else spaced[begin:]).split()
        # Counting a list, or a set, has no loop in Python.
        times.update(terms)
        seen.update(terms)
        begin = end if end >= 0 else len(spaced)
    docs.update(seen)


def _counted(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, digest, term, n, docs): partial counts of one task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size, shift = 0, 64 - digest_bits

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            digests = [xxhash.xxh64_intdigest(t) >> shift for t in times]
            rows = len(digests)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()),
                    pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(list(times), pa.string()),
                    pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64()),
                ],
                ["lang", "source", "digest", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            times, docs = held[lang, source]
            before = len(times)
            count_terms(text, times, docs)
            size += len(times) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)); null without terms."""
    whole = f"cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {terms} as decimal(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {whole} END")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, one, other, value): the terms' gaps of one task, added up for each two places of the shares."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        shares = batch.column("shares")
        for lang in set(langs.tolist()):
            own = shares.filter(pa.array(langs == lang))
            p = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            total = totals.setdefault(lang, np.zeros((p.shape[1], p.shape[1]), np.int64))
            for i in range(p.shape[1]):
                gap = p - p[:, i : i + 1]
                total[i] += (gap * gap // (p + p[:, i : i + 1])).sum(axis=0)
    for lang, total in totals.items():
        for i, row in enumerate(total):
            columns = [pa.array([lang] * len(row), pa.string()), pa.array([i] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()), pa.array(row)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "one", "other", "value"])


class Audit:
    """Counts of the kept terms, and the two reports made from them.

    ``groups``: (lang, source, total, terms), a row per group that occurs, with the occurrences of kept terms in
    it and the number of the language's kept terms. ``own``: (lang, source, digest, name, n), the counts of kept
    terms by group; ``name`` is empty unless different terms share the digest.
    """

    def __init__(self, docs: DataFrame, text: str, lang: str, source: str, least_documents: int, digest_bits: int) -> None:
        spark = docs.sparkSession
        ready_python(spark)
        self.scratch = scratch = Scratch(spark)
        rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
        shape = "lang string, source string, digest long, term string, n long, docs long"
        partial = scratch.keep(rows.mapInArrow(lambda b: _counted(b, digest_bits), shape), "partial")
        key = ["lang", "source", "digest", "name"]
        sums = (F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counts = partial.groupBy("lang", "source", "digest").agg(*sums).withColumn("name", F.lit("")).select(*key, "n", "docs")
        counts = scratch.keep(counts, "counts")
        # A term that is kept has a digest that is kept, so only those need the smallest and largest term.
        digests = self._kept(counts, least_documents).select("digest").distinct()
        digests = scratch.keep(digests, "digests")
        held = partial.join(F.broadcast(digests) if digests.count() <= BROADCAST_TERMS else digests, "digest", "left_semi")
        names = held.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
        self.names = scratch.keep(names, "names")
        shared = scratch.keep(self.names.where("low <> high").select("digest"), "shared")
        if not shared.isEmpty():
            split = partial.join(shared, "digest", "left_semi").groupBy("lang", "source", "digest", F.col("term").alias("name")).agg(*sums)
            counts = scratch.keep(counts.join(shared, "digest", "left_anti").unionByName(split), "split")
        scratch.drop(partial)
        self.kept = scratch.keep(self._kept(counts, least_documents), "kept")
        own = counts.select(*key, "n").join(self.kept.withColumnRenamed("n", "whole"), ["lang", "digest", "name"])
        self.own = scratch.keep(own, "own")
        scratch.drop(counts)
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("whole_total"))
        totals = self.own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        none = F.lit(0).cast("long")
        groups = rows.groupBy("lang", "source").agg(F.count("*").alias("documents")).join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        self.groups = scratch.keep(
            groups.select("lang", "source", "documents", *(F.coalesce(c, none).alias(c) for c in ("total", "terms", "whole_total"))), "groups"
        )
        self.small = self.groups.count() <= BROADCAST_GROUPS

    @staticmethod
    def _kept(counts: DataFrame, least_documents: int) -> DataFrame:
        """(lang, digest, name, n) of the terms in enough documents of their language."""
        whole = counts.groupBy("lang", "digest", "name").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        return whole.where(F.col("docs") >= least_documents).select("lang", "digest", "name", "n")

    def _of_group(self) -> DataFrame:
        return F.broadcast(self.groups) if self.small else self.groups

    def top_terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a group has more of than its language, by their gap."""
        shares = self.own.join(self._of_group(), ["lang", "source"]).select(
            "lang", "source", "digest", "name",
            _share("n", "total", "terms").alias("p"), _share("whole", "whole_total", "terms").alias("q"),
        )
        gaps = shares.where("p > q").select("lang", "source", "digest", "name", _gap("p", "q").alias("value"))
        of_group = Window.partitionBy("lang", "source")
        # Ties at the last rank all stay until their texts are known. Spark cuts both windows to ``top`` before the shuffle.
        leading = gaps.withColumn("place", F.rank().over(of_group.orderBy(F.desc("value")))).where(F.col("place") <= top)
        leading = self.scratch.keep(leading.drop("place"), "leading")
        named = leading.join(self.names.select("digest", "low"), "digest")
        named = named.withColumn("item", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("low")))
        ranked = named.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
        return ranked.select("lang", "source", "item", "value", "rank")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): each other source of the language, by the sum of gaps over all kept terms."""
        unseen = self.groups.select("lang", "source", F.coalesce(_share("0L", "total", "terms"), F.lit(0).cast("long")).alias("p"))
        # One row per language, as long as it has sources: the result holds the square of that.
        sources = self.scratch.keep(unseen.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "p"))).alias("all")), "sources")
        shares = self.own.join(self._of_group(), ["lang", "source"]).select("lang", "source", "digest", "name", _share("n", "total", "terms").alias("p"))
        lists = shares.groupBy("lang", "digest", "name").agg(F.map_from_entries(F.collect_list(F.struct("source", "p"))).alias("seen"))
        dense = lists.join(F.broadcast(sources) if self.small else sources, "lang").select(
            "lang", F.transform("all", lambda s: F.coalesce(F.element_at("seen", s.source), s.p)).alias("shares")
        )
        sums = dense.mapInArrow(_pair_sums, "lang string, one int, other int, value long")
        sums = self.scratch.keep(sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value")), "sums")
        one = sources.select("lang", "all", F.posexplode("all").alias("one", "s")).select("lang", "all", "one", F.col("s.source").alias("source"))
        both = one.select("lang", "one", "source", F.posexplode("all").alias("other", "s")).select("lang", "one", "other", "source", F.col("s.source").alias("item"))
        found = both.where("one <> other").join(sums, ["lang", "one", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return found.select("lang", "source", "item", "value", rank.alias("rank"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least_documents: int = LEAST_DOCUMENTS, digest_bits: int = 64,
) -> Audit:
    """Count the terms of all texts by language and source.

    A term is a run of letters A-Z or characters beyond ASCII, A-Z in lower case. Null texts, languages and sources
    are empty strings; a group of empty texts is a group without terms. Repeated rows are documents of their own.
    Other columns are left out, whatever they are called. An empty table has no groups. Ties rank by the UTF-8
    bytes of the item. A very long text is counted piece by piece, a task holds at most HELD different terms
    beyond those of one text. The number of sources of a language must be such that its square can be put out.
    """
    return Audit(docs, text, lang, source, least_documents, digest_bits)


def divergence(docs: DataFrame, top: int = TOP, **settings) -> DataFrame:
    """(lang, source, part, item, value, rank): both reports of ``audit``, with part ``pair`` or ``term``."""
    found = audit(docs, **settings)
    parts = (("pair", found.pairs()), ("term", found.top_terms(top)))
    pair, term = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in parts)
    return pair.unionByName(term)
