"""Token counts from an exact histogram of encoded lengths.

Documents are counted by their length in tokens; sums over the histogram from a length upwards then answer
totals, quantiles and truncated totals for every context limit, without another pass over texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.shared import Scratch, ready_python

#: Lengths are summed in spans of so many, then over the spans: one row per span in the second sum.
SPAN = 4096
#: The library's matcher overflows on long white space, so runs of this length are encoded on their own.
_LONG_SPACE = regex.compile(r"\p{White_Space}{4096,}")
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """One encoding per worker for the bytes of a rank file."""
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if name not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[name]


def token_count(own: tiktoken.Encoding, text: str | None) -> int:
    """Tokens of the whole text; 0 for null and empty ones.

    White space before a word is a piece up to its last character, which goes with the word; at the end of
    the text all of it is a piece.
    """
    if not text:
        return 0
    total = start = 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        if run.start() > start:
            total += len(own.encode_ordinary(text[start : run.start()]))
        total += len(own._encode_single_piece(text[run.start() : stop]))
        start = stop
    return total + (len(own.encode_ordinary(text[start:])) if start < len(text) else 0)


def counted(spark: SparkSession, text: Column, ranks: bytes, pattern: str) -> Column:
    """A column with the token count of each whole text. The rank file goes along with the job (about 1 MB)."""
    ready_python(spark)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = encoding(ranks, pattern)
        return pd.Series([token_count(own, t) for t in texts], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, length: Column) -> DataFrame:
    """(n_tokens, documents, documents_from, tokens_from, truncated_tokens) for each length that occurs.

    ``documents_from`` and ``tokens_from`` cover documents of that length or more, ``truncated_tokens`` is
    the total if every document is cut at that length. Rows with a null length are left out. An empty
    table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    counts = docs.select(length.cast("long").alias("n_tokens")).where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("documents"))
    counts = scratch.keep(counts.withColumn("span", F.floor(F.col("n_tokens") / SPAN)), "lengths")
    tokens = F.col("documents") * F.col("n_tokens")
    spans = counts.groupBy("span").agg(F.sum("documents").alias("d"), F.sum(tokens).alias("t"))
    # One row for each 4,096 lengths, so a single task can sum over the spans above.
    above = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"))
    total = counts.agg(F.coalesce(F.sum(tokens), F.lit(0))).first()[0]
    within = Window.partitionBy("span").orderBy(F.col("n_tokens").desc())
    summed = counts.select(
        "span", "n_tokens", "documents", F.sum("documents").over(within).alias("own_d"), F.sum(tokens).over(within).alias("own_t")
    )
    joined = summed.join(scratch.keep(spans, "spans"), "span")
    found = joined.select(
        "n_tokens", "documents", (F.col("own_d") + F.col("d")).alias("documents_from"), (F.col("own_t") + F.col("t")).alias("tokens_from")
    )
    cut = F.lit(total) - F.col("tokens_from") + F.col("n_tokens") * F.col("documents_from")
    return found.withColumn("truncated_tokens", cut.cast("long"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, documents_within, documents_cut, tokens_total, tokens_kept, tokens_lost) for any limits.

    A limit between two lengths reads the sums of the next longer one. Negative limits raise ValueError.
    """
    if min(limits, default=0) < 0:
        raise ValueError("a context limit is 0 or more")
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(n),) for n in sorted(set(limits))], "context_limit long")
    longer = F.col("n_tokens") > F.col("context_limit")
    sums = histogram.join(F.broadcast(asked)).groupBy("context_limit").agg(  # the limits are few
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.col("documents") * F.col("n_tokens")), F.lit(0)).alias("tokens_total"),
        F.coalesce(F.max(F.when(longer, F.col("documents_from"))), F.lit(0)).alias("documents_cut"),
        F.coalesce(F.max(F.when(longer, F.col("tokens_from"))), F.lit(0)).alias("tokens_cut"),
    )
    kept = F.col("tokens_total") - F.col("tokens_cut") + F.col("context_limit") * F.col("documents_cut")
    return sums.select(
        "context_limit", (F.col("documents") - F.col("documents_cut")).alias("documents_within"), "documents_cut",
        "tokens_total", kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_lost"),
    )


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(float(s),) for s in sorted(set(shares))], "share double")
    total = F.lit(histogram.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0])
    within = total - F.col("documents_from") + F.col("documents")
    reached = histogram.join(F.broadcast(asked), within >= F.col("share") * total)  # the shares are few
    return reached.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
