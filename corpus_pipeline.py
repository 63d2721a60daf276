"""A training corpus from raw documents, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, personal, sentencepieces, toxicity
from wardline.llm.shared import Scratch
from wardline.llm.simhash import without_near_copies

#: A document goes if its toxicity score reaches this.
TOXIC = 0.3
PIECES = "piece_bpe_32k.model"


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit, by a model fitted on the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return docs.where(toxicity.scores(spark, F.col("text"), model) < TOXIC)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash over three-word shingles, two differing bits at most.

    The one with the smallest doc_id stays (null ones last, the first of repeated ones); documents without words,
    null texts included, are one group.
    """
    return without_near_copies(docs, words=3, differing=2)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_items(docs, benchmark)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return personal.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids, and whether decoding them gives the text; null counts as empty."""
    import public_tokenizers

    model = sentencepieces.read_model(public_tokenizers.path(PIECES))
    ids = docs.withColumn("ids", sentencepieces.encoded(spark, F.col("text"), model)).withColumn("n_tokens", F.size("ids").cast("long"))
    return ids.withColumn("decoded_same", sentencepieces.decoded(spark, F.col("ids"), model) == F.coalesce("text", F.lit("")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("simhash", no_near_copies),
    ("decontamination", no_benchmarks),
    ("personal", no_personal_data),
    ("sentencepiece", encoded),
]
#: SQL can't train the classifier of the first stage, nor verify alignments or encode; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again for the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
