"""The named queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, divergence, personal, secretscan, sentencepieces, tokencounts, toxicity, treeweight, warc
from wardline.llm.quantised import near_vectors
from wardline.llm.shared import Scratch
from wardline.llm.simhash import near_groups
from wardline.llm.suffixes import without_repeats
from wardline.llm.whitening import whiten

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), words=3, differing=2)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null texts are empty. Behind the contract's columns the words in passages that others share."""
    return without_repeats(table(spark, sf_dir, "documents"), length=400, words=50)


def op3_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = sentencepieces.read_model(public_tokenizers.path(PIECES))
    trip = sentencepieces.round_trip(spark, F.col("text"), model)
    return table(spark, sf_dir, "documents").select("doc_id", trip.alias("trip")).select(
        "doc_id", "trip.n_tokens", "trip.ids_sha256", "trip.decoded_sha256", "trip.decoded_same"
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds; clean documents have none."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(kind) for kind in personal.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(personal.listed(base), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_added"),
    )


def op7_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per encoded length: with its sums every context limit can be answered."""
    import public_tokenizers

    ranks = sentencepieces.read_model(public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents")
    return tokencounts.length_histogram(docs, tokencounts.counted(spark, F.col("text"), ranks, public_tokenizers.PATTERN))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("archives")
    warc.write(table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read(spark, path, payloads=False).select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = docs.select("doc_id", toxicity.held_out().alias("held_out"), toxicity.scores(spark, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_treeweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; empty and null texts have score 0 and no bits per byte."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    found = treeweight.score(table(spark, sf_dir, "documents"), ~held_out)
    bits = F.try_divide(-F.col("score") / F.log10(F.lit(2.0)), F.col("n_bytes"))
    return found.withColumn("held_out", held_out).withColumn("bits_per_byte", bits)


def op11_secretscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document; null texts have none."""
    found = secretscan.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(of_kind, secretscan.BASE), F.sha2(personal.listed(base), 256).alias("base_sha256"),
        personal.listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_checked"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per usable vector and component; a deviation beyond a long is null, as is what has no spread."""
    fit = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*(F.lit(v).cast("double") for v in fit.explained)).cast("array<double>")
    return fit.rows.select("vec_id", "copies", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.try_element_at(explained, F.col("at") + 1).alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error"), "copies",
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source differs from the others of its language, and in which terms from the language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_suffixes": op2_suffixes,
    "op3_quantised": op3_quantised,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontaminate": op5_decontaminate,
    "op6_personal": op6_personal,
    "op7_tokencounts": op7_tokencounts,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_treeweight": op10_treeweight,
    "op11_secretscan": op11_secretscan,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}

OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), own AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), langs AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), totals AS (
    SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
    LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
    LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source AND k.term = o.term
), pair_values AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_values p ON a.lang = p.lang AND a.source = p.source AND b.source = p.item
    UNION ALL
    SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
SQL: dict[str, str] = {"op13_divergence": OP13_SQL}
