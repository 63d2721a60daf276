"""From raw lines to scored events, alerts and dead letters in one query.

Each micro-batch is read and parsed once, judged, freed of repeated ids, enriched, given its window features from the
rows that earlier batches left, scored with the newest stable model, and written to several outputs. Every output of
a batch has a folder of its own, and a mark is written last: a repeated batch overwrites what it wrote before and readers
see finished batches only, so each line counts once however often a batch is tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.casts import seconds_to_micros
from wardline.ml.online import ModelStore, online_predict, online_update
from wardline.operators import alerts, behavior, normalize
from wardline.operators.stream_features import FEATURE_ORDER
from wardline.session import settle, stored
from wardline.sources.schemas import CANONICAL_EVENT
from wardline.streaming.batches import score_batches
from wardline.streaming.jobs import judge_lines

EVENTS, ALERTS, DEAD_LETTERS, COUNTS = "events", "alerts", "dead_letters", "counts"
_IDS, _DONE, _TAIL = "ids", "done", "tail"


def output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of one output in finished batches; the column ``batch`` has the batch's number."""
    done = spark.read.schema("batch int").parquet(f"{folder}/{_DONE}").select("batch").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(done), "batch", "left_semi")


def _first_of_each(events: DataFrame) -> DataFrame:
    """Of events with the same id the earliest, then the first line."""
    row = F.min_by(F.struct(*events.columns), F.struct("at", "value"))
    return events.groupBy("event_id").agg(row.alias("_row")).select("_row.*")


def _shaped(events: DataFrame) -> DataFrame:
    """Canonical events, enriched, with the columns that scoring looks at; ids order rows of one time.

    The request rate is that of the stream's own windows, so the one that a line may carry is left out.
    """
    enriched = normalize.enrich(events.withColumn("remote_ip", F.lit(None).cast("string")))
    return enriched.select(
        "event_id", F.col("event_id").alias("seq"), "tenant_id", "ts", "at", F.col("hostname").alias("host"), F.col("user").alias("user_name"),
        "event_type", "source", "severity", "attack_type", F.col("remote_ip").alias("ip_address"), "label", "message",
    )


def process_lines(
    folder: str,
    schema: str = CANONICAL_EVENT,
    model: str | None = None,
    learn: bool = False,
    remember: float = 3600.0,
    **windows: float,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over raw JSON lines (``value``).

    Below ``folder``, which the whole cluster reaches, are the outputs: ``events`` (scored), ``alerts`` (payloads of risky
    events, to be throttled), ``dead_letters`` (the line and the reason) and ``counts`` (a row per tenant and outcome).
    Ids are remembered for ``remember`` seconds before the latest event; ids that come again are counted as
    duplicates and left out. ``model`` is the folder of a ``ModelStore``: the newest stable version scores the batch, and
    with ``learn`` the batch's labels then make the next one. ``windows`` are the spans of ``score_batches``.
    """

    def handle(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        judged = stored(judge_lines(lines, schema).withColumn("at", F.unix_micros("ts")))
        dead = judged.filter("dlq_reason IS NOT NULL").select("value", "dlq_reason")
        _write(dead, DEAD_LETTERS, batch_id)
        good = judged.filter("dlq_reason IS NULL")
        first = _first_of_each(good)
        known = spark.read.schema("event_id string, at bigint").parquet(f"{folder}/{_IDS}/batch={batch_id - 1}") if batch_id else None
        fresh = stored(first if known is None else first.join(known.select("event_id"), "event_id", "left_anti"))
        ids = fresh.select("event_id", "at")
        if known is not None:
            ids = known.select("event_id", "at").unionByName(ids)
        latest = ids.agg(F.max("at")).first()[0]
        if latest is not None:
            ids = ids.filter(F.col("at") >= latest - seconds_to_micros(remember))
        _write(ids, _IDS, batch_id)
        score(_shaped(fresh), batch_id)
        outcomes = fresh.select("tenant_id", F.lit("ingested").alias("outcome"), F.lit(1).alias("n")).unionByName(
            good.select("tenant_id", F.lit("duplicate").alias("outcome"), F.lit(1).alias("n"))
        ).unionByName(fresh.select("tenant_id", F.lit("duplicate").alias("outcome"), F.lit(-1).alias("n"))).unionByName(
            judged.filter("dlq_reason IS NOT NULL").select("tenant_id", F.lit("dead_letter").alias("outcome"), F.lit(1).alias("n"))
        )
        counts = outcomes.groupBy("tenant_id", "outcome").agg(F.sum("n").alias("n")).filter("n > 0")
        _write(counts, COUNTS, batch_id)
        _write(spark.range(1).select(F.lit(batch_id).alias("number")), _DONE, batch_id)

    def _write(rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    def predict(featured: DataFrame, batch_id: int) -> DataFrame:
        if model is None:
            from wardline.operators.stream_features import cold_start_score

            return featured.withColumns({"ml_score": cold_start_score(), "model_version": F.lit(0)})
        store = ModelStore(featured.sparkSession, model)
        state = store.newest(before=batch_id)
        if not learn:
            return online_predict(featured, state)
        held = settle(featured)
        labelled = held.select("at", "seq", *FEATURE_ORDER, "label")
        store.publish(online_update(labelled, state), batch_id)
        return online_predict(held, state)

    def sink(scored: DataFrame, batch_id: int) -> None:
        staged = behavior.mitre_map(scored).withColumn("kill_chain_stage", behavior.kill_chain_stage())
        # Alerts are read from the events as they were written.
        held = stored(staged, f"{folder}/{EVENTS}/batch={batch_id}")
        payload = alerts.alert_payload(held.filter("alert"), "user_name")
        _write(
            payload.select(
                "event_id", "tenant_id", "at", "seq", "host", "user", "severity", "risk_score", "recommended_action", "description", "dedup_key"
            ),
            ALERTS, batch_id,
        )

    score = score_batches(f"{folder}/{_TAIL}", sink, predict=predict, **windows)
    return handle


def process_stream(lines: DataFrame, folder: str, checkpoint: str, once: bool = False, every: str = "10 seconds", **options):
    """Start the query over a stream of lines; see ``process_lines``."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    writer = lines.select("value").writeStream.foreachBatch(process_lines(folder, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
