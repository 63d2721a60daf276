"""Stream sources and sinks: Kafka in production, files where there is no broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardline.sources.files import parse_json_lines
from wardline.sources.schemas import CANONICAL_EVENT

PROCESSOR_VERSION = "1.0.0"
# Topic names.
TOPICS = ["tenant-events", "normalized-events", "scored-events", "alerts", "response-actions", "dead-letter-queue"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state on disk rather than on the heap; needed by the stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_lines(
    spark: SparkSession,
    path: str | None = None,
    topic: str | None = None,
    servers: str = "localhost:9092",
    starting: str = "latest",
    per_trigger: int | None = None,
) -> DataFrame:
    """Raw records as a ``value`` text column, from a topic or from a folder of text files."""
    if topic is not None:
        reader = (
            spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", starting)
        )
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return reader.load().select(F.col("value").cast("string").alias("value"))
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def stream_source(spark: SparkSession, schema: str = CANONICAL_EVENT, **place) -> DataFrame:
    """JSON records of a stream; records that cannot be read are skipped."""
    good, _ = parse_json_lines(stream_lines(spark, **place), schema)
    return good


def to_messages(df: DataFrame, key: str = "tenant_id", processed_at=None) -> DataFrame:
    """(key, value) messages: the row as JSON, keyed by tenant, with the processor's marks."""
    marked = df.withColumns(
        {
            "processed_at": F.unix_timestamp(F.current_timestamp()).cast("double") if processed_at is None else processed_at,
            "processor_version": F.lit(PROCESSOR_VERSION),
        }
    )
    return marked.select(
        F.coalesce(F.col(key), F.lit("default")).alias("key"), F.to_json(F.struct(*marked.columns)).alias("value")
    )


def stream_sink(
    df: DataFrame, checkpoint: str, topic: str | None = None, path: str | None = None,
    servers: str = "localhost:9092", form: str = "parquet", once: bool = False, every: str = "10 seconds",
) -> DataStreamWriter:
    """A writer of a streaming frame: to a topic as messages, or to files.  Call ``start()`` on it."""
    if topic is not None:
        writer = to_messages(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    else:
        writer = df.writeStream.format(form).option("path", path)
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger)
