"""Window features of a stream without keyed state: micro-batches over a stored tail of rows.

The stateful jobs order a key's rows of one micro-batch in one task.  Where a single user may
fill a micro-batch, this form spreads it: each batch runs the sliced batch operators over its
rows and the rows of earlier batches that can still matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.casts import seconds_to_micros
from wardline.operators.behavior import CHAIN_SPAN, recommended_response, suspicious_chain
from wardline.operators.scoring import risk_score
from wardline.operators.slices import newest
from wardline.operators.stream_features import (
    ADDRESS_RING,
    LOGIN_SPAN,
    REQUEST_SPAN,
    cold_start_score,
    stream_features,
    user_behavior_score,
)
from wardline.session import stored

Sink = Callable[[DataFrame, int], None]


def _tail_before(spark: SparkSession, folder: str, schema, batch_id: int) -> DataFrame | None:
    """The rows kept by the batch before ``batch_id``; a repeated batch finds the same ones."""
    if batch_id == 0:
        return None
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch_id - 1}")


def score_batches(
    folder: str,
    sink: Sink,
    login_span: float = LOGIN_SPAN,
    request_span: float = REQUEST_SPAN,
    chain_span: float = CHAIN_SPAN,
    predict: Callable[[DataFrame, int], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that scores a batch and gives it to ``sink(scored, batch_id)``.

    ``predict(featured, batch_id)`` adds ``ml_score``; without it the score before any learning is taken.

    Kept for the next batch in ``folder`` (a shared one): rows within the longest window of the
    latest event, and each user's last rows that fill the address ring.
    """
    span = seconds_to_micros(max(login_span, request_span, chain_span))

    def handle(batch: DataFrame, batch_id: int) -> None:
        tail = _tail_before(batch.sparkSession, folder, batch.schema, batch_id)
        fresh = batch.withColumn("_fresh", F.lit(True))
        whole = fresh if tail is None else fresh.unionByName(tail.withColumn("_fresh", F.lit(False)))
        rows = stored(whole)
        featured = suspicious_chain(
            stream_features(rows, login_span=login_span, request_span=request_span), span=chain_span
        )
        responded = recommended_response(featured.filter("_fresh").drop("_fresh"))
        modelled = responded.withColumn("ml_score", cold_start_score()) if predict is None else predict(responded, batch_id)
        sink(risk_score(modelled.withColumn("user_behavior_score", user_behavior_score())), batch_id)
        latest = rows.agg(F.max("at")).first()[0]
        plain = rows.drop("_fresh")
        if latest is not None:
            ring = newest(plain.filter(F.col("at") < latest - span), ["user_name"], "at", ["seq"], ADDRESS_RING)
            plain = plain.filter(F.col("at") >= latest - span).unionByName(ring)
        plain.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return handle
