"""How far a stream is behind: its progress as rows of metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LAG_ROW = (
    "query string, run_id string, batch_id bigint, at timestamp, input_rows bigint, input_rate double, processed_rate double, "
    "watermark timestamp, latest timestamp, watermark_lag_seconds double, dropped_rows bigint, state_rows bigint"
)
_NAMES = [part.split()[0] for part in LAG_ROW.split(", ")]


def _time(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


def lag_row(progress: dict) -> tuple:
    """The metrics of one progress report (its JSON form).

    The lag is the time between the latest event of the batch and the watermark; null for a batch without events.
    Dropped rows came later than the watermark allows.
    """
    clock = progress.get("eventTime") or {}
    watermark, latest = _time(clock.get("watermark")), _time(clock.get("max"))
    states = progress.get("stateOperators") or []
    return (
        progress.get("name"), progress["runId"], progress["batchId"], _time(progress["timestamp"]), progress.get("numInputRows", 0),
        _rate(progress.get("inputRowsPerSecond")), _rate(progress.get("processedRowsPerSecond")), watermark, latest,
        (latest - watermark).total_seconds() if latest and watermark else None,
        sum(s.get("numRowsDroppedByWatermark", 0) for s in states), sum(s.get("numRowsTotal", 0) for s in states),
    )


def _rate(value: object) -> float | None:
    """Spark reports an endless rate as text."""
    return float(value) if isinstance(value, (int, float)) else None


def lag_rows(spark: SparkSession, progress: Iterable) -> DataFrame:
    """A frame of the reports of a query (``query.recentProgress``), a row each."""
    reports = [p if isinstance(p, dict) else json.loads(p.json) for p in progress]
    return spark.createDataFrame([lag_row(r) for r in reports], LAG_ROW)


class LagListener(StreamingQueryListener):
    """Hands each progress report of every query to ``sink(row)`` as a dictionary of metrics.

    Reports come on the driver, one a batch, so a sink that keeps them keeps little.
    """

    def __init__(self, sink: Callable[[dict], None]) -> None:
        self.sink = sink

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.sink(dict(zip(_NAMES, lag_row(json.loads(event.progress.json)))))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
