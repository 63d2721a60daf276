"""Online learning in micro-batches: predict, then one gradient step, versioned and rolled back on drift.

The state is a handful of numbers per feature.  A batch changes it through sums and counts
only; the last hundred prediction errors are kept for the drift check.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.drift import BASELINE_ROWS, MARGIN, RECENT_ROWS
from wardline.operators.slices import newest
from wardline.operators.stream_features import FEATURE_ORDER, cold_start_score


@dataclass
class OnlineState:
    features: list[str] = field(default_factory=lambda: list(FEATURE_ORDER))
    count: float = 0.0
    mean: list[float] = field(default_factory=list)
    square: list[float] = field(default_factory=list)  # sum of squared deviations
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    steps: int = 0
    version: int = 1
    errors: list[float] = field(default_factory=list)  # the last ones, oldest first
    stable: dict | None = None
    drift_detected: bool = False

    @property
    def ready(self) -> bool:
        return self.count > 0

    def scales(self) -> list[float]:
        deviations = [(s / self.count) ** 0.5 if self.count else 1.0 for s in self.square]
        return [d if d > 0 else 1.0 for d in deviations]


def _scaled(state: OnlineState) -> list[Column]:
    return [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
        for c, m, s in zip(state.features, state.mean, state.scales())
    ]


def online_predict(df: DataFrame, state: OnlineState) -> DataFrame:
    """Adds ``ml_score``, ``predicted_label``, ``ml_prediction`` and ``model_version``."""
    if not state.ready:
        score = cold_start_score()
    else:
        margin = F.lit(state.bias)
        for weight, value in zip(state.weights, _scaled(state)):
            margin = margin + value * F.lit(weight)
        score = F.bround(1.0 / (1.0 + F.exp(-margin)), 4)
    scored = df.withColumn("ml_score", score)
    return scored.withColumns(
        {
            "predicted_label": (F.col("ml_score") >= 0.5).cast("int"),
            "ml_prediction": F.when(F.col("ml_score") >= 0.5, "anomaly").otherwise("normal"),
            "model_version": F.lit(state.version),
        }
    )


def _is_drift(errors: list[float]) -> bool:
    base, late = errors[-BASELINE_ROWS:], errors[-RECENT_ROWS:]
    if len(base) < max(10, BASELINE_ROWS // 2) or len(late) < max(5, RECENT_ROWS // 2):
        return False
    return sum(late) / len(late) > sum(base) / len(base) + MARGIN


def online_update(
    batch: DataFrame, state: OnlineState, label: str = "label", rate: float = 0.5, at: str = "at", tie: str = "seq"
) -> OnlineState:
    """The state after a labelled batch: running scaler, one averaged gradient step, version or rollback."""
    names = state.features
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}
    moments = batch.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(values[c]).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.var_pop(values[c]).alias(f"v{i}") for i, c in enumerate(names)],
    ).first()
    if not moments["n"]:
        return state
    fresh = OnlineState(**{**asdict(state), "features": names})
    n, old = float(moments["n"]), state.count
    total = n + old
    fresh.mean, fresh.square = [], []
    for i, _ in enumerate(names):
        before_mean = state.mean[i] if state.ready else 0.0
        before_square = state.square[i] if state.ready else 0.0
        shift = moments[f"m{i}"] - before_mean
        fresh.mean.append(before_mean + shift * n / total)
        fresh.square.append(before_square + moments[f"v{i}"] * n + shift * shift * n * old / total)
    fresh.count = total
    fresh.weights = list(state.weights) if state.ready else [0.0] * len(names)

    # Prediction comes before learning: errors are those of the old state.
    judged = online_predict(batch, state).withColumn(
        "_wrong", (F.col("predicted_label") != F.col(label).cast("int")).cast("double")
    )
    tail = newest(judged.select(at, tie, "_wrong"), [], at, [tie], BASELINE_ROWS).orderBy(at, tie).collect()
    fresh.errors = (list(state.errors) + [row["_wrong"] for row in tail])[-BASELINE_ROWS:]

    scaled = _scaled(fresh)
    margin = F.lit(fresh.bias)
    for weight, value in zip(fresh.weights, scaled):
        margin = margin + value * F.lit(weight)
    slope = 1.0 / (1.0 + F.exp(-margin)) - F.col(label).cast("double")
    gradient = batch.agg(
        F.avg(slope).alias("b"), *[F.avg(slope * value).alias(f"g{i}") for i, value in enumerate(scaled)]
    ).first()
    pace = rate / (1.0 + 0.01 * fresh.steps)
    fresh.weights = [w - pace * gradient[f"g{i}"] for i, w in enumerate(fresh.weights)]
    fresh.bias = fresh.bias - pace * gradient["b"]
    fresh.steps += 1

    fresh.drift_detected = state.ready and _is_drift(fresh.errors)
    if fresh.drift_detected and state.stable is not None:
        back = OnlineState(**{**state.stable, "stable": state.stable})
        back.errors, back.drift_detected = fresh.errors, True
        return back
    if not fresh.drift_detected:
        if state.ready:
            fresh.version = state.version + 1
        fresh.stable = {**asdict(fresh), "stable": None}
    return fresh


class ModelStore:
    """Versions of the online model in a folder, and a pointer to those that count.

    Each batch leaves its version in a folder of its own. The pointer says which version serves and which is the last one
    learnt; it is a small file that is replaced by renaming, so a reader finds the old one or the new one. A model that
    drifts is rolled back by pointing at the version that was stable. Readers open the pointer and two versions at
    most, however many there are.
    """

    POINTER = "pointer.json"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def pointer(self) -> dict | None:
        place = self._place(self.POINTER)
        if not place.getFileSystem(self._conf).exists(place):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(place.toString()).collect()))

    def _version(self, batch_id: int) -> OnlineState:
        row = self.spark.read.schema("batch_id bigint, state string").json(f"{self.path}/batch={batch_id}").first()
        return OnlineState(**json.loads(row["state"]))

    def newest(self, before: int | None = None) -> OnlineState:
        """The version that serves, with the errors of the last one; as it was before batch ``before``, or a fresh one."""
        pointer = self.pointer()
        while pointer and before is not None and pointer["last"] >= before:
            pointer = pointer["earlier"]
        if not pointer:
            return OnlineState()
        state = self._version(pointer["serves"])
        if pointer["last"] != pointer["serves"]:
            last = self._version(pointer["last"])
            state.errors, state.drift_detected = last.errors, last.drift_detected
        state.stable = {**asdict(state), "stable": None}
        return state

    def publish(self, state: OnlineState, batch_id: int) -> None:
        """Store the version of a batch and point at it, or after drift at the version that served before."""
        save_state(self.spark, state, self.path, batch_id)
        earlier = self.pointer()
        while earlier and earlier["last"] >= batch_id:
            earlier = earlier["earlier"]
        serves = earlier["serves"] if state.drift_detected and earlier else batch_id
        # One step back is enough to repeat the last batch.
        kept = {**earlier, "earlier": None} if earlier else None
        self._replace(json.dumps({"serves": serves, "last": batch_id, "version": state.version, "earlier": kept}))

    def _replace(self, text: str) -> None:
        draft, place = self._place(f".pointer-{uuid.uuid4().hex}"), self._place(self.POINTER)
        stream = place.getFileSystem(self._conf).create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        gateway = self.spark.sparkContext._gateway
        rename = getattr(self._fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, place, options)


def save_state(spark: SparkSession, state: OnlineState, path: str, batch_id: int) -> None:
    """One JSON row per batch, in a folder of its own: a repeated batch overwrites only itself."""
    spark.createDataFrame([(batch_id, json.dumps(asdict(state)))], "batch_id bigint, state string").write.mode(
        "overwrite"
    ).json(f"{path}/batch={batch_id}")


def load_state(spark: SparkSession, path: str, before: int | None = None) -> OnlineState:
    """The state that serves (as it was before batch ``before``), or a fresh one."""
    return ModelStore(spark, path).newest(before)


def learn_batches(path: str, label: str = "label", rate: float = 0.5, sink=None):
    """A ``foreachBatch`` function that scores with the newest state, then learns and stores.

    ``sink(scored, batch_id)`` gets the scored batch.  A repeated batch starts from the state
    before it, so a restart gives the same result.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = ModelStore(spark, path)
        state = store.newest(batch_id)
        held = batch.persist()
        if sink is not None:
            sink(online_predict(held, state), batch_id)
        store.publish(online_update(held, state, label, rate), batch_id)
        held.unpersist()

    return handle
