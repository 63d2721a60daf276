"""A toxicity classifier with counterfactual regularisation.

Logistic regression over hashed words and word beginnings. Each labelled text that names a group is also
read with the group swapped for another, and the change of its score is penalised, so that naming a group
carries no weight of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.shared import ready_python

#: Terms of one line are swapped for each other, in singular and plural apart.
IDENTITY_TERMS = (
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("girls", "boys"),
    ("christian", "muslim", "jew", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christianity", "islam", "judaism", "hinduism", "buddhism", "atheism"),
    ("black", "white", "asian", "latino", "arab"),
    ("blacks", "whites", "asians", "latinos", "arabs"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("africans", "europeans", "americans", "mexicans", "indians"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("gays", "lesbians"),
    ("immigrant", "refugee", "foreigner"),
    ("immigrants", "refugees", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
)

DIMENSIONS = 1 << 17
BEGINNINGS = (4, 5, 6)
#: Labelled rows the model is fitted on: those of the lowest hash of the text.
FIT_ROWS = 8000
#: Features of fewer fitted rows carry no weight.
LEAST_ROWS = 8
SCALE = 0.2
ROUNDS, RATE, RIDGE, FAIRNESS = 150, 0.1, 1e-4, 1.0
#: Words whose features a worker remembers (about 350 bytes each); it only saves time.
MEMO_WORDS = 80_000
_WORD = re.compile(r"\w+")
_memo: dict[str, tuple[int, ...]] = {}


def _features(word: str) -> tuple[int, ...]:
    known = _memo.get(word)
    if known is None:
        names = [word] + [f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]
        known = tuple(zlib.crc32(name.encode("utf-8", "replace")) % DIMENSIONS for name in names)
        if len(_memo) < MEMO_WORDS and len(word) <= 40:
            _memo[word] = known
    return known


def counted(text: str | None) -> Counter:
    """Words of the whole text in lower case, with their counts."""
    return Counter(_WORD.findall((text or "").lower()))


def vector(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features with the logarithm of their counts; none for a text without words."""
    totals: dict[int, int] = {}
    for word, n in words.items():
        for i in _features(word):
            totals[i] = totals.get(i, 0) + n
    at = np.fromiter(totals, np.int32, len(totals))
    values = SCALE * np.log1p(np.fromiter(totals.values(), np.float64, len(totals)))
    return at, values.astype(np.float32)


def swaps(lines: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each term of a line with the next one; the last with the first, so that a line's terms are all tied."""
    return {term: line[(n + 1) % len(line)] for line in lines for n, term in enumerate(line) if len(line) > 1}


def swapped(words: Counter, of: dict[str, str]) -> Counter | None:
    """The counts after each identity term is swapped for the next of its line; None without such a term."""
    terms = [w for w in words if w in of]
    if not terms:
        return None
    out = Counter({w: n for w, n in words.items() if w not in of})
    for word in terms:
        out[of[word]] += words[word]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, values = vector(counted(text))
        return float(1 / (1 + np.exp(-(self.bias + self.weights[at] @ values))))


class Rows:
    """Sparse rows end to end, in blocks, so that sums over them need little memory beside."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> None:
        self.size = len(vectors)
        self.blocks = []
        for start in range(0, len(vectors), block):
            part = vectors[start : start + block]
            row = np.repeat(np.arange(len(part), dtype=np.int32), [len(at) for at, _ in part])
            self.blocks.append((np.concatenate([at for at, _ in part]), np.concatenate([v for _, v in part]), row, len(part)))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, weights[at] * values, n) for at, values, row, n in self.blocks] or [np.zeros(0)])

    def back(self, errors: np.ndarray) -> np.ndarray:
        out, start = np.zeros(DIMENSIONS), 0
        for at, values, row, n in self.blocks:
            out += np.bincount(at, errors[start : start + n][row] * values, DIMENSIONS)
            start += n
        return out

    def counts(self) -> np.ndarray:
        """Rows that have each feature."""
        return sum((np.bincount(at, minlength=DIMENSIONS) for at, *_ in self.blocks), np.zeros(DIMENSIONS, int))


def fit(rows: list[tuple], labels: list[int], pairs: list[tuple], fairness: float = FAIRNESS) -> Model:
    """Fit on row vectors with labels 0 and 1, and on (row, swapped row) vector pairs.

    The loss is the mean logistic loss, a ridge, and ``fairness`` times the mean squared change of the
    logit between the two of a pair. With labels of one class only, or none, the score is their mean.
    """
    share = float(np.mean(labels)) if labels else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(DIMENSIONS), 40.0 if share else -40.0)
    x, y = Rows(rows), np.asarray(labels, float)
    common = x.counts() >= LEAST_ROWS
    one, other = Rows([p for p, _ in pairs]), Rows([q for _, q in pairs])
    weights, bias = np.zeros(DIMENSIONS), float(np.log(share / (1 - share)))
    mean, spread = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for step in range(1, ROUNDS + 1):
        errors = (1 / (1 + np.exp(-(x.times(weights) + bias))) - y) / x.size
        slope = np.append(x.back(errors) + RIDGE * weights, errors.sum())
        if pairs:
            change = 2 * fairness * (one.times(weights) - other.times(weights)) / one.size
            slope[:-1] += one.back(change) - other.back(change)
        slope[:-1] *= common
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(weights, float(bias))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_rows: int = FIT_ROWS, fairness: float = FAIRNESS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> Model:
    """Fit on the ``fit_rows`` different labelled texts of the lowest hash.

    ``terms`` has lines of words, in lower case, that name groups; give the groups of the corpus here where the
    built-in lines don't have them. A text without any of them is learnt from, but has no pair.

    ``labels`` has (key, label) of the rows to learn from; those without a label 0 or 1, or without a
    document, are left out, and copies with the same label count once. Hashes are chosen by keys alone;
    then the chosen texts become hashed vectors in Spark's tasks, and only those reach the driver.
    """
    ready_python(docs.sparkSession)
    next_term = swaps(terms)

    @F.pandas_udf("at binary, value binary, other_at binary, other_value binary")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = counted(t)
            at, value = vector(words)
            other = swapped(words, next_term)
            other_at, other_value = vector(other) if other is not None else (None, None)
            out.append((at.tobytes(), value.tobytes(), *(None if v is None else v.tobytes() for v in (other_at, other_value))))
        return pd.DataFrame(out, columns=["at", "value", "other_at", "other_value"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    marks = rows.select("key", "mark").join(known, "key").groupBy("mark", "label").agg(F.min("key").alias("key"))
    few = marks.orderBy("mark", "label").limit(fit_rows)
    # At most fit_rows rows of three numbers are broadcast; a key may come more than once, so its text counts too.
    chosen = rows.join(F.broadcast(few), ["key", "mark"]).select("mark", "label", vectors("text").alias("v"))
    found = chosen.select("mark", "label", "v.*").dropDuplicates(["mark", "label"]).collect()
    found.sort(key=lambda r: (r.mark, r.label))

    def pair(at: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(at, np.int32), np.frombuffer(value, np.float32)

    own = [pair(r.at, r.value) for r in found]
    pairs = [(x, pair(r.other_at, r.other_value)) for x, r in zip(own, found) if r.other_at is not None]
    return fit(own, [r.label for r in found], pairs, fairness)


def scores(spark: SparkSession, text: Column, model: Model) -> Column:
    """A column with the score of each whole text, 0 to 1; null and empty texts get the model's bias."""
    ready_python(spark)
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS doubles: 1 MB

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t) for t in texts], dtype=float)

    return score(text)


def held_out(key: str = "doc_id") -> Column:
    """Rows that the model must not learn from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))

