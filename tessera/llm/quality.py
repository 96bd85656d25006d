"""Quality scores by Bradley-Terry pairwise ranking.

Each preference pair is a good and a bad labelled text; the score w.f(text) is
learnt by logistic loss on the pairs' feature differences. Scores are then cut
at a quantile: the share of bad rows among the training rows gives the
threshold, and the published score is the sigmoid of the distance to it.

Features come from whole texts: shares of byte classes, words and lines that
repeat, capitals, lengths. A model is fitted on a bounded sample of labelled
rows, chosen by a hash of the key; all rows are scored.

Nulls and edge cases: null and empty texts have all-zero features and a score
like any other. Rows without a key or label aren't learnt from; a key with
several labels counts with the lowest, one with several texts with one of them. Without both kinds of label every score
is 0.5. Repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import bounded_sample, text_udf

#: Labelled rows that a model is fitted on, about.
TRAIN_ROWS = 8000
#: Pairs drawn for each bad training row.
PAIRS = 40


def features(text: str | None) -> np.ndarray:
    """Byte shares (ASCII one by one, the rest together) and the shape of words and lines."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    shape = [
        upper / max(1, upper + lower),
        marks / n,
        marks / max(1, len(words)),
        counts[48:58].sum() / n,
        1 - len(set(words)) / max(1, len(words)),
        (1 - len(set(words)) / max(1, len(words))) / np.log(2 + len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)),
        np.log1p(len(words)),
        np.log1p(len(data)) - np.log1p(len(words)),
        np.log1p(len(words) / max(1, len(lines))),
        float(len(words) < 5),
    ]
    shares = np.sqrt(np.r_[counts[:128], counts[128:].sum()] / n)
    return np.r_[shape, np.sqrt(np.array(shape[:8]).clip(0)), shares].astype(np.float32)


class Model:
    def __init__(self, weights: np.ndarray | None = None, mean: np.ndarray | None = None, scale: np.ndarray | None = None, cut: float = 0.0):
        self.weights, self.mean, self.scale, self.cut = weights, mean, scale, cut

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """1 for surely good, 0 for surely bad, 0.5 at the threshold."""
        if self.weights is None:
            return np.full(len(rows), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) - self.cut, -40, 40)))


def solve(rows: np.ndarray, good: np.ndarray, ridge: float = 1e-3, rounds: int = 300, seed: int = 7) -> Model:
    """Weights of least ridge-penalised logistic loss on good-minus-bad differences, and the quantile cut."""
    if good.all() or not good.any():
        return Model()
    model = Model(None, rows.mean(0), rows.std(0) + 1e-3)
    z = np.clip((rows - model.mean) / model.scale, -6, 6)
    rng = np.random.default_rng(seed)
    bad_at, good_at = np.flatnonzero(~good), np.flatnonzero(good)
    loser = np.repeat(bad_at, PAIRS)
    winner = rng.choice(good_at, len(loser))
    w, moments = np.zeros(z.shape[1]), np.zeros((2, z.shape[1]))
    for step in range(1, rounds + 1):
        s = z @ w
        push = 1 / (1 + np.exp(np.clip(s[winner] - s[loser], -40, 40))) / len(loser)
        by_row = np.bincount(winner, push, len(z)) - np.bincount(loser, push, len(z))
        grad = ridge * w - by_row @ z
        moments = np.stack([0.9 * moments[0] + 0.1 * grad, 0.99 * moments[1] + 0.01 * grad**2])
        w = w - 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
    model.weights = w
    model.cut = float(np.quantile(z @ w, 1 - good.mean()))
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", at_most: int = TRAIN_ROWS) -> Model:
    """Fit on about ``at_most`` labelled rows."""
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("good")).where("k is not null and good is not null")
    marks = marks.groupBy("k").agg(F.min("good").alias("good"))
    chosen = bounded_sample(marks, "k", at_most)
    train = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")

    def make():
        return lambda texts: [features(t).tobytes() for t in texts]

    # one row a key, whatever repeats: the sample bounds what the driver gets
    held = train.select("k", "good", text_udf(make, T.BinaryType())("text").alias("x")).groupBy("k", "good").agg(F.min("x").alias("x"))
    rows = held.orderBy("k").collect()
    if not rows:
        return Model()
    return solve(np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]), np.array([r["good"] > 0 for r in rows]))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        return lambda texts: model.score(np.stack([features(t) for t in texts])).tolist()

    return docs.withColumn(out, text_udf(make, T.DoubleType())(F.col(text)))
