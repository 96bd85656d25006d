"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are the words of a text and their prefixes of four to six bytes, with
value log(1 + occurrences). For grades 0 < 1 < ... < K one weight vector is
shared by all thresholds: P(grade >= k) = sigmoid(w.x - t_k), t_1 < t_2 < ...;
the expected severity is the sum of these over k.

The labels mark toxic or not; the severity grades of toxic training rows are
taken from the occurrences of tell-tale features: grade 1 up to the median of
the toxic rows, grade 2 above. Real grades may be given instead.

A model is fitted on a bounded sample of labelled rows, chosen by a hash of the
key, less near copies (rows that share the least hash of their 3-word shingles):
copies would pass the chance words of one text for tell-tale ones. Scoring reads
whole texts and all rows.

Nulls and edge cases: null and empty texts have the severity of a text without
any feature. Rows without a key or label aren't learnt from; a key with several
labels counts with the highest. Without training rows of two grades nothing is
toxic and severity is 0. Repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import bounded_sample, stored, text_udf

#: Labelled rows that a model is fitted on, about.
TRAIN_ROWS = 12_000
#: A tell-tale feature occurs in so many toxic training rows, and hardly elsewhere; in fewer rows where few are toxic.
LEAST_ROWS = 8
LEAST_PRECISION = 0.7
PREFIXES = (4, 5, 6)
MEMO_LIMIT = 300_000

_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_WORDS).split()


def features_of(word: bytes) -> list[bytes]:
    """The word, and its prefixes marked by a space that no word holds."""
    return [word, *(word[:n] + b" " for n in PREFIXES if len(word) >= n)]


def _copy_key(words: list[bytes]) -> int:
    return min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


class Model:
    """``weights`` by feature; ``thresholds`` ascending, one for each grade from 1."""

    def __init__(self, weights: dict[bytes, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self._seen: dict[bytes, bool] = {}

    def counts(self, words: list[bytes]) -> Counter:
        """Occurrences of the features that the model has."""
        weights, seen = self.weights, self._seen
        kinds = set(words)
        fresh = kinds.difference(seen)
        if len(seen) + len(fresh) > MEMO_LIMIT:
            seen.clear()
            fresh = kinds
        for word in fresh:
            seen[word] = any(f in weights for f in features_of(word))
        hot = {w for w in kinds if seen[w]}
        out: Counter = Counter()
        if hot:
            for word, n in Counter(w for w in words if w in hot).items():
                for f in features_of(word):
                    if f in weights:
                        out[f] += n
        return out

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        if not self.thresholds:
            return np.zeros(1)
        found = self.counts(words_of(text))
        x = sum(self.weights[f] * np.log1p(n) for f, n in sorted(found.items()))
        return 1 / (1 + np.exp(np.array(self.thresholds) - x))

    def score(self, text: str | None) -> dict:
        p = self.at_least(text)
        grade = int((p >= 0.5).sum())
        return {"severity": float(p.sum()), "p_toxic": float(p[0]), "grade": grade, "toxic": grade > 0}


def least_rows(toxic: int) -> int:
    """Rows that a feature must occur in, of so many toxic rows: an eighth of them, from 1 to LEAST_ROWS."""
    return min(LEAST_ROWS, max(1, -(-toxic // LEAST_ROWS)))


def _tell_tale(rows: DataFrame, toxic: int) -> list[bytes]:
    """Features that mark toxic training rows: counted in those rows first, then the candidates in the others."""

    def kinds():
        return lambda texts: [sorted({f for w in set(words_of(t)) for f in features_of(w)}) for t in texts]

    held = text_udf(kinds, T.ArrayType(T.BinaryType()))
    inside = rows.where("grade > 0").select(F.explode(held("text")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("hit"))
    found = {bytes(r["f"]): r["hit"] for r in inside.where(F.col("hit") >= least_rows(toxic)).collect()}  # bounded by the sample
    shared = rows.sparkSession.sparkContext.broadcast(set(found))

    def candidates():
        known = shared.value
        return lambda texts: [sorted(known & {f for w in set(words_of(t)) for f in features_of(w)}) for t in texts]

    held = text_udf(candidates, T.ArrayType(T.BinaryType()))
    outside = rows.where("grade = 0").select(F.explode(held("text")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("miss"))
    missed = {bytes(r["f"]): r["miss"] for r in outside.collect()}
    good = [(n, f) for f, n in found.items() if n >= LEAST_PRECISION * (n + missed.get(f, 0))]
    return [f for _, f in sorted(good, key=lambda x: (-x[0], x[1]))]


def solve(matrix: list[list[tuple[int, float]]], grades: np.ndarray, n: int, ridge: float = 1e-5, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least ridge-penalised cumulative-link loss, by Adam steps on the whole sample."""
    k = int(grades.max())
    row = np.repeat(np.arange(len(matrix)), [len(r) for r in matrix])
    column = np.array([f for r in matrix for f, _ in r], int)
    value = np.array([v for r in matrix for _, v in r])
    w, gaps = np.zeros(n), np.r_[1.0, np.zeros(k - 1)]  # t_1, then logs of the distances
    moments = np.zeros((2, n + k))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    every = np.arange(len(grades))
    for step in range(1, rounds + 1):
        t = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
        x = np.bincount(row, w[column] * value, len(grades))
        above = np.c_[np.ones(len(x)), sigmoid(x[:, None] - t), np.zeros(len(x))]  # P(grade >= 0 .. k + 1)
        p = np.maximum(above[every, grades] - above[every, grades + 1], 1e-9)
        slope = above * (1 - above)
        low, high = slope[every, grades] / p, slope[every, grades + 1] / p
        d_x = -(low - high) / len(x)
        d_t = np.zeros(k)
        np.add.at(d_t, grades[grades > 0] - 1, low[grades > 0] / len(x))
        np.add.at(d_t, grades[grades < k], -high[grades < k] / len(x))
        d_gaps = np.cumsum(d_t[::-1])[::-1] * np.r_[1.0, np.exp(gaps[1:])]
        grad = np.r_[np.bincount(column, d_x[row] * value, n) + ridge * w, d_gaps]
        moments = np.stack([0.9 * moments[0] + 0.1 * grad, 0.99 * moments[1] + 0.01 * grad**2])
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, gaps = w - move[:n], gaps - move[n:]
    return w, np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", grade: str | None = None, at_most: int = TRAIN_ROWS
) -> Model:
    """Fit on about ``at_most`` labelled rows. ``grade`` names a column of real grades, if labels has one."""
    marks = labels.select(F.col(key).alias("k"), F.col(grade or toxic).cast("int").alias("grade")).where("k is not null and grade is not null")
    marks = marks.groupBy("k").agg(F.max("grade").alias("grade"))
    chosen = bounded_sample(marks, "k", at_most)
    train = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")

    def copies():
        return lambda texts: [_copy_key(words_of(t)) for t in texts]

    train = stored(train.withColumn("copy", text_udf(copies, T.LongType())("text")), "toxicity-train")
    # of copies the row of the smallest key: one number a copy is shuffled, after partial sums, and no text
    kept = train.groupBy("copy", "grade").agg(F.min("k").alias("k"))
    rows = stored(train.join(F.broadcast(kept), ["copy", "grade", "k"], "left_semi"), "toxicity-rows")
    sizes = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(sizes) < 2:
        return Model({}, [])
    names = _tell_tale(rows, sum(n for g, n in sizes.items() if g > 0))
    if not names:
        return Model({}, [])
    probe = Model(dict.fromkeys(names, 1.0), [0.0])
    shared = rows.sparkSession.sparkContext.broadcast(probe)
    place = {f: i for i, f in enumerate(names)}

    def sparse():
        model = shared.value

        def one(text):
            found = sorted((place[f], n) for f, n in model.counts(words_of(text)).items())
            return {"f": [i for i, _ in found], "n": [n for _, n in found]}

        return lambda texts: [one(t) for t in texts]

    kind = T.StructType([T.StructField("f", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    found = rows.select("k", "grade", text_udf(sparse, kind)("text").alias("x")).orderBy("k").collect()  # bounded by the sample
    grades = np.array([r["grade"] for r in found])
    if grade is None:
        hits = np.array([sum(r["x"]["n"]) for r in found])
        grades = np.where(grades > 0, 1 + (hits > np.median(hits[grades > 0])), 0)
    matrix = [[(f, float(np.log1p(n))) for f, n in zip(r["x"]["f"], r["x"]["n"])] for r in found]
    weights, thresholds = solve(matrix, grades, len(names))
    return Model({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, thresholds.tolist())


SCORE = T.StructType(
    [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds the struct ``out``: expected severity, p_toxic = P(grade >= 1), the grade and whether it is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights, model.thresholds))

    def make():
        model = shared.value
        return lambda texts: [model.score(t) for t in texts]

    return docs.withColumn(out, text_udf(make, SCORE)(F.col(text)))
