"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lowered, ASCII characters other than letters become single spaces, and
every window of two to four characters is hashed to one of ``BUCKETS``. Training
sums the buckets' counts by language in Spark; the matrix of log probabilities
(buckets x languages, a fixed number of bytes a language) is broadcast, and the
texts of a batch are scored together as the rows of one sparse matrix: the
batch's buckets gather rows of log probabilities, which are added up by text
and to the log priors, the languages' shares of all labelled rows. The language
is that of the largest posterior. As overlapping windows depend on each other
the posterior is all but 0 or 1; the published score is it tempered, with logs
divided by the root of the number of windows.

Nulls and edge cases: a null text or one without a letter is ``und`` with score
0. Ties go to the language that sorts first. Without a training row everything
is ``und``. Rows without a language, or without a key, are not learnt from.
Repeated rows and other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import label_counts, sample_of, text_udf

BUCKETS = 1 << 16
#: Labelled rows of each language that a model is fitted on, about.
TRAIN_ROWS = 4000
UNKNOWN = "und"

#: Buckets that scoring gathers at once; bounds its memory beside long texts.
GATHERED = 1 << 16

#: ASCII characters by code: letters stay, all others become spaces; the last entry stands for the rest.
_KEPT = np.array([*(c if chr(c).isalpha() else 32 for c in range(128)), 0], np.uint32)


def hashed(text: str) -> np.ndarray:
    """Buckets of all windows of two to four characters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(codes < 128, _KEPT[np.minimum(codes, 128)], codes).astype(np.uint32)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    two = codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) ^ codes[2:]
    four = three[:-1] * np.uint32(0xC2B2AE35) ^ codes[3:]
    return np.concatenate([grams * np.uint32(0x27D4EB2F) >> 16 for grams in (two, three, four)])


class Model:
    def __init__(self, languages: list[str], log_probability: np.ndarray, prior: np.ndarray):
        self.languages, self.log_probability, self.prior = languages, log_probability, prior

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text of a batch."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.languages and t is not None and any(map(str.isalpha, t))]
        for a, b, total, sizes in self._totals([texts[i] for i in rows]):
            logit = total + self.prior
            best = logit.argmax(1)
            logit /= np.sqrt(sizes)[:, None]
            score = 1 / np.exp(logit - logit.max(1, keepdims=True)).sum(1)
            for i, k, p in zip(rows[a:b], best.tolist(), score.tolist()):
                out[i] = (self.languages[k], p)
        return out

    def _totals(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Sums of log probabilities of texts a to b, and their windows; a longer text than GATHERED is summed in parts."""
        at, held, size = 0, [], 0
        for i, text in enumerate(texts):
            held.append(hashed(text))
            size += len(held[-1])
            if size >= GATHERED or i + 1 == len(texts):
                sizes = np.array([len(x) for x in held])
                buckets, ends = np.concatenate(held), np.cumsum(sizes)
                total = np.zeros((len(held), len(self.languages)))
                for lo in range(0, len(buckets), GATHERED):
                    hi = min(lo + GATHERED, len(buckets))
                    first, last = np.searchsorted(ends, [lo, hi - 1], "right")
                    starts = np.maximum(np.r_[0, ends][first : last + 1] - lo, 0)
                    total[first : last + 1] += np.add.reduceat(self.log_probability[buckets[lo:hi]], starts, axis=0, dtype=np.float64)
                yield at, i + 1, total, sizes
                at, held, size = i + 1, [], 0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", at_most: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows, on about ``at_most`` of each language chosen by a hash of the key."""
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("k is not null and lang is not null")
    sizes = label_counts(rows.select("lang"), "lang")
    chosen = sample_of(rows, "k", at_most, "lang", sizes)

    def make():
        def counts(text):
            values, n = np.unique(hashed(text or ""), return_counts=True)
            return [{"b": b, "n": c} for b, c in zip(values.tolist(), n.tolist())]

        return lambda texts: [counts(t) for t in texts]

    kind = T.ArrayType(T.StructType([T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())]))
    counted = chosen.select("lang", F.explode(text_udf(make, kind, rows=16)("text")).alias("c")).groupBy("lang", "c.b").agg(F.sum("c.n").alias("n"))
    found = counted.toPandas()  # at most BUCKETS rows a language
    languages = sorted(sizes)
    table = np.full((BUCKETS, len(languages)), 0.5)
    place = {name: i for i, name in enumerate(languages)}
    np.add.at(table, (found["b"].to_numpy(int), found["lang"].map(place).to_numpy(int)), found["n"].to_numpy(float))
    log_probability = np.log(table / table.sum(0)).astype(np.float32)
    shares = np.array([sizes[name] for name in languages], float)
    return Model(languages, log_probability, np.log(shares / shares.sum()) if languages else shares)


def predicted(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Adds the struct ``out``: lang_pred and score, the tempered posterior of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        return lambda texts: [{"lang_pred": name, "score": p} for name, p in model.predict(texts)]

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.withColumn(out, text_udf(make, kind)(F.col(text)))
