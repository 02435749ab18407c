"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled document of quality 1 is preferred to one of quality 0. With a document's strength linear in the features of its
text, the chance that it is preferred is the logistic function of the difference of strengths, so the weights minimise the
logistic loss on feature differences (Newton steps, ridge penalty). The strength that separates the classes is a quantile of
the strengths of the training documents: the one with the best balanced accuracy. ``score`` maps strengths to 0..1 by
a logistic curve that passes ``CUT`` at that quantile.

Fitting takes at most ``SAMPLE`` labelled documents, those with the smallest hash of their id; their features (a few kB a
thousand) are all that reaches the driver. Scoring is one pass over the text column in Arrow batches, without shuffle.

Features come from the text alone: shares of classes of bytes, word lengths, repetition of words and lines. An empty or null
text has the features of an empty string and is scored; so are texts of any length, whole. Labels that are null or stand for no document
are ignored; an id with several labels takes the greatest. A labelled id with several rows is one training document (the row with the
least features), so the driver gets ``SAMPLE`` rows at most; in scoring, repeated rows and null ids are rows of their own with
equal scores for equal texts. Equal strengths are equal scores; a score of ``CUT`` itself is accepted. Without documents of both
labels every score is 0.5. An empty table gives no rows. Other columns are kept; ones named like the score and prediction are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SAMPLE = 20_000
PAIRS = 200_000
RIDGE = 1e-3
CUT = 0.3
STEPS = 30
SEED = 11


def _class_table() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, line end, sentence mark, ``!``, other marks, lead byte, tail byte, control."""
    out = np.full(256, 10, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[32, 9]] = 3
    out[[10, 13]] = 4
    for c in range(33, 127):
        if out[c] == 10:
            out[c] = 7
    out[[ord("."), ord(","), ord("?"), ord(";"), ord(":")]] = 5
    out[ord("!")] = 6
    out[0xC0:] = 8
    out[0x80:0xC0] = 9
    return out


CLASSES = _class_table()
N_CLASSES = 11
N_FEATURES = N_CLASSES + 8


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text."""
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts, strict=True):
        n = len(text)
        share = np.zeros(N_CLASSES)
        if n:
            share = np.bincount(CLASSES, weights=np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256), minlength=N_CLASSES)
            share /= n
        words = text.split()
        k = len(words)
        lines = [x for x in text.split(b"\n") if x]
        row[:N_CLASSES] = np.sqrt(share)
        row[N_CLASSES:] = (
            np.log1p(k),
            n / (k + 1) / 10,
            len(set(words)) / (k + 1),
            sum(map(eq, words, words[1:])) / (k + 1),
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            np.log1p(n / (len(lines) + 1)),
            k < 5,
            np.log1p(max(map(len, words), default=0)),
        )
    return out


@dataclass(frozen=True)
class Model:
    """Weights over standardised features, and the strength at which the score is ``CUT``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        # Row by row: a matrix product's last bits depend on where in a batch a row stands.
        return ((x - self.mean) / self.scale * self.weights).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = np.clip(self.slope * (self.strengths(x) - self.threshold) + np.log(CUT / (1 - CUT)), -700, 700)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """A model from features and labels (0 or 1)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = d.T @ p / pairs - RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cuts = np.quantile(s, np.arange(1, 2000) / 2000)
    balanced = [np.mean(s[good] >= c) + np.mean(s[bad] < c) for c in cuts]
    best = np.flatnonzero(np.isclose(balanced, max(balanced)))
    threshold = float(cuts[best[0]] + cuts[best[-1]]) / 2
    spread = float(np.std(s)) or 1.0
    return Model(mean, scale, w, threshold, 2.0 / spread)


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled documents for which ``use`` (over ``doc_id``) holds."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .where(use)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .select(F.col("doc_id").alias("labelled_id"), "label")
    )
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("labelled_id")).select("t", "label", "d")

    def measure(batches):
        for b in batches:
            x = features([v or b"" for v in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "d"])

    # Every kind of id has an order; the least features of an id are one row of it.
    measured = rows.mapInArrow(measure, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType()), T.StructField("d", docs.schema[doc_id].dataType)]))
    got = measured.groupBy("d").agg(F.min("x").alias("x"), F.first("y").alias("y")).select("x", "y").toArrow()
    if not got.num_rows:
        return np.zeros((0, N_FEATURES)), np.zeros(0)
    x, y = np.stack(got.column("x").to_numpy(zero_copy_only=False)), np.asarray(got.column("y"))
    order = np.lexsort((*x.T, y))  # the fit then does not depend on the order in which tasks ended
    return x[order], y[order]


def score_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted", cut: float = CUT) -> DataFrame:
    """All rows and columns of ``docs`` with their score and prediction."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def judge(t: pd.Series) -> pd.Series:
        return pd.Series(model.scores(features([b"" if v is None else v for v in t])))

    out = docs.withColumn(score, judge(F.col(text).cast("binary")))
    return out.withColumn(predicted, (F.col(score) >= cut).cast("int"))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds
