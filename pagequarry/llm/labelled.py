"""Labelled rows for the classifiers: fold, bounded samples, and logistic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast


def fold(doc_id: str, folds: int) -> Column:
    """The remainder of CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def held_out(doc_id: str, folds: int, out: int) -> Column:
    """Whether the id falls in the fold that is never learnt from; a null id doesn't."""
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def training_labels(labels: DataFrame, label: str, folds: int, out: int) -> DataFrame:
    """(doc_id, y) of the labelled rows to learn from: label 0 or 1, id known and not held out.

    Of several labels of one id the least counts.
    """
    y = F.col(label).cast("int")
    kept = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out("doc_id", folds, out))
    return kept.groupBy("doc_id").agg(F.min(y).alias("y"))


def sample(learn: DataFrame, y: int, rows: int, salt: str) -> DataFrame:
    """At most ``rows`` training rows of one class, those of the least hashes."""
    key = F.xxhash64(F.col("doc_id"), F.lit(salt))
    return learn.where(F.col("y") == y).orderBy(key, "doc_id").limit(rows)


def with_labels(docs: DataFrame, learn: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, y) of the documents that ``learn`` has."""
    return docs.select("doc_id", F.col(text).alias("text")).join(checked_broadcast(learn), "doc_id")


@dataclass(frozen=True)
class Logistic:
    """A logistic curve over standardised features."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -30, 30)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> Logistic:
    """Fitted by Newton steps; without rows, or with one class only, a constant of 0.5 or that class's rate."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else 0.99 if y[0] else 0.01
        return Logistic(np.zeros(k), np.ones(k), np.array([np.log(p / (1 - p)), *[0.0] * k]))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), np.clip((x - mean) / spread, -30, 30)]
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = (z * (p * (1 - p))[:, None]).T @ z + (1e-6 + ridge * len(x) ** 0.5) * np.eye(k + 1)
        step = np.linalg.solve(slope, z.T @ (y - p) - (1e-6 + ridge * len(x) ** 0.5) * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(mean, spread, w)
