"""Bounded samples of labelled rows and small models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def labelled(labels: DataFrame, label: str, rows: int | None, fold: int | None = None,
             only: int | None = None) -> DataFrame:
    """At most ``rows`` (doc_id, y), the smallest by a hash of doc_id, one for each doc_id; all without ``rows``.

    Rows with a null doc_id or label are left out; of contradicting labels the larger
    counts. ``fold``: leave out ids with this remainder of crc32(doc_id) by 5. ``only``: of this y.
    """
    out = labels.where("doc_id is not null").where(F.col(label).isNotNull())
    if fold is not None:
        out = out.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != fold)
    out = out.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    out = out if only is None else out.where(F.col("y") == only)
    return out if rows is None else out.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method with a ridge penalty.

    With one class or no rows the weights are 0 and the intercept is the smoothed log odds.
    """
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(np.unique(y)) < 2:
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty),
                               x1.T @ (p - y) + penalty * w)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log odds."""
    return x @ w[:-1] + w[-1]
