"""Labelled rows and the calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded


def held_out(id_: str, mod: int, rest: int):
    return F.pmod(F.crc32(F.col(f"`{id_}`").cast("string")), F.lit(mod)) == rest


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_: str, text: str, train, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, __t, y (0 or 1) of the labelled rows that `train` (a condition on id_) admits. A document with several
    labels has the highest; null labels are none. The labels are broadcast while they are few, else the join shuffles."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    own = docs.where(train).select(F.col(f"`{id_}`").alias("doc_id"), F.col(f"`{text}`").alias("__t"))
    return own.join(bounded(y, broadcast_rows), F.col("doc_id") == F.col("__id")).select("doc_id", "__t", "y")


def some_rows(rows: DataFrame, most: int, n: int) -> DataFrame:
    """Of n rows those of smallest hash of id and text (column __h), at least `most` of them in all likelihood and few more:
    a cut on the hash, so that texts needn't be sorted. Who takes `most` of them in the order of __h gets the same rows
    each time; rows of one hash are the same."""
    rows = rows.withColumn("__h", F.xxhash64("doc_id", "__t"))
    share = 1.5 * most / max(1, n) + 1000 / max(1, n)
    return rows if share >= 1 else rows.where(F.col("__h") < int(share * 2**64) - 2**63)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last one is the constant) of a ridge logistic regression, by Newton steps with halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (keep * w * w).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step, old = np.linalg.solve(h, g), loss(w)
        for _ in range(20):
            if loss(w - step) <= old:
                break
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))
