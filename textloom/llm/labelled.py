"""Labelled rows for the trained operators: a bounded, deterministic sample for learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str, parts: int, rest: int) -> Column:
    """Whether crc32(key as text) mod ``parts`` is ``rest``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, text) of at most ``most`` rows of each label, none of them held out.

    The rows are those with the smallest hash of their key, so the choice does not depend
    on order or partitioning.  A key labelled twice takes the smaller label, and of several
    texts the smallest.  Only the chosen keys, at most ``2 * most``, are broadcast.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, parts, rest))
    known = known.groupBy(key).agg(F.min(label).cast("int").alias("label")).filter("label in (0, 1)")
    order = (F.xxhash64(key), F.col(key))
    chosen = known.filter("label = 0").orderBy(*order).limit(most).union(known.filter("label = 1").orderBy(*order).limit(most))
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col(key))
    return found.groupBy("_key").agg(F.first("label").alias("label"), F.min("_text").alias(text)).select("label", text)


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, its targets smoothed as Platt's."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - t * z)).sum() + 5e-4 * (b @ b))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if abs(size * step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])
