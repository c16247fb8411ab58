"""Cells of vectors around centres fitted on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors that centres are fitted on, at most (those with the least hash of their key), and centres of one level, at most.
SAMPLE, MOST_CELLS = 4096, 64


def finite(column: str) -> Column:
    """Whether an array is there, not empty, and holds finite numbers only."""
    good = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(column) > 0) & good, F.lit(False))


def centres(vectors: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample; deterministic."""
    if k <= 1 or len(vectors) <= k:
        return vectors[: max(1, k)] if len(vectors) else np.zeros((0, 0))
    own = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(vectors @ own.T - 0.5 * (own**2).sum(axis=1), axis=1)
        for c in range(k):
            members = vectors[near == c]
            if len(members):
                own[c] = members.mean(axis=0)
    return own


def nearest(vectors: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each vector, nearest first."""
    near = vectors @ own.T - 0.5 * (own**2).sum(axis=1)
    k = min(k, own.shape[0])
    part = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)
