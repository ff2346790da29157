"""Vectors of a table: checks, double precision, a bounded sample, spherical k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: Column) -> Column:
    """True for vectors that are not null, not empty, not zero and hold finite numbers only."""
    x = col.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(col.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def sample(df: DataFrame, col: str, most: int, seed: int = 7) -> np.ndarray:
    """``most`` vectors at most: those whose content has the smallest hash, each distinct one once, in a fixed order.

    Equal vectors are one, whatever their ids, so a hot group of copies neither
    fills the sample nor leaves it empty. A range of hashes that should hold
    ``most`` is tried first; only where copies leave it too thin, the smallest of
    all hashes are taken.
    """
    hashed = df.select(F.xxhash64(F.lit(seed), col).alias("_h"), F.col(col).alias("_x"))
    n = df.count()
    if n > most:
        span = 1 << 30
        few = hashed.where(F.pmod("_h", F.lit(span)) < F.lit(int(2 * most / n * span)))
        rows = few.distinct().orderBy("_h", "_x").limit(most).collect()
        if len(rows) >= min(most, 100):
            return np.array([r[1] for r in rows], float)
    rows = hashed.distinct().orderBy("_h", "_x").limit(most).collect()
    return np.array([r[1] for r in rows], float) if rows else np.zeros((0, 0))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors x."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    step = max(1, (1 << 22) // k)  # rows whose products with all centroids are held at once
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + step] @ c.T, axis=1) for i in range(0, len(x), step)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], c)
    return c
