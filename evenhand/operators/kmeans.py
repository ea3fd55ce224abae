"""Standard k-means: a parallel start whose draws can be reproduced, then Lloyd rounds.

The start oversamples in a few passes over the points and picks the centres among these candidates, by their
weights. A draw is a hash of seed, round and coordinates, so the result depends neither on partitioning nor on
the order of rows, and SQL can repeat it.
"""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.centers import MAX_CENTERS, center_table
from evenhand.operators.assignment import assign
from evenhand.operators.rounds import cached, lloyd

# Passes that draw candidates, and how many are expected of each, as a multiple of k.
START_ROUNDS = 2
OVERSAMPLING = 2.0
# Movement of the centres below which standard k-means stops.
TOLERANCE = 1e-4
_DIGITS, _RANGE = 13, float(1 << 52)


def point_key(x: str = "x") -> Column:
    """Text of the coordinates; equal points share it and so their draws."""
    return F.array_join(F.col(x).cast("array<string>"), ",")


def uniform_draw(seed: int, step: int | str, key: Column) -> Column:
    """Number in [0, 1) from the md5 of seed, step and key."""
    text = F.concat(F.lit(f"{seed}|{step}|"), key)
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10)
    return bits.cast("double") / F.lit(_RANGE)


def _draw(seed: int, step: int | str, key: str) -> float:
    """The same number on the driver."""
    return int(hashlib.md5(f"{seed}|{step}|{key}".encode()).hexdigest()[:_DIGITS], 16) / _RANGE


def candidates(
    kept: DataFrame, k: int, seed: int, rounds: int = START_ROUNDS, oversampling: float = OVERSAMPLING
) -> tuple[np.ndarray, list[str]]:
    """Candidate points and their keys: one drawn evenly, then in each round every point with a probability of
    ``oversampling * k`` times its share of the cost that is left."""
    first = kept.select(F.min(F.struct(uniform_draw(seed, 0, point_key()), "x", point_key().alias("key"))).alias("s")).head()
    if first["s"] is None:
        return np.empty((0, 0)), []
    c, keys = np.array([first["s"]["x"]]), [first["s"]["key"]]
    for step in range(1, rounds + 1):
        assigned = assign(kept, c, keep=["x"])
        cost = assigned.agg(F.sum("dist2")).head()[0]
        if not cost:
            break
        likely = uniform_draw(seed, step, point_key()) * cost < oversampling * k * F.col("dist2")
        rows = assigned.where(likely).select("x", point_key().alias("key")).distinct().limit(MAX_CENTERS).collect()
        if len(c) + len(rows) >= MAX_CENTERS:
            raise ValueError(f"more than {MAX_CENTERS} candidates; lower k or the oversampling")
        rows.sort(key=lambda row: row["x"])
        if rows:
            c = np.vstack([c, [row["x"] for row in rows]])
            keys += [row["key"] for row in rows]
    return c, keys


def pick_centers(c: np.ndarray, keys: list[str], weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ among the candidates; each step is a race of exponential times, the earliest wins."""
    nearest, picked = np.ones(len(c)), []
    while len(picked) < min(k, len(c)):
        rate = weights * nearest
        if not rate.any():
            break
        draws = [-log(_draw(seed, f"pick {len(picked)}", key) + 0.5 / _RANGE) for key in keys]
        times = np.divide(draws, rate, out=np.full(len(c), np.inf), where=rate > 0)
        picked.append(int(times.argmin()))
        gap = ((c - c[picked[-1]]) ** 2).sum(axis=1)
        nearest = gap if len(picked) == 1 else np.minimum(nearest, gap)
    return c[picked]


def initial_centers(
    points: DataFrame, k: int, seed: int = 0, rounds: int = START_ROUNDS, oversampling: float = OVERSAMPLING
) -> DataFrame:
    """``(cluster, c)`` of the k-means start alone, in the order of picking.

    There may be fewer than ``k`` centres if there are fewer distinct points. The driver holds the candidates,
    about ``oversampling * k * rounds`` of them; their weights are the points nearest to each, one row for each candidate.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    with cached(points, "x") as kept:
        c, keys = candidates(kept, k, seed, rounds, oversampling)
        if len(c):
            weights = np.zeros(len(c))
            for row in assign(kept, c, keep=[]).groupBy("cluster").count().collect():
                weights[row["cluster"]] = row["count"]
            c = pick_centers(c, keys, weights, k, seed)
    return center_table(points.sparkSession, c)


def standard_centers(points: DataFrame, k: int, max_iter: int, seed: int = 0, tolerance: float = TOLERANCE) -> DataFrame:
    """``(cluster, c)`` of standard k-means: parallel start, then at most ``max_iter`` rounds."""
    with cached(points, "x") as kept:
        return lloyd(kept, initial_centers(kept, k, seed), max_iter, tolerance=tolerance)
