"""Fair Lloyd rounds on two groups, and the statistics they rest on.

A round is one aggregation over the points that returns at most 2K rows; what
follows on the driver is arithmetic on K-sized arrays. The plan of a round is
built on the same input every time, so it does not grow with the rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.centers import center_matrix, center_table
from evenhand.functions.distance import distance
from evenhand.operators.kmeans import initial_centers
from evenhand.operators.moments import cluster_moments
from evenhand.operators.rounds import cached, lloyd, moments_of  # noqa: F401

# Fixed values of the search for the balance between the groups.
FIRST_GAMMA = 0.5
FIRST_STEP = 0.25
GAMMA_STEPS = 10


def _sided(points: DataFrame, centers) -> DataFrame:
    side_name = F.when(F.col("side") == 0, "A").otherwise("B")
    return cluster_moments(points, centers).withColumn("g", side_name)


def cluster_group_means(points: DataFrame, centers) -> DataFrame:
    """``(cluster, g, n, mean, spread)`` of each group in each cluster; a label that is not A counts as B."""
    return _sided(points, centers).select("cluster", "g", "n", "mean", "spread")


def fair_fixed_cost(points: DataFrame, centers) -> DataFrame:
    """``(fixed_a, fixed_b)``: squared distance to the own group's mean in the cluster, per group member."""
    total_b = F.sum(F.when(F.col("side") == 1, F.col("n_exact")))
    total_a = F.sum(F.when(F.col("side") == 0, F.col("n")))

    def cost(side: int, total):
        spread = F.sum(F.when(F.col("side") == side, F.col("spread")))
        return F.when(total > 0, spread / total).otherwise(0.0)

    return cluster_moments(points, centers).agg(cost(0, total_a).alias("fixed_a"), cost(1, total_b).alias("fixed_b"))


def cluster_shares(points: DataFrame, centers) -> DataFrame:
    """``(cluster, g, share)``: part of the group that lies in the cluster, for both groups and every centre."""
    c = center_matrix(centers)
    whole = Window.partitionBy("g")
    total = F.sum("n_exact").over(whole)
    share = F.when(total > 0, F.col("n") / total).otherwise(0.0)
    found = _sided(points, c).select("cluster", "g", share.alias("share"))
    groups = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("g")
    every = center_table(points.sparkSession, c).select("cluster", groups)
    return every.join(found, ["cluster", "g"], "left").select(
        "cluster", "g", F.coalesce("share", F.lit(0.0)).alias("share")
    )


def mean_gap(points: DataFrame, centers) -> DataFrame:
    """``(cluster, ell)`` of every centre: distance between the two group means; 0 where a group is absent."""
    c = center_matrix(centers)
    means = cluster_moments(points, c).groupBy("cluster").agg(
        F.any_value(F.when(F.col("side") == 0, F.col("mean")), F.lit(True)).alias("mean_a"),
        F.any_value(F.when(F.col("side") == 1, F.col("mean")), F.lit(True)).alias("mean_b"),
    )
    every = center_table(points.sparkSession, c).select("cluster")
    return every.join(means, "cluster", "left").select(
        "cluster", F.coalesce(distance("mean_a", "mean_b"), F.lit(0.0)).alias("ell")
    )


@dataclass
class GroupMoments:
    """Moments of both groups in K clusters; first index 0 is A, 1 is not A."""

    n: np.ndarray
    n_exact: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, moments: DataFrame, c: np.ndarray) -> GroupMoments:
        k, d = c.shape
        found = cls(np.zeros((2, k)), np.zeros((2, k)), np.zeros((2, k, d)), np.zeros((2, k)))
        for row in moments.collect():
            at = row["side"], row["cluster"]
            found.n[at], found.n_exact[at] = row["n"], row["n_exact"]
            found.mean[at], found.spread[at] = row["mean"], row["spread"]
        return found

    def totals(self) -> np.ndarray:
        """Members of A and B; third labels belong to neither."""
        return self.n_exact.sum(axis=1)

    def anchors(self, compat: bool) -> np.ndarray:
        """Group means with gaps filled from the other group.

        A group that is absent from a cluster takes the other group's mean. With
        ``compat`` every single coordinate that is exactly 0 is replaced instead,
        first in A and then in B.
        """
        a, b = self.mean
        if compat:
            a = np.where(a == 0.0, b, a)
            b = np.where(b == 0.0, a, b)
        else:
            absent_a, absent_b = (self.n == 0)[:, :, None]
            a, b = np.where(absent_a, b, a), np.where(absent_b, a, b)
        return np.stack([a, b])

    def fixed_costs(self, anchors: np.ndarray) -> np.ndarray:
        """Mean squared distance of A and B to their anchors."""
        moved = ((anchors - self.mean) ** 2).sum(axis=2)
        return _ratio((self.spread + self.n * moved).sum(axis=1), self.totals())

    def shares(self) -> np.ndarray:
        return _ratio(self.n, self.totals()[:, None])


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole, 0 where the whole is empty."""
    part, whole = np.broadcast_arrays(part, whole)
    return np.divide(part, whole, out=np.zeros(part.shape), where=whole > 0)


def balance(fixed: np.ndarray, shares: np.ndarray, gaps: np.ndarray, compat: bool) -> np.ndarray:
    """How far each centre moves from the A anchor toward the B anchor.

    Bisects the weight gamma of group A until the costs of both groups meet. The
    offsets of the last evaluated gamma are returned. A cluster without members
    has offset 0; with ``compat`` it makes the whole search undecided instead.
    """
    (alpha, beta), gamma, step = shares, FIRST_GAMMA, FIRST_STEP
    offsets = np.zeros_like(gaps)
    for _ in range(GAMMA_STEPS):
        pull_b = (1.0 - gamma) * beta
        weight = gamma * alpha + pull_b
        if compat:
            with np.errstate(invalid="ignore"):
                offsets = pull_b * gaps / weight
        else:
            offsets = _ratio(pull_b * gaps, weight)
        cost_a = fixed[0] + (alpha * offsets**2).sum()
        cost_b = fixed[1] + (beta * (gaps - offsets) ** 2).sum()
        if cost_a == cost_b:
            break
        gamma += step if cost_a > cost_b else -step
        step /= 2.0
    return offsets


def fair_step(moments: DataFrame, c: np.ndarray, other: str, compat: bool) -> np.ndarray:
    """Centres after one fair round, from the moments under the centres ``c``."""
    found = GroupMoments.of(moments, c)
    if other == "error" and (found.n_exact != found.n).any():
        raise ValueError("labels other than A and B; pass other='as_b' to count them with B")
    anchors = found.anchors(compat)
    toward_b = anchors[1] - anchors[0]
    gaps = np.sqrt((toward_b**2).sum(axis=1))
    offsets = balance(found.fixed_costs(anchors), found.shares(), gaps, compat)
    # Position between the anchors; the anchors coincide where the gap is 0.
    moved = anchors[0] + toward_b * _ratio(offsets, gaps)[:, None]
    empty = found.n.sum(axis=0) == 0
    if not compat:
        moved[empty] = c[empty]
    return moved


def fair_lloyd(
    points: DataFrame,
    k: int | None = None,
    m: int = 10,
    seed: int = 0,
    init_centers=None,
    other: str = "error",
    compat: bool = False,
    num_partitions: int | None = None,
    bounded: bool | None = None,
) -> DataFrame:
    """``(cluster, c)`` after exactly ``m`` fair rounds on points ``(x, g)`` of the groups A and B.

    Starts from ``init_centers`` or from the k-means start for ``k``. ``other``
    says what to do with third labels: ``error`` or ``as_b``. ``compat`` follows
    the published rules for zero means and empty clusters to the letter. ``bounded`` keeps bounds
    of every point between the rounds (default: for many centres of high dimension).
    """
    if other not in ("error", "as_b"):
        raise ValueError("other must be 'error' or 'as_b'")
    if init_centers is None and (k is None or k < 1):
        raise ValueError("either init_centers or k >= 1 is needed")
    with cached(points, "x", "g", num_partitions=num_partitions) as kept:
        c = center_matrix(initial_centers(kept, k, seed) if init_centers is None else init_centers)
        with moments_of(kept, c, True, None, bounded) as moments:
            for _ in range(m):
                c = fair_step(moments(c), c, other, compat)
    return center_table(points.sparkSession, c)
