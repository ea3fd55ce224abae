"""Arrow batch functions for points of high dimension.

Spark partitions the work and ships Arrow batches; these functions only do the
arithmetic of one batch. They are used where an unrolled expression would be
too long for the code generator.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers then need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of one distance block: keeps the temporary matrix of rows x centres small.
BLOCK_CELLS = 1 << 19


def coordinates(column: pa.Array, d: int) -> np.ndarray:
    """n x d matrix over an Arrow list column."""
    if column.null_count or len(column) and not pc.all(pc.equal(pc.list_value_length(column), d)).as_py():
        raise ValueError(f"every point must have {d} coordinates, none of them null")
    values = column.flatten()
    if values.null_count:
        raise ValueError(f"every point must have {d} coordinates, none of them null")
    return values.to_numpy(zero_copy_only=False).reshape(len(column), d)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``c`` for each row of ``x``, and the squared distance.

    A matrix product first gives every squared distance up to a known rounding
    error. Rows with a single centre inside that error are settled; the others
    compare exact distances, so ties still go to the smallest index.
    """
    n, d = x.shape
    k = len(c)
    best = np.zeros(n, dtype=np.int32)
    c_sq = np.einsum("kd,kd->k", c, c)
    step = max(1, BLOCK_CELLS // k)
    for lo in range(0, n, step):
        rows = x[lo : lo + step]
        x_sq = np.einsum("nd,nd->n", rows, rows)
        approx = rows @ c.T
        approx *= -2.0
        approx += c_sq
        error = 8.0 * (d + 4) * np.finfo(np.float64).eps * (x_sq + c_sq.max())
        index = approx.argmin(axis=1)
        limit = approx[np.arange(len(rows)), index] + 2.0 * error
        close = ~(approx > limit[:, None])
        unsettled = np.flatnonzero(close.sum(axis=1) > 1)
        if len(unsettled):
            exact = np.stack([sq_distances(rows[unsettled], c[j : j + 1]) for j in range(k)], axis=1)
            index[unsettled] = np.where(np.isnan(exact), np.inf, exact).argmin(axis=1)
        best[lo : lo + step] = index
    return best, sq_distances(x, c[best])


def sq_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise squared distances, added from the first coordinate to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = x[:, j] - y[:, j]
        total += gap * gap
    return total


def two_nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`nearest` (index and distance, not squared), and the distance to the second nearest (infinite without one)."""
    index, d2 = nearest(x, c)
    second = np.full(len(x), np.inf)
    if len(c) > 1:
        c_sq = np.einsum("kd,kd->k", c, c)
        step = max(1, BLOCK_CELLS // len(c))
        for lo in range(0, len(x), step):
            rows, at = x[lo : lo + step], index[lo : lo + step]
            x_sq = np.einsum("nd,nd->n", rows, rows)
            approx = x_sq[:, None] + c_sq - 2.0 * rows @ c.T
            approx[np.arange(len(rows)), at] = np.inf
            # Below the true value by the rounding error of the product form.
            error = 8.0 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (x_sq + c_sq.max())
            second[lo : lo + step] = np.sqrt(np.maximum(approx.min(axis=1) - error, 0.0))
    return index, np.sqrt(d2), second


# Bounds are widened by this share for every step that rounds.
BOUND_SLACK = 1e-12


class CenterShift:
    """How centres moved between two rounds, and how far each is from the others."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.new = new
        self.moved = np.sqrt(((new - old) ** 2).sum(axis=1)) * (1 + BOUND_SLACK)
        order = np.argsort(self.moved)
        self.first = int(order[-1])
        self.most = self.moved[order[-1]]
        self.second = self.moved[order[-2]] if len(new) > 1 else 0.0
        self.half = np.full(len(new), np.inf)
        for k in range(len(new)):
            if len(new) > 1:
                gap = np.sqrt(sq_distances(np.delete(new, k, axis=0), new[k : k + 1])).min()
                self.half[k] = 0.5 * gap * (1 - BOUND_SLACK)

    def advance(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """Assignment and bounds under the new centres, and the number of distances that it took.

        ``upper`` bounds the distance to the own centre from above and ``lower`` that to all others from below. A
        point stays without a look at any other centre only if its upper bound is strictly below the lower one, or
        below half the way to the next centre; whatever could be a tie is settled by all distances, as in the first round.
        """
        upper = (upper + self.moved[cluster]) * (1 + BOUND_SLACK)
        others = np.where(cluster == self.first, self.second, self.most)
        lower = np.maximum((lower - others) * (1 - np.sign(lower - others) * BOUND_SLACK), 0.0)
        safe = np.maximum(lower, self.half[cluster]) * (1 - BOUND_SLACK)
        open_ = np.flatnonzero(~(upper < safe))
        count = len(open_)
        upper[open_] = np.sqrt(sq_distances(x[open_], self.new[cluster[open_]])) * (1 + BOUND_SLACK)
        open_ = open_[~(upper[open_] < safe[open_])]
        if len(open_):
            cluster = cluster.copy()
            cluster[open_], upper[open_], lower[open_] = two_nearest(x[open_], self.new)
            upper[open_] *= 1 + BOUND_SLACK
            lower[open_] *= 1 - BOUND_SLACK
            count += len(open_) * len(self.new)
        return cluster, upper, lower, count


def append_nearest(
    batches: Iterator[pa.RecordBatch], c: np.ndarray, first: int, keep: list[str], refine: bool
) -> Iterator[pa.RecordBatch]:
    """Add ``cluster`` and ``dist2``; with ``refine`` only where a centre of this block is nearer."""
    for batch in batches:
        x = coordinates(batch.column("x"), c.shape[1])
        cluster, dist2 = nearest(x, c)
        cluster = cluster + np.int32(first)
        if refine:
            old_cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            old_dist2 = batch.column("dist2").to_numpy(zero_copy_only=False)
            nearer = dist2 < old_dist2
            cluster = np.where(nearer, cluster, old_cluster).astype(np.int32)
            dist2 = np.where(nearer, dist2, old_dist2)
        columns = [batch.column(name) for name in keep]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(cluster, pa.int32()), pa.array(dist2, pa.float64())],
            names=[*keep, "cluster", "dist2"],
        )


class MomentSums:
    """Counts, means and squared deviations of points by (cluster, side), merged batch by batch.

    The pairwise update for means and squared deviations has no cancellation.
    """

    COLUMNS = ("cluster", "side", "n", "n_exact", "mean", "spread")

    def __init__(self) -> None:
        self.count: dict[int, int] = {}
        self.exact: dict[int, int] = {}
        self.mean: dict[int, np.ndarray] = {}
        self.spread: dict[int, float] = {}

    def add(self, x: np.ndarray, cluster: np.ndarray, side: np.ndarray, exact: np.ndarray) -> None:
        count, mean, spread = self.count, self.mean, self.spread
        key = cluster * 2 + side
        order = np.argsort(key, kind="stable")
        x = x[order]
        keys, starts, sizes = np.unique(key[order], return_index=True, return_counts=True)
        exacts = np.add.reduceat(exact[order].astype(np.int64), starts)
        means = np.add.reduceat(x, starts, axis=0) / sizes[:, None]
        gaps = x - np.repeat(means, sizes, axis=0)
        spreads = np.add.reduceat(np.einsum("nd,nd->n", gaps, gaps), starts)
        for i, k in enumerate(keys.tolist()):
            n_old, n_new = count.get(k, 0), int(sizes[i])
            gap = means[i] - mean.get(k, means[i])
            share = n_new / (n_old + n_new)
            count[k] = n_old + n_new
            self.exact[k] = self.exact.get(k, 0) + int(exacts[i])
            mean[k] = mean.get(k, means[i]) + gap * share
            spread[k] = spread.get(k, 0.0) + spreads[i] + n_old * share * float(gap @ gap)

    def arrays(self) -> list[pa.Array]:
        keys = sorted(self.count)
        return [
            pa.array([k // 2 for k in keys], pa.int32()),
            pa.array([k % 2 for k in keys], pa.int32()),
            pa.array([self.count[k] for k in keys], pa.int64()),
            pa.array([self.exact[k] for k in keys], pa.int64()),
            pa.array([self.mean[k].tolist() for k in keys], pa.list_(pa.float64())),
            pa.array([self.spread[k] for k in keys], pa.float64()),
        ]


def partition_moments(
    batches: Iterator[pa.RecordBatch], d: int, c: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Assign the points of one partition and return one moment row per (cluster, side).

    Input columns are ``x array<double>, side int, exact int``, and ``cluster int`` if no centres are given. At
    most 2K rows leave a partition, whatever its size.
    """
    sums = MomentSums()
    for batch in batches:
        if batch.num_rows:
            x = coordinates(batch.column("x"), d)
            side, exact = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("side", "exact"))
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False) if c is None else nearest(x, c)[0]
            sums.add(x, cluster, side, exact)
    yield pa.RecordBatch.from_arrays(sums.arrays(), names=list(sums.COLUMNS))
