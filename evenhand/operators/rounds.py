"""Standard Lloyd rounds, and the cache that all clustering loops share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from evenhand.functions.centers import center_matrix, center_table
from evenhand.operators.assignment import is_unrolled
from evenhand.operators.bounds import BoundedRounds
from evenhand.operators.moments import cluster_moments

# Centres from which bounds save more than they cost.
BOUNDED_CENTERS = 32


@contextmanager
def cached(points: DataFrame, *columns: str, num_partitions: int | None = None) -> Iterator[DataFrame]:
    """The typed columns, kept in memory and on disk for several passes.

    Points that the caller already keeps are used as they are, unless they are
    to be spread over ``num_partitions`` partitions.
    """
    chosen = points.select(*columns)
    if num_partitions is not None:
        chosen = chosen.repartition(num_partitions)
    elif points.storageLevel.useMemory or points.storageLevel.useDisk:
        yield chosen
        return
    chosen.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield chosen
    finally:
        chosen.unpersist()


@contextmanager
def moments_of(
    points: DataFrame, c: np.ndarray, grouped: bool, num_partitions: int | None, bounded: bool | None
) -> Iterator[Callable[[np.ndarray], DataFrame]]:
    """How a loop gets its moments for given centres.

    ``bounded`` keeps bounds between the rounds, so that most distances are skipped; by default it is chosen for at
    least ``BOUNDED_CENTERS`` centres that do not fit a single expression. The result is the same.
    """
    if bounded is None:
        bounded = len(c) >= BOUNDED_CENTERS and not is_unrolled(c)
    with ExitStack() as held:
        if bounded and len(c):
            spread = points if num_partitions is None else points.repartition(num_partitions)
            rounds = BoundedRounds(spread, grouped)
            held.callback(rounds.close)
            yield rounds.moments
        else:
            columns = ["x", "g"] if grouped else ["x"]
            kept = held.enter_context(cached(points, *columns, num_partitions=num_partitions))
            yield lambda c: cluster_moments(kept, c, grouped)


def lloyd(
    points: DataFrame,
    init_centers,
    m: int,
    num_partitions: int | None = None,
    tolerance: float | None = None,
    bounded: bool | None = None,
) -> DataFrame:
    """``(cluster, c)`` after ``m`` standard Lloyd rounds; a centre without points stays where it is.

    With ``tolerance`` the rounds end once no centre has moved farther than that; see :func:`moments_of` for ``bounded``.
    """
    c = center_matrix(init_centers)
    with moments_of(points, c, False, num_partitions, bounded) as moments:
        for _ in range(m if len(c) else 0):
            rows = moments(c).select("cluster", "mean").collect()
            before, c = c, c.copy()
            for row in rows:
                c[row["cluster"]] = row["mean"]
            if tolerance is not None and ((c - before) ** 2).sum(axis=1).max() <= tolerance**2:
                break
    return center_table(points.sparkSession, c)
