"""Per-cluster, per-group counts, means and dispersion in one pass over the points.

Every task sends at most 2K rows to the shuffle, so neither a hot cluster nor a
hot group reaches one task as raw points.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import kernels
from evenhand.functions.centers import center_matrix
from evenhand.operators.assignment import BLOCK_BYTES, assign, is_unrolled, with_coordinates, with_nearest


PARTIAL = "cluster int, side int, n bigint, n_exact bigint, mean array<double>, spread double"


def cluster_moments(points: DataFrame, centers, grouped: bool = True) -> DataFrame:
    """``(cluster, side, n, n_exact, mean, spread)`` of the points nearest to each centre.

    ``side`` is 0 for label A and 1 for every other label (always 0 if not
    ``grouped``); ``n_exact`` counts the rows whose label is A or B; ``spread``
    is the summed squared distance to the mean. Pairs without points are absent.
    """
    c = center_matrix(centers)
    if not len(c):
        raise ValueError("at least one centre is needed")
    prepared = with_sides(points, grouped)
    if is_unrolled(c):
        return _unrolled_moments(prepared, c)
    return _arrow_moments(prepared, c)


def with_sides(points: DataFrame, grouped: bool) -> DataFrame:
    """``(x, side, exact)``: 0 for label A and 1 for others, and whether the label is A or B."""
    if grouped:
        side = F.when(F.col("g") == "A", 0).otherwise(1)
        exact = F.when(F.col("g").isin("A", "B"), 1).otherwise(0)
    else:
        side, exact = F.lit(0), F.lit(1)
    return points.select("x", side.alias("side"), exact.alias("exact"))


def _unrolled_moments(prepared: DataFrame, c) -> DataFrame:
    d = c.shape[1]
    coords = [f"_x{j}" for j in range(d)]
    spread = with_coordinates(prepared, d, ["side", "exact"])
    assigned = with_nearest(spread, c, ["side", "exact", *coords])
    means = ", ".join(f"avg({x})" for x in coords)
    variance = " + ".join(f"var_pop({x})" for x in coords)
    return assigned.groupBy("cluster", "side").agg(
        F.count("*").alias("n"),
        F.sum(F.col("exact").cast("bigint")).alias("n_exact"),
        F.expr(f"array({means})").alias("mean"),
        F.expr(f"count(*) * ({variance})").alias("spread"),
    )


def _arrow_moments(prepared: DataFrame, c) -> DataFrame:
    # Large centre sets go out block by block, as they do for assignment.
    assigned = prepared if c.nbytes <= BLOCK_BYTES else assign(prepared, c)
    block = prepared.sparkSession.sparkContext.broadcast(c) if assigned is prepared else None
    d = c.shape[1]

    def run(batches):
        return kernels.partition_moments(batches, d, None if block is None else block.value)

    prepared = assigned
    return merged_moments(prepared.mapInArrow(run, PARTIAL))


def merged_moments(partial: DataFrame) -> DataFrame:
    """Moments of all points from those of the partitions."""
    weight = F.col("n").cast("double")
    # Spread of the partition means around the common mean, from their weighted variance.
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector("mean"), weight)
    merged = partial.groupBy("cluster", "side").agg(
        F.sum("n").alias("n"),
        F.sum("n_exact").alias("n_exact"),
        summary.alias("s"),
        F.sum(weight * weight).alias("w2"),
        F.sum("spread").alias("inner_spread"),
    )
    variance = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v)
    freedom = F.col("n") - F.col("w2") / F.col("n")
    return merged.select(
        "cluster",
        "side",
        "n",
        "n_exact",
        vector_to_array("s.mean").alias("mean"),
        (F.col("inner_spread") + variance * freedom).alias("spread"),
    )
