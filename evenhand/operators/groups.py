"""Group counts and objectives of labelled points ``(x, g)``; every result is one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.centers import center_matrix, center_table
from evenhand.operators.assignment import assign

# Per-cluster results of at most this many rows are broadcast to the centre table.
BROADCAST_CLUSTERS = 100_000


def group_filter(points: DataFrame, label: str) -> DataFrame:
    """Points whose label is exactly ``label``."""
    return points.where(F.col("g") == label)


def group_counts(points: DataFrame) -> DataFrame:
    """``(n, n_a, n_b)``; other labels count in ``n`` only."""
    return points.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("g") == "A").alias("n_a"),
        F.count_if(F.col("g") == "B").alias("n_b"),
    )


def group_hist(points: DataFrame) -> DataFrame:
    """``(g, n)`` of every label."""
    return points.groupBy("g").agg(F.count("*").alias("n"))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def standard_objective(points: DataFrame, centers) -> DataFrame:
    """``(delta)``: mean squared distance to the nearest centre; 0 without points or centres."""
    c = center_matrix(centers)
    if not len(c):
        return points.agg(F.lit(0.0).alias("delta"))
    return assign(points, c, keep=[]).agg(mean_or_zero(F.col("dist2")).alias("delta"))


def fair_objective(points: DataFrame, centers) -> DataFrame:
    """``(delta_a, delta_b, phi)``: the mean of each group and the larger one, in one pass."""
    return fair_objectives(points, [centers]).drop("set")


def fair_objectives(points: DataFrame, center_sets: Sequence) -> DataFrame:
    """``(set, delta_a, delta_b, phi)`` of several centre sets, numbered as given, from one pass over the points.

    Every set adds its distances to the same row, so the points are read once and one row leaves each task.
    """
    matrices = [center_matrix(centers) for centers in center_sets]
    current = points
    for i, c in enumerate(matrices):
        kept = ["g", *[f"_cost{j}" for j in range(i)], *(["x"] if i + 1 < len(matrices) else [])]
        if len(c):
            current = assign(current, c, keep=kept).withColumnRenamed("dist2", f"_cost{i}").drop("cluster")
        else:
            current = current.select(*kept, F.lit(0.0).alias(f"_cost{i}"))
    means = [
        mean_or_zero(F.when(F.col("g") == g, F.col(f"_cost{i}"))).alias(f"_{g}{i}")
        for i in range(len(matrices))
        for g in ("A", "B")
    ]
    rows = [
        F.struct(
            F.lit(i).alias("set"),
            F.col(f"_A{i}").alias("delta_a"),
            F.col(f"_B{i}").alias("delta_b"),
            F.greatest(f"_A{i}", f"_B{i}").alias("phi"),
        )
        for i in range(len(matrices))
    ]
    return current.agg(*means).select(F.inline(F.array(*rows)))


def cluster_stats(points: DataFrame, centers) -> DataFrame:
    """``(cluster, center, n_a, n_b)`` of every centre, zero counts included; a label that is not A counts as B."""
    c = center_matrix(centers)
    is_a = (F.col("g") == "A").eqNullSafe(True)
    counts = assign(points, c, keep=["g"]).groupBy("cluster").agg(
        F.count_if(is_a).alias("n_a"), F.count_if(~is_a).alias("n_b")
    )
    return with_every_center(counts, c, points.sparkSession, ["n_a", "n_b"])


def with_every_center(counts: DataFrame, c: np.ndarray, spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Add the centres to per-cluster counts, zero where a centre has no row.

    There are at most K count rows; they are broadcast only for moderate K.
    """
    centers = center_table(spark, c).withColumnRenamed("c", "center")
    if len(c) <= BROADCAST_CLUSTERS:
        counts = F.broadcast(counts)
    zero = F.lit(0).cast("bigint")
    filled = [F.coalesce(name, zero).alias(name) for name in names]
    return centers.join(counts, "cluster", "left").select("cluster", "center", *filled)
