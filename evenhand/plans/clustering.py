"""Reports on a clustering: one centre set in full, or standard against fair centres."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.centers import center_matrix
from evenhand.operators.assignment import assign
from evenhand.operators.fair import fair_lloyd
from evenhand.operators.groups import fair_objectives, with_every_center
from evenhand.operators.kmeans import standard_centers
from evenhand.operators.rounds import cached
from evenhand.storage import materialize


class Evaluation(NamedTuple):
    summary: DataFrame
    clusters: DataFrame


def evaluate_clustering(points: DataFrame, centers, materialized: bool = False) -> Evaluation:
    """``summary (n, n_a, n_b, delta, phi)`` and ``clusters (cluster, center, n_a, n_b)``.

    Both are derived from one profile of at most K rows. With ``materialized``
    the profile is computed at once and written to the shared folder, so the
    points are read a single time however often the two tables are used.
    """
    c = center_matrix(centers)
    is_a, is_b = (F.col("g") == "A").eqNullSafe(True), (F.col("g") == "B").eqNullSafe(True)
    if len(c):
        assigned = assign(points, c, keep=["g"])
    else:  # no centre: every cost is 0, and there are no clusters
        assigned = points.select("g", F.lit(-1).alias("cluster"), F.lit(0.0).alias("dist2"))
    profile = assigned.groupBy("cluster").agg(
        F.count("*").alias("n"),
        F.count_if(is_a).alias("n_a"),
        F.count_if(is_b).alias("n_b"),
        F.sum("dist2").alias("cost"),
        F.sum(F.when(is_a, F.col("dist2"))).alias("cost_a"),
        F.sum(F.when(is_b, F.col("dist2"))).alias("cost_b"),
    )
    if materialized:
        profile = materialize(profile)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))

    def mean(cost: str, n: str) -> Column:
        return F.when(total(n) > 0, F.sum(cost) / total(n)).otherwise(0.0)

    summary = profile.agg(
        total("n").alias("n"),
        total("n_a").alias("n_a"),
        total("n_b").alias("n_b"),
        mean("cost", "n").alias("delta"),
        F.greatest(mean("cost_a", "n_a"), mean("cost_b", "n_b")).alias("phi"),
    )
    counts = profile.select("cluster", "n_a", (F.col("n") - F.col("n_a")).alias("n_b"))
    return Evaluation(summary, with_every_center(counts, c, points.sparkSession, ["n_a", "n_b"]))


def compare_fairness(
    points: DataFrame, k: int, m: int, seed: int = 0, num_partitions: int | None = None
) -> DataFrame:
    """One row: fair objective under standard and fair centres, and four elapsed times in ms.

    The points are loaded before the first timer starts, so neither method
    carries the cost of reading them. One pass evaluates both centre sets, so
    both objective times are those of that pass.
    """
    spark = points.sparkSession

    def timed(action):
        start = time.perf_counter()
        result = action()
        return result, int((time.perf_counter() - start) * 1000)

    with cached(points, "x", "g", num_partitions=num_partitions) as kept:
        kept.count()
        standard, t_standard = timed(lambda: center_matrix(standard_centers(kept, k, m, seed)))
        fair, t_fair = timed(lambda: center_matrix(fair_lloyd(kept, k, m, seed)))
        both, t_both = timed(lambda: fair_objectives(kept, [standard, fair]).orderBy("set").collect())
    row = (both[0]["phi"], both[1]["phi"], t_standard, t_fair, t_both, t_both)
    return spark.createDataFrame(
        [row],
        "phi_std double, phi_fair double, t_std_centers_ms bigint, t_fair_centers_ms bigint, "
        "t_std_obj_ms bigint, t_fair_obj_ms bigint",
    )
