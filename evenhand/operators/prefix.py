"""Running totals over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.storage import materialize

# The table is cut into this many ranges; only their totals meet in one task.
RANGES = 128


def with_prior_total(df: DataFrame, order: str, value: str, name: str = "prior", ranges: int = RANGES) -> DataFrame:
    """Add the total of ``value`` over all rows with a smaller ``order``, whose values are distinct.

    Approximate quantiles cut the order into ranges. Rows are summed per range,
    the running total of at most ``ranges + 1`` range totals is broadcast, and
    the rest is a window inside each range. The cuts only balance the work; any
    cuts give the same result. ``order`` is numeric, a date or a timestamp.
    ``df`` is read twice, once for the cuts.
    """
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(order, shares, 10 * ranges).alias("cuts")).scalar()
    # Never null, so that the join below adds no null filter on the source.
    range_id = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= F.col(order))), F.lit(0))
    ranged = df.withColumn("_cuts", cuts).withColumn("_range", range_id).drop("_cuts")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    running = ranged.withColumn("_local", local)
    # Taken from the last row of each range, so that both uses share one shuffle.
    totals = running.groupBy("_range").agg(F.max_by(F.col("_local") + F.col(value), order).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    joined = running.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))


def prefix_until_t(batches: DataFrame, t: int) -> DataFrame:
    """Batches ``(batch, n)`` that are processed when a run stops after ``t`` items, with their ``prior`` total.

    A batch is taken whole while fewer than ``t`` items came before it. The batch counts are
    written once to the shared folder, so that finding the cuts does not read their source again.
    """
    if t < 1:
        raise ValueError("t must be at least 1")
    return with_prior_total(materialize(batches), "batch", "n").where(F.col("prior") < t)
