"""Heavy hitters of a histogram ``(item, freq)`` and the error of their estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.hashing import DEFAULT_PRIME
from evenhand.operators.prefix import with_prior_total
from evenhand.operators.sketch import sketch_estimates

# Up to this k a distributed top-k ends in one task; larger k count the frequencies instead.
TOP_K_ROWS = 10_000
# The listing is part of the report only for small k.
LISTING_MAX_K = 10


def phi_k(hist: DataFrame, k: int) -> DataFrame:
    """``(phi)``: the k-th largest frequency; null if there are fewer than k items."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if k <= TOP_K_ROWS:
        top = hist.select("freq").orderBy(F.desc("freq")).limit(k)
        return top.agg(F.when(F.count("*") == k, F.min("freq")).alias("phi"))
    # Few different frequencies exist (their sum is the stream length), so counting
    # the items of each and adding up from the largest stays small for any k.
    levels = hist.groupBy("freq").agg(F.count("*").alias("n")).withColumn("below", -F.col("freq"))
    reached = with_prior_total(levels, "below", "n").where(F.col("prior") + F.col("n") >= k)
    return reached.agg(F.max("freq").alias("phi"))


def heavy_hitters(hist: DataFrame, k: int) -> DataFrame:
    """``(item, freq)`` of all items at least as frequent as the k-th, so possibly more than k.

    Empty if there are fewer than k items.
    """
    return hist.where(F.col("freq") >= phi_k(hist, k).scalar())


def frequent_item_estimates(
    hist: DataFrame,
    cms: DataFrame,
    cs: DataFrame,
    hashes,
    w: int,
    prime: int = DEFAULT_PRIME,
    min_freq: int = 2,
) -> DataFrame:
    """``(item, freq, est_cm, est_cs)`` of the items with at least ``min_freq`` occurrences."""
    frequent = hist.where(F.col("freq") >= min_freq).select("item", "freq")
    return sketch_estimates(frequent, hashes, w, prime, cms=cms, cs=cs)


def with_errors(top: DataFrame) -> DataFrame:
    """One row ``(n_top, err_cm, err_cs)`` from ``(freq, est_cm, est_cs)``; a missing estimate counts as 0."""
    return top.agg(
        F.count("*").alias("n_top"),
        *[
            F.avg(F.abs(F.col("freq") - F.coalesce(f"est_{s}", F.lit(0))) / F.col("freq")).alias(f"err_{s}")
            for s in ("cm", "cs")
        ],
    )


def topk_error(hist: DataFrame, est_cm: DataFrame, est_cs: DataFrame, k: int, min_freq: int = 2) -> DataFrame:
    """``(n_top, err_cm, err_cs)``: mean relative error of both estimates over the heavy hitters.

    ``est_cm`` and ``est_cs`` are ``(item, est)``. Items rarer than ``min_freq``
    have no estimate. No row if there are fewer than k items.
    """
    estimated = F.col("freq") >= min_freq
    top = heavy_hitters(hist, k)
    for name, estimates in (("est_cm", est_cm), ("est_cs", est_cs)):
        found = estimates.select("item", F.col("est").alias("_est"))
        top = top.join(found, "item", "left")
        top = top.withColumn(name, F.when(estimated, F.col("_est"))).drop("_est")
    return with_errors(top).where(F.col("n_top") > 0)


def heavy_hitter_listing(
    hist: DataFrame, est_cm: DataFrame, k: int, listing_max_k: int = LISTING_MAX_K, min_freq: int = 2
) -> DataFrame:
    """``(item, freq, est_cm)`` of the heavy hitters in item order, at most k; empty for k above ``listing_max_k``."""
    top = heavy_hitters(hist, k).orderBy("item").limit(k if k <= listing_max_k else 0)
    found = est_cm.select("item", F.col("est").alias("_est"))
    estimate = F.when(F.col("freq") >= min_freq, F.coalesce("_est", F.lit(0).cast("bigint"))).otherwise(0)
    return top.join(found, "item", "left").select("item", "freq", estimate.alias("est_cm")).orderBy("item")
