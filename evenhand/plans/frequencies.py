"""The full frequency report of an item stream."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.hashing import DEFAULT_PRIME
from evenhand.operators.heavy import LISTING_MAX_K, heavy_hitters, with_errors
from evenhand.operators.sketch import cms_build, cs_build, sketch_estimates, stream_summary
from evenhand.storage import materialize


class FrequencyReport(NamedTuple):
    summary: DataFrame
    listing: DataFrame


def top_estimates(
    hist: DataFrame,
    hashes,
    w: int,
    k: int,
    prime: int = DEFAULT_PRIME,
    min_freq: int = 2,
    cms: DataFrame | None = None,
    cs: DataFrame | None = None,
) -> DataFrame:
    """``(item, freq, est_cm, est_cs)`` of the heavy hitters; estimates are null below ``min_freq``.

    Only the heavy hitters probe the sketches. Sketches that are not given are
    built from the histogram.
    """
    cms = cms_build(hist, hashes, w, prime) if cms is None else cms
    cs = cs_build(hist, hashes, w, prime) if cs is None else cs
    top = sketch_estimates(heavy_hitters(hist, k), hashes, w, prime, cms=cms, cs=cs)
    estimated = F.col("freq") >= min_freq
    shown = [F.when(estimated, F.col(name)).alias(name) for name in ("est_cm", "est_cs")]
    return top.select("item", "freq", *shown)


def heavy_hitter_report(
    hist: DataFrame,
    hashes,
    w: int,
    k: int,
    prime: int = DEFAULT_PRIME,
    min_freq: int = 2,
    listing_max_k: int = LISTING_MAX_K,
    cms: DataFrame | None = None,
    cs: DataFrame | None = None,
    materialized: bool = False,
) -> FrequencyReport:
    """Summary and listing of the heavy hitters of a histogram.

    ``summary`` is one row ``(n_items, n_distinct, n_top, err_cm, err_cs)``;
    with fewer than k items ``n_top`` is 0 and the errors are null. ``listing``
    is ``(item, freq, est_cm)`` in item order, at most k rows, empty for k above
    ``listing_max_k``. With ``materialized`` the histogram is computed at once
    and written to the shared folder, so the stream is read a single time for
    both tables.
    """
    if materialized:
        hist = materialize(hist)
    top = top_estimates(hist, hashes, w, k, prime, min_freq, cms, cs)
    errors = with_errors(top).select(F.struct("n_top", "err_cm", "err_cs").alias("e")).scalar()
    summary = stream_summary(hist).withColumn("e", errors)
    listing = top.orderBy("item").limit(k if k <= listing_max_k else 0)
    estimate = F.coalesce("est_cm", F.lit(0).cast("bigint")).alias("est_cm")
    return FrequencyReport(
        summary.select("n_items", "n_distinct", "e.n_top", "e.err_cm", "e.err_cs"),
        listing.select("item", "freq", estimate),
    )
