"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.distance import sq_distance
from evenhand.functions.formatting import vector_text
from evenhand.functions.hashing import DEFAULT_PRIME, WIDE_PRIME, draw_rows, hash_bucket, hash_sign
from evenhand.operators.assignment import assign
from evenhand.operators.fair import (
    cluster_group_means,
    cluster_shares,
    fair_fixed_cost,
    fair_lloyd,
    mean_gap,
)
from evenhand.operators.groups import (
    cluster_stats,
    fair_objective,
    fair_objectives,
    group_counts,
    group_filter,
    group_hist,
    standard_objective,
)
from evenhand.operators.heavy import (
    frequent_item_estimates,
    heavy_hitter_listing,
    heavy_hitters,
    phi_k,
    topk_error,
)
from evenhand.operators.kmeans import initial_centers, standard_centers
from evenhand.operators.prefix import prefix_until_t
from evenhand.operators.rounds import lloyd
from evenhand.operators.sketch import (
    cms_build,
    cms_estimate,
    cs_build,
    cs_estimate,
    frequency_tables,
    distinct_sketch,
    item_hist,
    merge_hists,
    merge_sketches,
    merged_distinct,
    merged_top_k,
    sketch_estimates,
    store_sketches,
    stream_summary,
    top_k_sketch,
)
from evenhand.plans.clustering import compare_fairness, evaluate_clustering
from evenhand.plans.frequencies import heavy_hitter_report
from evenhand.sources.items import file_pattern, parse_items, read_items
from evenhand.sources.points import generate_fair_points, parse_points, read_points, write_points
from evenhand.storage import materialize, new_path
from evenhand.streaming import sketches as streams
from evenhand.streaming.sinks import BatchTable
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters shared with the SQL checks.
W_SKEW, W_PART, W_ORDER = 50, 500, 4096
TOP_K = 10
LARGE_K = 12_000
PREFIX_T = 2000
DELTA_DAYS = 25
SEED = 7
GEN_K, GEN_PERC_A, GEN_DISTANCE = 4, 23, 17


def query(key: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn

    return register


def rounded(name: str, digits: int = 6, source: Column | str | None = None) -> Column:
    return F.round(name if source is None else source, digits).alias(name)


def exploded(df: DataFrame, array: str, *keys: str, digits: int = 4) -> DataFrame:
    """One row per array element: ``(*keys, dim, v)``."""
    rows = df.select(*keys, F.posexplode(array).alias("dim", "v"))
    return rows.select(*keys, "dim", rounded("v", digits))


# Points: source, counts, objectives


@query("points_from_text")
def points_from_text(spark, sf):
    points = fx.points_li(spark, sf)
    lines = points.select(F.concat_ws(",", F.col("x").cast("array<string>"), "g").alias("value"))
    parsed = parse_points(lines, dim=3)
    return parsed.selectExpr("x[0] as x0", "x[1] as x1", "x[2] as x2", "g")


@query("points_permissive")
def points_permissive(spark, sf):
    """Every few lines are spoiled in one of three ways; the dimension comes from all lines."""
    key, fields = F.col("l_orderkey"), F.concat_ws(",", F.col("x").cast("array<string>"), "g")
    value = (
        F.when(key % 7 == 0, F.concat(fields, F.lit(",")))
        .when(key % 11 == 0, F.concat(F.lit("1,"), fields))
        .when(key % 13 == 0, F.concat(F.lit("NaN"), F.substring(fields, F.instr(fields, ","), F.length(fields))))
        .otherwise(fields)
    )
    points, rejects = parse_points(fx.points_li(spark, sf, keys=True).select(value.alias("value")), "permissive")
    good = points.agg(F.count("*").alias("n"), rounded("sum_x1", 3, F.sum(F.col("x")[1])))
    bad = rejects.groupBy("reason").agg(F.count("*").alias("n"), F.lit(0.0).alias("sum_x1"))
    return good.select(F.lit("").alias("reason"), "n", "sum_x1").union(bad)


@query("repartitioned_count")
def repartitioned_count(spark, sf):
    """Points written as text and read back over seven partitions; all coordinates have at most four decimals."""
    exact = F.array(F.col("x")[0], F.round(F.col("x")[1] * 1000, 2), F.round(F.col("x")[2], 4))
    folder = new_path(spark, "points-text")
    write_points(fx.points_li(spark, sf).select(exact.alias("x"), "g"), folder)
    spread = read_points(spark, folder, num_partitions=7, dim=3).withColumn("part", F.spark_partition_id())
    return spread.groupBy("g").agg(
        F.count("*").alias("n"),
        *[rounded(f"sum_x{j}", 2, F.sum(F.col("x")[j])) for j in range(3)],
        F.count_distinct("part").alias("n_partitions"),
    )


@query("gen_group_counts")
def gen_group_counts(spark, sf):
    n = fx.table(spark, sf, "lineitem").count()
    points = generate_fair_points(spark, n, GEN_K, SEED, GEN_PERC_A, GEN_DISTANCE, with_blob=True)
    return points.groupBy("g", "blob").agg(F.count("*").alias("n"))


@query("group_filter")
def group_filter_a(spark, sf):
    chosen = group_filter(fx.points_li(spark, sf, keys=True), "A")
    return chosen.select(*fx.LI_KEY, "g")


@query("group_counts")
def group_counts_li(spark, sf):
    return group_counts(fx.points_li(spark, sf))


@query("group_counts_three")
def group_counts_three(spark, sf):
    return group_counts(fx.points_three(spark, sf))


@query("group_hist")
def group_hist_three(spark, sf):
    return group_hist(fx.points_three(spark, sf))


@query("sq_distance")
def sq_distance_to_center(spark, sf):
    center = F.lit(fx.CENTERS_LI[0])
    return fx.points_li(spark, sf, keys=True).select(*fx.LI_KEY, sq_distance("x", center).alias("d2"))


@query("assign_nearest")
def assign_nearest(spark, sf):
    points = fx.points_li(spark, sf, keys=True)
    return assign(points, fx.CENTERS_LI, keep=fx.LI_KEY)


@query("assign_embeddings")
def assign_embeddings(spark, sf):
    found = assign(fx.points_emb(spark, sf), fx.centers_emb(spark, sf), keep=["vec_id"])
    return found.select("vec_id", "cluster", rounded("dist2"))


@query("standard_objective")
def standard_objective_li(spark, sf):
    return standard_objective(fx.points_li(spark, sf), fx.CENTERS_LI).select(rounded("delta"))


@query("standard_objective_emb")
def standard_objective_emb(spark, sf):
    return standard_objective(fx.points_emb(spark, sf), fx.centers_emb(spark, sf)).select(rounded("delta"))


@query("fair_objective")
def fair_objective_li(spark, sf):
    found = fair_objective(fx.points_li(spark, sf), fx.CENTERS_LI)
    return found.select(rounded("delta_a"), rounded("delta_b"), rounded("phi"))


@query("fair_objective_three")
def fair_objective_three(spark, sf):
    found = fair_objective(fx.points_three(spark, sf), fx.CENTERS_THREE)
    return found.select(rounded("delta_a"), rounded("delta_b"), rounded("phi"))


@query("fair_objective_emb")
def fair_objective_emb(spark, sf):
    found = fair_objective(fx.points_emb(spark, sf), fx.centers_emb(spark, sf))
    return found.select(rounded("delta_a"), rounded("delta_b"), rounded("phi"))


@query("cluster_group_counts")
def cluster_group_counts(spark, sf):
    return cluster_stats(fx.points_li(spark, sf), fx.CENTERS_LI).drop("center")


@query("cluster_group_counts_three")
def cluster_group_counts_three(spark, sf):
    return cluster_stats(fx.points_three(spark, sf), fx.CENTERS_THREE).drop("center")


@query("clustering_report")
def clustering_report(spark, sf):
    summary = evaluate_clustering(fx.points_li(spark, sf), fx.CENTERS_LI).summary
    return summary.select("n", "n_a", "n_b", rounded("delta"), rounded("phi"))


@query("clustering_report_clusters")
def clustering_report_clusters(spark, sf):
    clusters = evaluate_clustering(fx.points_li(spark, sf), fx.CENTERS_LI).clusters
    return exploded(clusters, "center", "cluster", "n_a", "n_b")


@query("clustering_report_text")
def clustering_report_text(spark, sf):
    """The mean of group B in every cluster as text."""
    points = fx.points_li(spark, sf)
    found = cluster_group_means(points, fx.CENTERS_LI).groupBy("cluster")
    means = found.agg(F.max_by("mean", "g").alias("c"), F.sum("n").alias("n"))
    return means.select("cluster", "n", vector_text("c", 4).alias("center"))


# Group statistics and clustering rounds


@query("cluster_group_means")
def cluster_group_means_li(spark, sf):
    found = cluster_group_means(fx.points_li(spark, sf), fx.CENTERS_LI)
    return exploded(found, "mean", "cluster", "g", "n")


@query("cluster_group_means_emb")
def cluster_group_means_emb(spark, sf):
    found = cluster_group_means(fx.points_emb(spark, sf), fx.centers_emb(spark, sf))
    return exploded(found, "mean", "cluster", "g", "n", digits=6)


@query("cluster_group_spread_emb")
def cluster_group_spread_emb(spark, sf):
    found = cluster_group_means(fx.points_emb(spark, sf), fx.centers_emb(spark, sf))
    return found.select("cluster", "g", "n", rounded("spread"))


@query("fair_fixed_cost")
def fair_fixed_cost_li(spark, sf):
    found = fair_fixed_cost(fx.points_li(spark, sf), fx.CENTERS_LI)
    return found.select(rounded("fixed_a"), rounded("fixed_b"))


@query("fair_fixed_cost_three")
def fair_fixed_cost_three(spark, sf):
    found = fair_fixed_cost(fx.points_three(spark, sf), fx.CENTERS_THREE)
    return found.select(rounded("fixed_a"), rounded("fixed_b"))


@query("cluster_shares")
def cluster_shares_li(spark, sf):
    return cluster_shares(fx.points_li(spark, sf), fx.CENTERS_LI).select("cluster", "g", rounded("share"))


@query("mean_gap")
def mean_gap_li(spark, sf):
    return mean_gap(fx.points_li(spark, sf), fx.CENTERS_LI).select("cluster", rounded("ell"))


def _lloyd(rounds: int, points, centers) -> Query:
    def run(spark, sf):
        return exploded(lloyd(points(spark, sf), centers, rounds), "c", "cluster")

    return run


def _fair(rounds: int, points, centers, other: str = "error") -> Query:
    def run(spark, sf):
        found = fair_lloyd(
            points(spark, sf), m=rounds, init_centers=centers, other=other
        )
        return exploded(found, "c", "cluster")

    return run


for _rounds in (1, 3):
    QUERIES[f"lloyd_{_rounds}"] = _lloyd(_rounds, fx.points_li, fx.CENTERS_LI)
    QUERIES[f"fair_lloyd_{_rounds}"] = _fair(_rounds, fx.points_li, fx.CENTERS_LI)
    QUERIES[f"fair_lloyd_three_{_rounds}"] = _fair(_rounds, fx.points_three, fx.CENTERS_THREE, "as_b")


@query("fair_lloyd_auto")
def fair_lloyd_auto(spark, sf):
    return exploded(fair_lloyd(fx.points_li(spark, sf), 3, 5, SEED), "c", "cluster")


@query("fair_lloyd_emb")
def fair_lloyd_emb(spark, sf):
    found = fair_lloyd(fx.points_emb(spark, sf), m=3, init_centers=fx.centers_emb(spark, sf))
    return exploded(found, "c", "cluster")


@query("fair_lloyd_emb_bounded")
def fair_lloyd_emb_bounded(spark, sf):
    centers = fx.centers_emb(spark, sf)
    return exploded(fair_lloyd(fx.points_emb(spark, sf), m=3, init_centers=centers, bounded=True), "c", "cluster")


@query("lloyd_bounded")
def lloyd_bounded(spark, sf):
    return exploded(lloyd(fx.points_li(spark, sf), fx.CENTERS_LI, 3, bounded=True), "c", "cluster")


@query("kmeans_standard")
def kmeans_standard(spark, sf):
    points = fx.points_li(spark, sf)
    return exploded(standard_centers(points, 3, 10, SEED), "c", "cluster")


@query("kmeans_init")
def kmeans_init(spark, sf):
    points = fx.points_li(spark, sf)
    return exploded(initial_centers(points, 3, SEED), "c", "cluster")


@query("compare_fairness")
def compare_fairness_li(spark, sf):
    found = compare_fairness(fx.points_li(spark, sf), 3, 5, SEED)
    timed = [(F.col(name) >= 0).alias(name.removesuffix("_ms")) for name in found.columns if name.endswith("_ms")]
    return found.select(rounded("phi_std", 4), rounded("phi_fair", 4), *timed)


@query("fair_objectives")
def fair_objectives_li(spark, sf):
    """Several centre sets in one scan."""
    sets = [fx.CENTERS_LI, fx.CENTERS_LI[:2], fx.CENTERS_LI[::-1]]
    found = fair_objectives(fx.points_li(spark, sf), sets)
    return found.select("set", rounded("delta_a"), rounded("delta_b"), rounded("phi"))


# Items: parsing, hashing, sketches


@query("parse_items")
def parse_items_part(spark, sf):
    lines = fx.items(spark, sf, "part").select(F.col("item").cast("string").alias("value"))
    return parse_items(lines)


@query("items_permissive")
def items_permissive(spark, sf):
    item = F.col("item")
    value = F.when(item % 5 == 0, F.concat(item.cast("string"), F.lit("x"))).otherwise(item.cast("string"))
    items, rejects = parse_items(fx.items(spark, sf, "part").select(value.alias("value")), "permissive")
    accepted = items.select(F.lit(True).alias("accepted"), F.col("item").cast("string").alias("value"))
    return accepted.union(rejects.select(F.lit(False), "value"))


@query("hash_bucket")
def hash_buckets(spark, sf):
    columns = [hash_bucket(h.cm_a, h.cm_b, W_PART, "item", fx.PRIME).alias(f"b{d}") for d, h in enumerate(fx.HASHES)]
    return fx.items(spark, sf, "order").select("item", *columns)


@query("hash_sign")
def hash_signs(spark, sf):
    columns = [hash_sign(h.sg_a, h.sg_b, "item", fx.PRIME).alias(f"s{d}") for d, h in enumerate(fx.HASHES)]
    return fx.items(spark, sf, "order").select("item", *columns)


@query("hash_wide")
def hash_wide(spark, sf):
    """Buckets and signs modulo 2^61 - 1 of items far beyond 32 bits, negative ones included."""
    columns = [
        column
        for d, h in enumerate(fx.WIDE_HASHES)
        for column in (
            hash_bucket(h.cm_a, h.cm_b, W_PART, "item", WIDE_PRIME).alias(f"b{d}"),
            hash_sign(h.sg_a, h.sg_b, "item", WIDE_PRIME).alias(f"s{d}"),
        )
    ]
    return fx.items(spark, sf, "wide").select("item", *columns)


@query("cs_cells_wide")
def cs_cells_wide(spark, sf):
    return cs_build(fx.items(spark, sf, "wide"), fx.WIDE_HASHES, W_PART, WIDE_PRIME)


@query("hash_family")
def hash_family_load(spark, sf):
    return cms_build(fx.items(spark, sf, "order"), draw_rows(3, DEFAULT_PRIME, SEED), W_PART)


def _hist(spark, sf, name: str) -> DataFrame:
    return item_hist(fx.items(spark, sf, name))


@query("item_hist")
def item_hist_skew(spark, sf):
    return _hist(spark, sf, "skew")


@query("item_hist_merged")
def item_hist_merged(spark, sf):
    """Histogram of two tables' items, merged from their own histograms."""
    return merge_hists(_hist(spark, sf, "part"), _hist(spark, sf, "user"))


@query("stream_summary")
def stream_summary_part(spark, sf):
    return stream_summary(_hist(spark, sf, "part"))


@query("distinct_merged")
def distinct_merged(spark, sf):
    """Distinct users and order keys from the sketches of days and return flags, each within three standard errors."""
    days = fx.table(spark, sf, "events").select(F.to_date("ts").alias("batch"), F.col("user_id").alias("item"))
    flags = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("batch"), F.col("l_orderkey").alias("item"))
    rows = []
    for name, source in (("users", days), ("orders", flags)):
        exact = source.agg(F.count_distinct("item").alias("n"))
        found = merged_distinct(distinct_sketch(source, "batch"))
        close = F.abs(F.col("n") - found.scalar()) <= F.greatest(F.lit(1.0), 3 * 1.04 / 64 * F.col("n"))
        rows.append(exact.select(F.lit(name).alias("name"), "n", close.alias("close")))
    return rows[0].union(rows[1])


@query("top_k_merged")
def top_k_merged(spark, sf):
    """The items of the skewed stream, all fewer than the capacity, from the accumulators of the return flags."""
    source = fx.table(spark, sf, "lineitem").selectExpr("l_returnflag as batch", f"{fx.ITEMS['skew'][1]} as item")
    return merged_top_k(top_k_sketch(source, "batch"), 10_000)


@query("cms_cells")
def cms_cells(spark, sf):
    return cms_build(_hist(spark, sf, "skew"), fx.HASHES[:3], W_SKEW, fx.PRIME)


@query("cs_cells")
def cs_cells(spark, sf):
    return cs_build(_hist(spark, sf, "skew"), fx.HASHES[:3], W_SKEW, fx.PRIME)


@query("cms_merge")
def cms_merge(spark, sf):
    parts = [cms_build(fx.items(spark, sf, name), fx.HASHES, W_PART, fx.PRIME) for name in ("part", "user")]
    return merge_sketches(*parts)


@query("cs_merge")
def cs_merge(spark, sf):
    parts = [cs_build(fx.items(spark, sf, name), fx.HASHES, W_PART, fx.PRIME) for name in ("part", "user")]
    return merge_sketches(*parts)


@query("frequency_tables")
def frequency_tables_skew(spark, sf):
    """Histogram and both sketches from one scan and one shuffle."""
    return frequency_tables(fx.items(spark, sf, "skew"), fx.HASHES[:3], W_SKEW, fx.PRIME)


def _estimates(builder, estimator, stream: str, rows: int, w: int, prime: int) -> Query:
    def run(spark, sf):
        hist = materialize(_hist(spark, sf, stream))
        hashes = fx.HASHES[:rows]
        return estimator(hist, builder(hist, hashes, w, prime), hashes, w, prime)

    return run


@query("stored_estimates")
def stored_estimates(spark, sf):
    """Both estimates of every item from sketches stored by cell, read as they lie."""
    hist = materialize(_hist(spark, sf, "order"))
    hashes, w = fx.HASHES, W_ORDER
    cms, cs = cms_build(hist, hashes, w, DEFAULT_PRIME), cs_build(hist, hashes, w, DEFAULT_PRIME)
    stored = store_sketches(hashes, w, cms, cs, buckets=16)
    found = materialize(sketch_estimates(hist, hashes, w, DEFAULT_PRIME, stored=stored))
    stored.drop()
    return found


QUERIES["cms_estimate"] = _estimates(cms_build, cms_estimate, "part", 3, W_PART, fx.PRIME)
QUERIES["cs_estimate"] = _estimates(cs_build, cs_estimate, "part", 3, W_PART, fx.PRIME)
QUERIES["cs_estimate_even"] = _estimates(cs_build, cs_estimate, "part", 4, W_PART, fx.PRIME)
QUERIES["cms_estimate_order"] = _estimates(cms_build, cms_estimate, "order", 4, W_ORDER, DEFAULT_PRIME)
QUERIES["cs_estimate_skew"] = _estimates(cs_build, cs_estimate, "skew", 4, W_SKEW, fx.PRIME)


# Heavy hitters


@query("phi_k")
def phi_k_part(spark, sf):
    return phi_k(_hist(spark, sf, "part"), TOP_K)


@query("phi_k_large")
def phi_k_large(spark, sf):
    return phi_k(_hist(spark, sf, "order"), LARGE_K)


@query("heavy_hitters")
def heavy_hitters_part(spark, sf):
    return heavy_hitters(_hist(spark, sf, "part"), TOP_K)


@query("heavy_hitters_once")
def heavy_hitters_once(spark, sf):
    return heavy_hitters(_hist(spark, sf, "once"), TOP_K)


def _both(spark, sf, stream: str, w: int):
    hist = materialize(_hist(spark, sf, stream))
    return hist, cms_build(hist, fx.HASHES, w, fx.PRIME), cs_build(hist, fx.HASHES, w, fx.PRIME)


@query("frequent_item_estimates")
def frequent_item_estimates_part(spark, sf):
    hist, cms, cs = _both(spark, sf, "part", W_PART)
    return frequent_item_estimates(hist, cms, cs, fx.HASHES, W_PART, fx.PRIME)


def _topk_error(stream: str, w: int) -> Query:
    def run(spark, sf):
        hist, cms, cs = _both(spark, sf, stream, w)
        est_cm = cms_estimate(hist, cms, fx.HASHES, w, fx.PRIME)
        est_cs = cs_estimate(hist, cs, fx.HASHES, w, fx.PRIME)
        found = topk_error(hist, est_cm, est_cs, TOP_K)
        return found.select("n_top", rounded("err_cm"), rounded("err_cs"))

    return run


QUERIES["topk_error"] = _topk_error("part", W_PART)
QUERIES["topk_error_once"] = _topk_error("once", W_PART)


@query("heavy_hitter_listing")
def heavy_hitter_listing_part(spark, sf):
    hist, cms, _ = _both(spark, sf, "part", W_PART)
    est_cm = cms_estimate(hist, cms, fx.HASHES, W_PART, fx.PRIME)
    return heavy_hitter_listing(hist, est_cm, TOP_K)


def _report(stream: str, w: int, k: int = TOP_K):
    def run(spark, sf):
        return heavy_hitter_report(_hist(spark, sf, stream), fx.HASHES, w, k, fx.PRIME)

    return run


@query("heavy_hitter_report_skew")
def heavy_hitter_report_skew(spark, sf):
    summary = _report("skew", W_SKEW)(spark, sf).summary
    return summary.select("n_items", "n_distinct", "n_top", rounded("err_cm"), rounded("err_cs"))


@query("heavy_hitter_report")
def heavy_hitter_report_part(spark, sf):
    summary = _report("part", W_PART)(spark, sf).summary
    return summary.select("n_items", "n_distinct", "n_top", rounded("err_cm"), rounded("err_cs"))


@query("heavy_hitter_report_listing")
def heavy_hitter_report_listing(spark, sf):
    return _report("part", W_PART)(spark, sf).listing


# Streams


@query("prefix_until_t")
def prefix_until_t_days(spark, sf):
    days = fx.table(spark, sf, "events").select(F.to_date("ts").alias("batch"))
    kept = prefix_until_t(days.groupBy("batch").agg(F.count("*").alias("n")), PREFIX_T)
    return kept.select(F.col("batch").cast("string").alias("batch"), "n", "prior")


def _stream(spark, sf, stream: str) -> DataFrame:
    """The items of a given table as a file stream, at most one of its files for each micro-batch."""
    name, expression = fx.ITEMS[stream]
    path = f"{sf}/{name}.parquet"
    options = {"path": file_pattern(path), "maxFilesPerTrigger": "1"}
    return read_items(spark, "parquet", options, column=expression, schema=spark.read.parquet(path).schema)


def _streamed(start, *args) -> tuple[SparkSession, str]:
    """Run a stateful stream over what is there."""
    spark = args[0].sparkSession
    out_dir, checkpoint = new_path(spark, "stream-tables"), new_path(spark, "stream-checkpoint")
    start(*args, out_dir, checkpoint, trigger={"availableNow": True}).awaitTermination()
    return spark, out_dir


@query("stream_hist")
def stream_hist(spark, sf):
    return streams.read_hist(*_streamed(streams.stream_hist, _stream(spark, sf, "skew")))


def _stream_sketch(start) -> Query:
    def run(spark, sf):
        begin = partial(start, prime=fx.PRIME)
        return streams.read_sketch(*_streamed(begin, _stream(spark, sf, "part"), fx.HASHES, W_PART))

    return run


QUERIES["stream_cms"] = _stream_sketch(streams.stream_cms)
QUERIES["stream_cs"] = _stream_sketch(streams.stream_cs)


@query("stream_tables")
def stream_tables(spark, sf):
    begin = partial(streams.stream_tables, prime=fx.PRIME)
    return streams.read_tables(*_streamed(begin, _stream(spark, sf, "skew"), fx.HASHES[:3], W_SKEW))


@query("batch_table")
def batch_table(spark, sf):
    """Histogram of a table that arrives in one delta for each 25 days of shipping, 100 of them, merged level by level."""
    source, item = fx.ITEMS["order"]
    folder = new_path(spark, "deltas")
    period = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / DELTA_DAYS).alias("period")
    cut = item_hist(fx.table(spark, sf, source).select(F.struct(period, F.expr(item).alias("item")).alias("item")))
    cut.select("item.*", "freq").hint("rebalance", "period").write.partitionBy("period").parquet(folder)
    deltas = spark.read.schema("item bigint, freq bigint, period int").parquet(folder)
    first, last = deltas.agg(F.min("period"), F.max("period")).head()
    table = BatchTable(spark, new_path(spark, "batch-table"), "item bigint, freq bigint", ["item"], "freq")
    for number in range(last - first + 1):
        table.write(deltas.where(F.col("period") == first + number).select("item", "freq"), number)
    return table.read()


def _prefix_run(spark, sf) -> streams.PrefixRun:
    """One query over the given files that stops after ``PREFIX_T`` items, or when nothing is left."""
    out_dir, checkpoint = new_path(spark, "prefix-tables"), new_path(spark, "prefix-checkpoint")
    items = _stream(spark, sf, "user")
    run = streams.stream_sketches(items, fx.HASHES, W_SKEW, PREFIX_T, out_dir, checkpoint, fx.PRIME)
    run.wait(until_idle=True)
    return run


@query("stream_prefix")
def stream_prefix(spark, sf):
    return _prefix_run(spark, sf).hist()


@query("stream_prefix_report")
def stream_prefix_report(spark, sf):
    run = _prefix_run(spark, sf)
    report = heavy_hitter_report(run.hist(), fx.HASHES, W_SKEW, TOP_K, fx.PRIME, cms=run.cms(), cs=run.cs())
    return report.summary.select("n_items", "n_distinct", "n_top", rounded("err_cm"), rounded("err_cs"))
