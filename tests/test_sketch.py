"""Sketches, heavy hitters and running totals against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenhand.functions.hashing import (
    DEFAULT_PRIME,
    WIDE_PRIME,
    HashRow,
    draw_rows,
    hash_bucket,
    hash_rows,
    hash_sign,
    hash_table,
    make_hashes,
)
from evenhand.operators import heavy, sketch
from evenhand.operators.heavy import (
    frequent_item_estimates,
    heavy_hitter_listing,
    heavy_hitters,
    phi_k,
    topk_error,
)
from evenhand.operators.prefix import prefix_until_t, with_prior_total
from evenhand.operators.sketch import (
    approx_distinct,
    cms_build,
    cms_estimate,
    cs_build,
    cs_estimate,
    distinct_sketch,
    item_hist,
    merge_sketches,
    merged_distinct,
    merged_top_k,
    sketch_estimates,
    store_sketches,
    stream_summary,
    top_k_sketch,
)
from evenhand.plans.frequencies import heavy_hitter_report
from evenhand.sources.items import parse_items

ROWS = draw_rows(4, 8191, seed=2)


def bucket(a, b, c, x, prime):
    return (a * x + b) % prime % c


def sign(a, b, x, prime):
    return 1 if (a * x + b) % prime % 2 == 0 else -1


def halved(total):
    return int(total / 2)


def loop_estimates(counts, rows, w, prime):
    cm, cs = np.zeros((len(rows), w), dtype=int), np.zeros((len(rows), w), dtype=int)
    for x, n in counts.items():
        for d, h in enumerate(rows):
            cm[d, bucket(h.cm_a, h.cm_b, w, x, prime)] += n
            cs[d, bucket(h.cs_a, h.cs_b, w, x, prime)] += n * sign(h.sg_a, h.sg_b, x, prime)
    found = {}
    for x in counts:
        low = min(cm[d, bucket(h.cm_a, h.cm_b, w, x, prime)] for d, h in enumerate(rows))
        signed = sorted(
            sign(h.sg_a, h.sg_b, x, prime) * cs[d, bucket(h.cs_a, h.cs_b, w, x, prime)] for d, h in enumerate(rows)
        )
        n = len(rows)
        middle = signed[n // 2] if n % 2 else halved(signed[n // 2] + signed[n // 2 - 1])
        found[x] = (int(low), int(middle))
    return cm, cs, found


def counts_of(seed, n, top):
    draw = np.random.default_rng(seed)
    return {int(x): int(c) for x, c in zip(draw.choice(10**6, n, replace=False), draw.integers(1, top, n))}


def test_hashes_stay_in_range_for_any_item(spark):
    items = [-5, -8192, 0, 8191, 2**62, -(2**63), 2**63 - 1]
    table = spark.createDataFrame([(x,) for x in items], "item bigint")
    for prime in (8191, DEFAULT_PRIME):
        for h in draw_rows(3, prime, seed=1):
            got = table.select("item", hash_bucket(h.cm_a, h.cm_b, 50, "item", prime), hash_sign(h.sg_a, h.sg_b, "item", prime))
            for x, b, s in got.collect():
                assert b == bucket(h.cm_a, h.cm_b, 50, x, prime)
                assert s == sign(h.sg_a, h.sg_b, x, prime)


def test_hash_families(spark):
    assert draw_rows(3, 8191, 5) == draw_rows(3, 8191, 5) != draw_rows(3, 8191, 6)
    for row in draw_rows(200, 101, 7):
        assert all(1 <= a < 101 for a in (row.cm_a, row.cs_a, row.sg_a))
        assert all(0 <= b < 101 for b in (row.cm_b, row.cs_b, row.sg_b))
    assert hash_rows(make_hashes(spark, 3, 8191, 5)) == draw_rows(3, 8191, 5)
    assert hash_rows(hash_table(spark, ROWS)) == ROWS
    for bad in (0, 10_000):
        with pytest.raises(ValueError):
            draw_rows(bad, 8191, 1)
    with pytest.raises(ValueError):
        hash_rows([])
    with pytest.raises(ValueError):
        draw_rows(1, DEFAULT_PRIME + 1, 1)


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("d", [1, 3, 4])
def test_estimates_match_a_loop_with_and_without_broadcast(hist, monkeypatch, d, limit):
    monkeypatch.setattr(sketch, "BROADCAST_CELLS", limit)
    counts = counts_of(d, 300, 40)
    rows, w = ROWS[:d], 37
    _, _, expected = loop_estimates(counts, rows, w, 8191)
    table = hist(counts)
    cms, cs = cms_build(table, rows, w, 8191), cs_build(table, rows, w, 8191)
    found = frequent_item_estimates(table, cms, cs, rows, w, 8191, min_freq=1)
    assert {r.item: (r.est_cm, r.est_cs) for r in found.collect()} == expected
    assert {r.item: r.est for r in cms_estimate(table, cms, rows, w, 8191).collect()} == {x: e[0] for x, e in expected.items()}
    assert {r.item: r.est for r in cs_estimate(table, cs, rows, w, 8191).collect()} == {x: e[1] for x, e in expected.items()}


def test_items_outside_the_sketch_and_repeated_items(spark, hist):
    table = hist({1: 5})
    rows = [HashRow(1, 0, 1, 0, 1, 0)]
    cms, cs = cms_build(table, rows, 100, 8191), cs_build(table, rows, 100, 8191)
    asked = spark.createDataFrame([(1,), (1,), (2,)], "item bigint")
    assert {r.item: r.est for r in cms_estimate(asked, cms, rows, 100, 8191).collect()} == {1: 5, 2: 0}
    assert {r.item: r.est for r in cs_estimate(asked, cs, rows, 100, 8191).collect()} == {1: 5, 2: 0}


def test_broadcast_lookup_moves_no_row_of_a_histogram(spark):
    items = spark.range(1000).select((F.col("id") % 50).alias("item"))
    counted = item_hist(items)
    cms, cs = cms_build(items, ROWS, 20, 8191), cs_build(items, ROWS, 20, 8191)
    plan = frequent_item_estimates(counted, cms, cs, ROWS, 20, 8191)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(item") == 1


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 10**9), st.integers(1, 1000), min_size=1, max_size=40))
def test_sketch_properties(hist, counts):
    table, w = hist(counts), 11
    total = sum(counts.values())
    cms, cs = cms_build(table, ROWS, w), cs_build(table, ROWS, w)
    assert {r.d: r.s for r in cms.groupBy("d").agg(F.sum("v").alias("s")).collect()} == {d: total for d in range(4)}
    signs = {d: sum(n * sign(h.sg_a, h.sg_b, x, DEFAULT_PRIME) for x, n in counts.items()) for d, h in enumerate(ROWS)}
    assert {r.d: r.s for r in cs.groupBy("d").agg(F.sum("v").alias("s")).collect()} == signs
    assert all(r.est >= counts[r.item] for r in cms_estimate(table, cms, ROWS, w).collect())


def test_merged_halves_are_the_whole(hist):
    counts = counts_of(9, 200, 30)
    items = list(counts.items())
    for build in (cms_build, cs_build):
        halves = [build(hist(dict(part)), ROWS, 23, 8191) for part in (items[:90], items[90:])]
        merged = merge_sketches(*halves)
        assert merged.exceptAll(build(hist(counts), ROWS, 23, 8191)).count() == 0


def test_plain_items_and_their_histogram_give_the_same_sketch(spark):
    items = spark.range(5000).select((F.col("id") % 77).alias("item"))
    for build in (cms_build, cs_build):
        assert build(items, ROWS, 30, 8191).exceptAll(build(item_hist(items), ROWS, 30, 8191)).count() == 0


def test_summary(spark, hist):
    assert tuple(stream_summary(hist({1: 4, 2: 6})).head()) == (10, 2)
    assert tuple(stream_summary(hist({1: 4}).where("item = 9")).head()) == (0, 0)
    many = spark.range(20000).select((F.col("id") % 5000).alias("item"))
    assert abs(approx_distinct(many).head().n_distinct - 5000) < 500


def test_items_from_text(spark):
    table = spark.createDataFrame([("5",), ("-7",), ("x",), ("1.5",), ("9223372036854775808",)], "value string")
    with pytest.raises(Exception):
        parse_items(table).collect()
    good, rejects = parse_items(table, "permissive")
    assert sorted(r.item for r in good.collect()) == [-7, 5]
    assert rejects.count() == 3


@pytest.mark.parametrize("limit", [10_000, 0])
@pytest.mark.parametrize("k", [1, 10, 300, 301])
def test_phi_and_heavy_hitters_in_both_forms(hist, monkeypatch, k, limit):
    monkeypatch.setattr(heavy, "TOP_K_ROWS", limit)
    counts = counts_of(21, 300, 15)
    ordered = sorted(counts.values(), reverse=True)
    phi = ordered[k - 1] if k <= len(ordered) else None
    assert phi_k(hist(counts), k).head().phi == phi
    expected = {} if phi is None else {x: n for x, n in counts.items() if n >= phi}
    assert {r.item: r.freq for r in heavy_hitters(hist(counts), k).collect()} == expected


def test_errors_and_listing(hist):
    counts = {x: 50 - x for x in range(20)} | {x: 1 for x in range(100, 160)}
    w = 9
    _, _, expected = loop_estimates(counts, ROWS, w, 8191)
    table = hist(counts)
    cms, cs = cms_build(table, ROWS, w, 8191), cs_build(table, ROWS, w, 8191)
    est_cm, est_cs = cms_estimate(table, cms, ROWS, w, 8191), cs_estimate(table, cs, ROWS, w, 8191)
    for k in (3, 25, 81):
        phi = sorted(counts.values(), reverse=True)[k - 1] if k <= len(counts) else None
        top = {x: n for x, n in counts.items() if phi is not None and n >= phi}
        shown = {x: expected[x] if n >= 2 else (0, 0) for x, n in top.items()}
        report = heavy_hitter_report(table, ROWS, w, k, 8191, materialized=k == 3)
        row = report.summary.head()
        assert (row.n_items, row.n_distinct, row.n_top) == (sum(counts.values()), len(counts), len(top))
        errors = topk_error(table, est_cm, est_cs, k).collect()
        if not top:
            assert errors == [] and row.err_cm is None and report.listing.count() == 0
            continue
        means = [np.mean([abs(n - shown[x][i]) / n for x, n in top.items()]) for i in (0, 1)]
        assert (row.err_cm, row.err_cs) == pytest.approx(means)
        assert (errors[0].n_top, errors[0].err_cm, errors[0].err_cs) == pytest.approx((len(top), *means))
        listed = [(x, counts[x], shown[x][0]) for x in sorted(top)][:k] if k <= 10 else []
        assert [tuple(r) for r in report.listing.collect()] == listed
        assert [tuple(r) for r in heavy_hitter_listing(table, est_cm, k).collect()] == listed


def test_listing_follows_the_item_id_when_ties_exceed_k(hist):
    table = hist({9: 5, 1: 3, 2: 3, 3: 3})
    est = table.select("item", F.col("freq").alias("est"))
    assert [r.item for r in heavy_hitter_listing(table, est, 2).collect()] == [1, 2]


def test_fewer_items_than_k(hist):
    table = hist({1: 2, 2: 2, 3: 1})
    assert heavy_hitters(table, 5).count() == 0
    with pytest.raises(ValueError):
        heavy_hitters(table, 0)


@pytest.mark.parametrize("ranges", [2, 7, 128])
def test_running_total_over_ranges(spark, ranges):
    draw = np.random.default_rng(ranges)
    order, value = draw.permutation(500).tolist(), draw.integers(0, 50, 500).tolist()
    table = spark.createDataFrame(list(zip(order, value)), "o bigint, v bigint").repartition(6)
    found = {r.o: r.prior for r in with_prior_total(table, "o", "v", ranges=ranges).collect()}
    by_order = dict(zip(order, value))
    total, expected = 0, {}
    for o in range(500):
        expected[o] = total
        total += by_order[o]
    assert found == expected


def test_prefix_takes_the_crossing_batch_whole(spark):
    batches = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "batch bigint, n bigint")
    assert sorted(r.batch for r in prefix_until_t(batches, 20).collect()) == [1, 2]
    assert sorted(r.batch for r in prefix_until_t(batches, 21).collect()) == [1, 2, 3]
    assert sorted(r.batch for r in prefix_until_t(batches, 1000).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        prefix_until_t(batches, 0)


def test_wide_hash_equals_exact_arithmetic(spark):
    draw = random.Random(8)
    items = [0, 1, -1, 2**63 - 1, -(2**63), 2**61 - 1, 2**61 - 2, 2147483647, *(draw.randrange(-(2**63), 2**63) for _ in range(200))]
    coefficients = [(WIDE_PRIME - 1, WIDE_PRIME - 1), (1, 0), (2**31 - 1, 2**31), (2**31, 5)]
    coefficients += [(draw.randrange(1, WIDE_PRIME), draw.randrange(WIDE_PRIME)) for _ in range(6)]
    frame = spark.createDataFrame([(x,) for x in items], "item bigint")
    for a, b in coefficients:
        found = frame.select("item", hash_bucket(a, b, 1000, "item", WIDE_PRIME).alias("b"), hash_sign(a, b, "item", WIDE_PRIME).alias("s"))
        for row in found.collect():
            exact = (a * row.item + b) % WIDE_PRIME
            assert (row.b, row.s) == (exact % 1000, 1 if exact % 2 == 0 else -1)


def test_wide_hash_tells_items_apart_that_the_default_does_not(spark):
    items = spark.createDataFrame([(5 + i * DEFAULT_PRIME,) for i in range(200)], "item bigint")
    for prime, cells in ((DEFAULT_PRIME, 1), (WIDE_PRIME, 150)):
        rows = draw_rows(1, prime, seed=3)
        assert cms_build(items, rows, 1000, prime).count() >= cells
    assert cms_build(items, draw_rows(1, DEFAULT_PRIME, 3), 1000).count() == 1
    with pytest.raises(ValueError):
        draw_rows(1, WIDE_PRIME - 2, 3)


def test_distinct_sketches_merge_in_any_order(spark):
    items = spark.range(20_000).selectExpr("id % 7 as batch", "id * 7919 % 9000 as item")
    whole = merged_distinct(distinct_sketch(items)).head()[0]
    parts = [distinct_sketch(items.where(f"batch = {i}"), "batch") for i in range(7)]
    assert {merged_distinct(*order).head()[0] for order in (parts, parts[::-1], parts[3:] + parts[:3])} == {whole}
    assert abs(whole - 9000) < 3 * 1.04 / 64 * 9000
    assert merged_distinct(distinct_sketch(items.limit(0), "batch")).head()[0] == 0


def test_top_k_accumulators_agree_with_the_heavy_hitters(spark):
    items = spark.range(5000).selectExpr("id % 5 as batch", "cast(sqrt(id) as bigint) as item")
    found = merged_top_k(top_k_sketch(items, "batch"), 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, heavy_hitters(item_hist(items), 10).collect()))


def test_stored_sketch_is_looked_up_where_it_lies(spark, monkeypatch):
    """Same estimates as from plain tables, and only the probes are shuffled."""
    monkeypatch.setattr(sketch, "BROADCAST_CELLS", 0)
    draw = random.Random(9)
    hist = spark.createDataFrame([(i, draw.randrange(1, 50)) for i in range(300)], "item bigint, freq bigint")
    rows = draw_rows(3, DEFAULT_PRIME, 2)
    cms, cs = cms_build(hist, rows, 40), cs_build(hist, rows, 40)
    plain = sketch_estimates(hist, rows, 40, cms=cms, cs=cs)
    for one, two in ((cms, cs), (cms, None), (None, cs)):
        stored = store_sketches(rows, 40, cms=one, cs=two, buckets=4)
        try:
            found = sketch_estimates(hist, rows, 40, stored=stored)
            expected = plain.select(found.columns)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count("Exchange hashpartitioning(slot") == 1
        finally:
            stored.drop()
    with pytest.raises(ValueError):
        sketch_estimates(hist, rows, 40)
