"""Assignment, objectives and Lloyd rounds against plain loops on small data."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from evenhand.operators import assignment
from evenhand.operators.assignment import assign
from evenhand.operators.fair import (
    balance,
    cluster_group_means,
    cluster_shares,
    fair_fixed_cost,
    fair_lloyd,
    lloyd,
    mean_gap,
)
from evenhand.operators.groups import (
    cluster_stats,
    fair_objective,
    group_counts,
    group_filter,
    group_hist,
    standard_objective,
)
from evenhand.operators.kmeans import initial_centers, standard_centers
from evenhand.operators.moments import cluster_moments
from evenhand.plans.clustering import compare_fairness, evaluate_clustering
from evenhand.sources.points import generate_fair_points


def sample(n, d, seed, labels=("A", "B"), spread=1.0, at=0.0):
    draw = np.random.default_rng(seed)
    x = at + spread * draw.normal(size=(n, d))
    return [(row.tolist(), labels[draw.integers(len(labels))]) for row in x]


def matrix(centers):
    return np.array([r.c for r in sorted(centers.collect(), key=lambda r: r.cluster)])


def nearest(rows, c):
    x = np.array([r[0] for r in rows])
    d2 = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return d2.argmin(axis=1), d2.min(axis=1)


@pytest.mark.parametrize("k,d", [(1, 1), (3, 2), (5, 3), (2, 20), (7, 12), (40, 5)])
def test_assign_matches_a_loop_in_every_form(points, k, d):
    rows = sample(300, d, seed=k * d)
    c = np.random.default_rng(1).normal(size=(k, d))
    index, d2 = nearest(rows, c)
    found = assign(points(rows), c)
    assert found.columns == ["x", "g", "cluster", "dist2"]
    expected = sorted((tuple(map(float, r[0])), int(i), round(v, 9)) for r, i, v in zip(rows, index, d2))
    assert sorted((tuple(r.x), r.cluster, round(r.dist2, 9)) for r in found.collect()) == expected


def test_centre_blocks_give_the_same_result(points, monkeypatch):
    rows = sample(200, 4, seed=2)
    c = np.random.default_rng(3).normal(size=(23, 4))
    c[20] = c[4]
    index, d2 = nearest(rows, c)
    monkeypatch.setattr(assignment, "BLOCK_BYTES", 5 * 4 * 8)
    found = assignment._assign_arrow(points(rows), c, ["g"])
    assert found.columns == ["g", "cluster", "dist2"]
    got = sorted((r.cluster, round(r.dist2, 9)) for r in found.collect())
    assert got == sorted((int(i), round(v, 9)) for i, v in zip(index, d2))


@pytest.mark.parametrize("form", ["_assign_unrolled", "_assign_arrow"])
def test_ties_go_to_the_smallest_cluster(points, form):
    c = np.array([[-1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]])
    rows = [([0, 0], "A"), ([0, 5], "B"), ([-2, 0], "A"), ([2, 0], "B")]
    found = getattr(assignment, form)(points(rows), c, ["x"])
    assert {tuple(r.x): r.cluster for r in found.collect()} == {(0, 0): 0, (0, 5): 0, (-2, 0): 0, (2, 0): 1}


@pytest.mark.parametrize("form", ["_assign_unrolled", "_assign_arrow"])
def test_wrong_dimension_is_an_error(points, form):
    with pytest.raises(PySparkException):
        getattr(assignment, form)(points([([1, 2, 3], "A")]), np.zeros((2, 2)), ["x"]).collect()


def test_filter_on_the_cluster_keeps_one_distance_computation(points):
    found = assign(points(sample(50, 2, seed=9)), np.eye(2)).where("cluster = 1")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("least(") == 1


def test_counts_and_label_rules(points):
    three = points([([0], "A"), ([0], "B"), ([0], "C"), ([9], "C"), ([9], "A")])
    assert tuple(group_counts(three).head()) == (5, 2, 1)
    assert {r.g: r.n for r in group_hist(three).collect()} == {"A": 2, "B": 1, "C": 2}
    assert group_filter(three, "B").count() == 1
    stats = cluster_stats(three, [[0.0], [9.0], [50.0]]).collect()
    assert {r.cluster: (list(r.center), r.n_a, r.n_b) for r in stats} == {
        0: ([0.0], 1, 2),
        1: ([9.0], 1, 1),
        2: ([50.0], 0, 0),
    }


def test_objectives(points, spark):
    rows = sample(100, 2, seed=4, labels=("A", "B", "C"))
    c = np.array([[0.0, 0.0], [1.0, 1.0]])
    _, d2 = nearest(rows, c)
    g = np.array([r[1] for r in rows])
    table = points(rows)
    assert standard_objective(table, c).head().delta == pytest.approx(d2.mean())
    fair = fair_objective(table, c).head()
    assert (fair.delta_a, fair.delta_b) == pytest.approx((d2[g == "A"].mean(), d2[g == "B"].mean()))
    assert fair.phi == max(fair.delta_a, fair.delta_b)
    for materialized in (False, True):
        report = evaluate_clustering(table, c, materialized)
        row = report.summary.head()
        assert (row.n, row.n_a, row.n_b) == (100, (g == "A").sum(), (g == "B").sum())
        assert (row.delta, row.phi) == pytest.approx((d2.mean(), fair.phi))
        assert sum(r.n_a + r.n_b for r in report.clusters.collect()) == 100


def test_empty_inputs_have_objective_zero(points):
    none = points([])
    assert standard_objective(none, [[0.0]]).head().delta == 0.0
    assert fair_objective(none, [[0.0]]).head().phi == 0.0
    report = evaluate_clustering(none, [[0.0], [1.0]])
    assert tuple(report.summary.head()) == (0, 0, 0, 0.0, 0.0)
    assert [(r.n_a, r.n_b) for r in report.clusters.collect()] == [(0, 0), (0, 0)]
    some = points([([1], "A")])
    assert standard_objective(some, []).head().delta == 0.0
    assert fair_objective(some, []).head().phi == 0.0
    one_group = fair_objective(some, [[0.0]]).head()
    assert tuple(one_group) == (1.0, 0.0, 1.0)


@pytest.mark.parametrize("k,d,at", [(3, 2, 0.0), (4, 20, 0.0), (3, 2, 1e6), (2, 40, 1e6)])
def test_moments_match_a_loop_in_both_forms(points, k, d, at):
    rows = sample(400, d, seed=d, at=at)
    c = at + np.random.default_rng(5).normal(size=(k, d))
    index, _ = nearest(rows, c)
    x = np.array([r[0] for r in rows])
    side = np.array([0 if r[1] == "A" else 1 for r in rows])
    found = {(r.cluster, r.side): r for r in cluster_moments(points(rows, 7), c).collect()}
    assert set(found) == set(zip(index.tolist(), side.tolist()))
    for (i, s), r in found.items():
        members = x[(index == i) & (side == s)]
        assert r.n == r.n_exact == len(members)
        np.testing.assert_allclose(r["mean"], members.mean(axis=0), rtol=1e-12)
        assert r.spread == pytest.approx(((members - members.mean(axis=0)) ** 2).sum(), rel=1e-7)


def loop_rounds(rows, c, m, compat):
    """One plain pass after the other: the definition of the fair rounds for labels A and not A."""
    x = np.array([r[0] for r in rows], dtype=float)
    a = np.array([r[1] == "A" for r in rows])
    total_b = sum(r[1] == "B" for r in rows)
    c = np.array(c, dtype=float)
    for _ in range(m):
        index, _ = nearest(rows, c)
        k, d = c.shape
        mu = np.zeros((2, k, d))
        n = np.zeros((2, k))
        for i in range(k):
            for s, members in enumerate((x[(index == i) & a], x[(index == i) & ~a])):
                n[s, i] = len(members)
                if len(members):
                    mu[s, i] = members.mean(axis=0)
            if compat:
                for j in range(d):
                    if mu[0, i, j] == 0:
                        mu[0, i, j] = mu[1, i, j]
                    if mu[1, i, j] == 0:
                        mu[1, i, j] = mu[0, i, j]
            elif n[0, i] == 0:
                mu[0, i] = mu[1, i]
            elif n[1, i] == 0:
                mu[1, i] = mu[0, i]
        totals = np.array([a.sum(), total_b], dtype=float)
        own = np.where(a, 0, 1)
        cost = ((x - mu[own, index]) ** 2).sum(axis=1)
        fixed = [cost[a].sum() / totals[0] if totals[0] else 0.0, cost[~a].sum() / totals[1] if totals[1] else 0.0]
        gaps = np.sqrt(((mu[0] - mu[1]) ** 2).sum(axis=1))
        shares = np.array([n[s] / totals[s] if totals[s] else np.zeros(k) for s in (0, 1)])
        offsets = balance(np.array(fixed), shares, gaps, compat)
        for i in range(k):
            if n[:, i].sum() == 0 and not compat:
                continue
            c[i] = mu[0, i] if gaps[i] == 0 else ((gaps[i] - offsets[i]) * mu[0, i] + offsets[i] * mu[1, i]) / gaps[i]
    return c


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("k,d", [(3, 2), (5, 20)])
def test_fair_rounds_match_a_loop(points, k, d, compat):
    rows = sample(250, d, seed=11 + d)
    start = np.random.default_rng(6).normal(size=(k, d))
    found = matrix(fair_lloyd(points(rows), m=4, init_centers=start, compat=compat))
    np.testing.assert_allclose(found, loop_rounds(rows, start, 4, compat), rtol=1e-9)


def test_mean_of_exactly_zero(points):
    rows = [([-1, 5], "A"), ([1, 5], "A"), ([4, 5], "B")]
    start = [[0.0, 0.0]]
    for compat in (False, True):
        found = matrix(fair_lloyd(points(rows), m=1, init_centers=start, compat=compat))
        np.testing.assert_allclose(found, loop_rounds(rows, start, 1, compat))
    assert found[0, 0] == 4.0
    assert matrix(fair_lloyd(points(rows), m=1, init_centers=start))[0, 0] < 4.0


def test_empty_cluster(points):
    rows = sample(50, 2, seed=8)
    start = [[0.0, 0.0], [1000.0, 1000.0]]
    kept = matrix(fair_lloyd(points(rows), m=2, init_centers=start))
    assert kept[1].tolist() == [1000.0, 1000.0]
    np.testing.assert_allclose(kept, loop_rounds(rows, start, 2, False), rtol=1e-9)
    moved = matrix(fair_lloyd(points(rows), m=1, init_centers=start, compat=True))
    assert moved[1].tolist() == [0.0, 0.0]
    np.testing.assert_allclose(moved, loop_rounds(rows, start, 1, True), rtol=1e-9)
    assert matrix(lloyd(points(rows), start, 2))[1].tolist() == [1000.0, 1000.0]


def test_third_labels(points):
    rows = sample(90, 2, seed=13, labels=("A", "B", "C"))
    start = [[0.0, 0.0], [1.0, 1.0]]
    with pytest.raises(ValueError):
        fair_lloyd(points(rows), m=1, init_centers=start)
    found = matrix(fair_lloyd(points(rows), m=2, init_centers=start, other="as_b"))
    np.testing.assert_allclose(found, loop_rounds(rows, start, 2, False), rtol=1e-9)


def test_single_group(points):
    rows = [(x, "A") for x, _ in sample(60, 2, seed=14)]
    start = [[0.0, 0.0], [1.0, 1.0]]
    found = matrix(fair_lloyd(points(rows), m=3, init_centers=start))
    np.testing.assert_allclose(found, loop_rounds(rows, start, 3, False), rtol=1e-9)
    np.testing.assert_allclose(found, matrix(lloyd(points(rows), start, 3)), rtol=1e-9)
    assert fair_fixed_cost(points(rows), start).head().fixed_b == 0.0
    shares = cluster_shares(points(rows), start).collect()
    assert sum(r.share for r in shares if r.g == "A") == 1.0
    assert [r.share for r in shares if r.g == "B"] == [0.0, 0.0]
    assert {r.ell for r in mean_gap(points(rows), start).collect()} == {0.0}


def test_balanced_groups_meet_halfway():
    shares, gaps = np.array([[0.25, 0.75], [0.25, 0.75]]), np.array([2.0, 6.0])
    np.testing.assert_allclose(balance(np.array([1.0, 1.0]), shares, gaps, False), gaps / 2)


def test_results_do_not_depend_on_partitions(points):
    rows = sample(200, 3, seed=15)
    start = [[0.0] * 3, [1.0] * 3]
    one = matrix(fair_lloyd(points(rows, 1), m=3, init_centers=start))
    many = matrix(fair_lloyd(points(rows, 1), m=3, init_centers=start, num_partitions=11))
    np.testing.assert_allclose(one, many, rtol=1e-12)
    means = [cluster_group_means(points(rows, p), start).orderBy("cluster", "g").collect() for p in (1, 9)]
    np.testing.assert_allclose(*[[r["mean"] for r in found] for found in means], rtol=1e-12)


def test_fewer_distinct_points_than_centres(points):
    rows = [([1], "A"), ([1], "B"), ([2], "A")]
    assert 1 <= standard_centers(points(rows), 5, 3, seed=1).count() <= 5
    assert initial_centers(points(rows), 5, seed=1).count() <= 5
    assert fair_lloyd(points(rows), k=5, m=2, seed=1).count() <= 5


def test_fair_centres_lower_the_fair_objective_on_generated_points(spark):
    gains = 0
    for seed in range(3):
        made = generate_fair_points(spark, 3000, 3, seed)
        row = compare_fairness(made, 3, 5, seed).head()
        assert min(row.t_std_centers_ms, row.t_fair_centers_ms, row.t_std_obj_ms, row.t_fair_obj_ms) >= 0
        gains += row.phi_fair <= row.phi_std
    assert gains >= 2


@pytest.mark.parametrize("wide", [False, True])
def test_null_coordinates_are_refused_in_both_forms(spark, wide):
    """A large centre set goes through Arrow; the answer must not change with it."""
    schema = "x array<double>, g string"
    rows = spark.createDataFrame([([0.0, None], "A"), ([1.0, 1.0], "B"), ([9.0, 9.0], "B")], schema)
    centers = [[0.0, 0.0], [10.0, 10.0], *([[1e6 + i, 1e6] for i in range(60)] if wide else [])]
    for result in (
        lambda: assign(rows, centers),
        lambda: standard_objective(rows, centers),
        lambda: cluster_group_means(rows, centers),
        lambda: lloyd(rows, centers, 1),
    ):
        with pytest.raises(Exception, match="none of them null"):
            result().collect()


def test_centers_without_points_have_zero_rows(points):
    rows = points([([0.0, 0.0], "A"), ([1.0, 0.0], "B"), ([9.0, 9.0], "B")])
    centers = [[0.0, 0.0], [9.0, 9.0], [500.0, 500.0]]
    shares = {(r.cluster, r.g): r.share for r in cluster_shares(rows, centers).collect()}
    assert shares == {(0, "A"): 1.0, (0, "B"): 0.5, (1, "A"): 0.0, (1, "B"): 0.5, (2, "A"): 0.0, (2, "B"): 0.0}
    assert {r.cluster: r.ell for r in mean_gap(rows, centers).collect()} == {0: 1.0, 1: 0.0, 2: 0.0}


def test_report_without_centers(points):
    summary, clusters = evaluate_clustering(points([([0.0], "A"), ([1.0], "B")]), [])
    row = summary.collect()[0]
    assert (row.n, row.n_a, row.n_b, row.delta, row.phi) == (2, 1, 1, 0.0, 0.0)
    assert clusters.count() == 0
