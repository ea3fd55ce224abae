"""The reproducible k-means start against a plain version, and against the estimator of Spark."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from evenhand.operators.groups import fair_objective, fair_objectives, standard_objective
from evenhand.operators.kmeans import candidates, initial_centers, pick_centers, standard_centers
from evenhand.operators.rounds import lloyd


def blobs(n, k, seed, spread=0.3):
    draw = np.random.default_rng(seed)
    centers = draw.uniform(-50, 50, (k, 2))
    return np.round(centers[draw.integers(0, k, n)] + spread * draw.standard_normal((n, 2)), 3)


def made(points, x):
    return points([(row, "AB"[i % 2]) for i, row in enumerate(x.tolist())])


def matrix(frame):
    return np.array([row.c for row in frame.orderBy("cluster").collect()])


def draw(seed, step, x):
    key = ",".join(map(repr, x))
    return int(hashlib.md5(f"{seed}|{step}|{key}".encode()).hexdigest()[:13], 16) / 2**52


def plain_start(x, k, seed):
    rows = [tuple(row) for row in x.tolist()]
    chosen = [min(rows, key=lambda row: (draw(seed, 0, row), row))]
    cost = lambda row: min(sum((a - b) ** 2 for a, b in zip(row, c)) for c in chosen)
    for step in (1, 2):
        costs = [cost(row) for row in rows]
        total = sum(costs)
        chosen += sorted({row for row, d in zip(rows, costs) if draw(seed, step, row) * total < 2.0 * k * d})
    weights = [0] * len(chosen)
    for row in rows:
        weights[min(range(len(chosen)), key=lambda i: (math.dist(row, chosen[i]) ** 2, i))] += 1
    picked, gaps = [], [1.0] * len(chosen)
    while len(picked) < k:
        times = [
            -math.log(draw(seed, f"pick {len(picked)}", c) + 0.5 / 2**52) / (w * g) if w * g else math.inf
            for c, w, g in zip(chosen, weights, gaps)
        ]
        picked.append(times.index(min(times)))
        new = [sum((a - b) ** 2 for a, b in zip(c, chosen[picked[-1]])) for c in chosen]
        gaps = new if len(picked) == 1 else list(map(min, gaps, new))
    return np.array([chosen[i] for i in picked])


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_start_equals_the_plain_version(points, seed):
    x = blobs(300, 6, seed)
    x[::7] = x[0]
    np.testing.assert_array_equal(matrix(initial_centers(made(points, x), 6, seed)), plain_start(x, 6, seed))


def test_start_does_not_depend_on_partitions_or_order(points):
    x = blobs(400, 5, 3)
    one = matrix(initial_centers(points([(row, "A") for row in x.tolist()], 1), 5, 9))
    many = matrix(initial_centers(points([(row, "A") for row in x[::-1].tolist()], 13), 5, 9))
    np.testing.assert_array_equal(one, many)


def test_candidates_stay_near_their_expected_number(points):
    x = blobs(3000, 8, 4, spread=5.0)
    found, keys = candidates(made(points, x).select("x"), 8, 1)
    assert 8 < len(found) == len(keys) < 3 * 2 * 2 * 8


def test_every_blob_gets_a_centre_about_as_often_as_with_the_estimator(points):
    ours, theirs = [], []
    for seed in range(4):
        frame = made(points, blobs(600, 5, seed))
        features = frame.select(array_to_vector("x").alias("features"))
        model = KMeans(k=5, maxIter=10, seed=seed).fit(features)
        theirs.append(standard_objective(frame, np.array(model.clusterCenters())).head()[0])
        ours.append(standard_objective(frame, standard_centers(frame, 5, 10, seed)).head()[0])
    assert np.median(ours) <= 2 * np.median(theirs) + 0.5


def test_picks_follow_weight_and_distance():
    c = np.array([[0.0], [0.0], [10.0], [1000.0]])
    keys = ["a", "b", "c", "d"]
    for seed in range(20):
        found = pick_centers(c, keys, np.array([1.0, 1.0, 1.0, 1.0]), 4, seed)
        assert len(found) == 3 and sorted(found.ravel().tolist()) == [0.0, 10.0, 1000.0]
        assert pick_centers(c, keys, np.array([0.0, 0.0, 0.0, 1.0]), 4, seed).tolist() == [[1000.0]]


def test_few_or_no_points(points, spark):
    same = points([([1.0, 2.0], "A")] * 5)
    assert matrix(initial_centers(same, 3, 1)).tolist() == [[1.0, 2.0]]
    nothing = spark.createDataFrame([], "x array<double>, g string")
    assert initial_centers(nothing, 3).count() == 0
    assert standard_centers(nothing, 3, 2).count() == 0
    with pytest.raises(ValueError):
        initial_centers(same, 0)


def test_rounds_end_when_nothing_moves(points, monkeypatch):
    frame = made(points, blobs(200, 3, 5))
    start = matrix(initial_centers(frame, 3, 0))
    settled = matrix(lloyd(frame, start, 50))
    calls = []
    import evenhand.operators.rounds as rounds

    original = rounds.cluster_moments
    monkeypatch.setattr(rounds, "cluster_moments", lambda *a, **k: (calls.append(1), original(*a, **k))[1])
    np.testing.assert_allclose(matrix(lloyd(frame, settled, 50, tolerance=1e-9)), settled)
    assert len(calls) == 1


def test_objectives_of_several_sets_in_one_scan(points):
    frame = made(points, blobs(100, 3, 6))
    wide = [[float(i), 0.0] for i in range(80)]
    sets = [[[0.0, 0.0]], wide, [], [[5.0, 5.0], [-5.0, 1.0]]]
    found = fair_objectives(frame, sets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1
    for row, centers in zip(found.orderBy("set").collect(), sets):
        assert tuple(row)[1:] == pytest.approx(tuple(fair_objective(frame, centers).head()))
