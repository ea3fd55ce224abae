"""Rounds with bounds give the rounds without, and take fewer distances."""

import numpy as np
import pytest

from evenhand.functions.kernels import CenterShift, nearest, two_nearest
from evenhand.operators.bounds import BoundedRounds
from evenhand.operators.fair import fair_lloyd
from evenhand.operators.rounds import lloyd


def matrix(frame):
    return np.array([row.c for row in frame.orderBy("cluster").collect()])


def test_bounds_hold_over_many_rounds():
    draw = np.random.default_rng(1)
    x = np.vstack([draw.integers(0, 9, (300, 2)), draw.standard_normal((300, 2)) * 4]).astype(float)
    for k in (1, 2, 3, 17):
        c = draw.integers(0, 9, (k, 2)).astype(float)
        cluster, upper, lower = two_nearest(x, c)
        counts = []
        for step in range(12):
            before, c = c, c + draw.standard_normal((k, 2)) * 0.7**step
            if step == 5:
                c = np.round(c)  # ties between centres
            cluster, upper, lower, count = CenterShift(before, c).advance(x, cluster, upper, lower)
            counts.append(count)
            index, _ = nearest(x, c)
            distances = np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))
            assert cluster.tolist() == index.tolist()
            assert (distances[np.arange(len(x)), cluster] <= upper).all()
            distances[np.arange(len(x)), cluster] = np.inf
            assert (distances.min(axis=1) >= lower).all()
        assert counts[-1] < len(x) * k or k == 1


@pytest.mark.parametrize("k,d", [(40, 8), (3, 2)])
def test_same_centres_and_fewer_distances(points, monkeypatch, k, d):
    draw = np.random.default_rng(k)
    blobs = draw.uniform(-20, 20, (k, d))
    x = blobs[draw.integers(0, k, 900)] + draw.standard_normal((900, d))
    x[::9] = x[0]
    frame = points([(row, "AB"[i % 2]) for i, row in enumerate(x.tolist())])
    start = x[1 : k + 1]
    seen = []
    monkeypatch.setattr(BoundedRounds, "close", lambda self: (seen.append(self.distances), self.blocks.unpersist()))
    for run in (
        lambda bounded: lloyd(frame, start, 6, bounded=bounded),
        lambda bounded: fair_lloyd(frame, m=4, init_centers=start, bounded=bounded),
    ):
        np.testing.assert_allclose(matrix(run(True)), matrix(run(False)), rtol=1e-9)
    for distances in seen:
        assert distances[0] == 900 * k
        assert all(count < 900 * k for count in distances[2:])
        assert distances[-1] < 0.5 * distances[0] or k == 3


def test_ties_and_third_labels(points):
    rows = [([float(i % 5), 0.0], "ABC"[i % 3]) for i in range(60)]
    start = [[0.0, 0.0], [0.0, 0.0], [2.0, 0.0], [4.0, 0.0]]
    for m in (1, 4):
        one, two = (fair_lloyd(points(rows), m=m, init_centers=start, other="as_b", bounded=b) for b in (True, False))
        np.testing.assert_allclose(matrix(one), matrix(two), rtol=1e-12)


def test_points_do_not_move_after_the_first_shuffle(points):
    rounds = BoundedRounds(points([([float(i), 0.0], "A") for i in range(50)]))
    rounds.moments(np.array([[0.0, 0.0], [9.0, 0.0]])).collect()
    bounds = rounds.bounds.repartition(rounds.partitions, "block").hint("shuffle_hash")
    plan = rounds.blocks.join(bounds, "block")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1
    top = plan[: plan.index("InMemoryRelation")]
    assert top.count("Exchange") <= 1
    rounds.close()


def test_null_coordinates_and_no_points(spark):
    bad = spark.createDataFrame([([0.0, None], "A"), ([1.0, 1.0], "B")], "x array<double>, g string")
    with pytest.raises(Exception, match="none of them null"):
        lloyd(bad, [[0.0, 0.0]], 1, bounded=True)
    assert matrix(lloyd(bad.limit(0), [[3.0, 1.0]], 2, bounded=True)).tolist() == [[3.0, 1.0]]


def test_moments_of_centre_blocks(points, monkeypatch):
    from evenhand.operators import assignment, moments

    draw = np.random.default_rng(6)
    frame = points([(row, "AB"[i % 2]) for i, row in enumerate(draw.standard_normal((200, 20)).tolist())])
    centers = draw.standard_normal((30, 20))
    expected = moments.cluster_moments(frame, centers).orderBy("cluster", "side").collect()
    for module in (assignment, moments):
        monkeypatch.setattr(module, "BLOCK_BYTES", 8 * 20 * 7)
    found = moments.cluster_moments(frame, centers).orderBy("cluster", "side").collect()
    for a, b in zip(found, expected, strict=True):
        assert tuple(a)[:4] == tuple(b)[:4]
        np.testing.assert_allclose(a["mean"], b["mean"], rtol=1e-9)
        assert a["spread"] == pytest.approx(b["spread"])
