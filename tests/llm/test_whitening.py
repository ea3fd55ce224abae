"""Whitening against numpy's eigenvectors, and the bidiagonalisation on hard matrices."""

import numpy as np
import pytest

from evenhand.llm.queries import QUERIES
from evenhand.llm.whitening import OFFSET, SCALE, bidiagonal, differences, exact_deviation, whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def expected(vectors, components=32):
    """By numpy: kept rows, deviations, components, eigenvalues."""
    kept = [(k, v) for k, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(SCALE * np.float64(np.float32(c)))) + OFFSET for c in v] for _, v in kept], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return [k for k, _ in kept], deviation, centred, found[:, order], values[order], values.sum()


def compare(frame, vectors, components=32, least=1e-20):
    ids, deviation, centred, found, values, trace = expected(vectors, components)
    wanted = int((values > least * values[0]).sum())
    keys = [-1 if k is None else k for k in ids]
    frame["vec_id"] = frame["vec_id"].fillna(-1)
    assert sorted(frame["vec_id"]) == sorted(keys * wanted)
    # Rows with the same id hold the same vector here.
    frame = frame.sort_values(["vec_id", "component"]).drop_duplicates(["vec_id", "component"])
    order = [keys.index(k) for k in sorted(set(keys))]
    white = frame["whitened"].to_numpy().reshape(len(order), wanted)
    assert frame["n"].eq(len(ids)).all() and frame["identity_error"].nunique() == 1
    assert frame["identity_error"].iloc[0] < 1e-8
    assert frame["deviation"].to_numpy().reshape(len(order), wanted)[:, 0].tolist() == deviation[order].tolist()
    np.testing.assert_allclose(frame["explained"].to_numpy()[:wanted], (values / trace)[:wanted], rtol=1e-9)
    plain = (centred @ found[:, :wanted] / np.sqrt(values[:wanted]))[order]
    signs = np.sign((plain * white).sum(axis=0))
    np.testing.assert_allclose(white * signs, plain, atol=1e-6)


def test_embeddings_table(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op11_whitening"](spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(found, [tuple(row) for row in rows])


def test_edges(spark):
    draw = np.random.default_rng(1)
    rows = [(k, (draw.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]).tolist()) for k in range(90)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]
    bad = [(91, None), (92, []), (93, [1.0, None] + [1.0] * 4), (94, [float("nan")] * 6), (95, [float("inf")] + [1.0] * 5)]
    table = spark.createDataFrame([(*row, "x", 1) for row in rows + bad], SCHEMA + ", body string, component int")
    compare(whiten(table.repartition(5), "vec_id", "embedding").toPandas(), rows + bad)
    compare(whiten(table, "vec_id", "embedding", 2).toPandas(), rows + bad, 2)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)]):
        assert whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").count() == 0
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), "vec_id", "embedding").count()


def test_directions_without_variance_are_left_out(spark):
    draw = np.random.default_rng(2)
    rows = [(k, [a, b, a, 3.0]) for k, (a, b) in enumerate(draw.standard_normal((50, 2)).tolist())]
    found = whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").toPandas()
    assert sorted(found["component"].unique()) == [1, 2]
    compare(found, rows, least=1e-12)


@pytest.mark.parametrize(
    "deviations",
    [
        np.ones(12),
        np.r_[np.full(5, 3.0), np.full(5, 1.0), 0, 0],
        10.0 ** -np.arange(9.0),
        np.linspace(1, 2, 40),
        np.r_[1.0, np.zeros(9)],
    ],
)
def test_bidiagonal(deviations):
    d = len(deviations)
    draw = np.random.default_rng(d)
    left = np.linalg.qr(draw.standard_normal((3 * d, d)))[0]
    right = np.linalg.qr(draw.standard_normal((d, d)))[0]
    x = left * deviations @ right.T
    calls = []

    def product(p):
        calls.append(1)
        w = x @ p
        return w @ w, x.T @ w

    wanted = min(8, d)
    vectors, sigma = bidiagonal(product, d, float((x * x).sum()), wanted)
    known = np.sort(deviations)[::-1][:wanted]
    found = np.r_[sigma, np.zeros(d)][:wanted]
    np.testing.assert_allclose(found, known, atol=1e-13 * max(known))
    positive = int((known > 1e-10).sum())
    chosen = vectors[:, :positive]
    np.testing.assert_allclose(chosen.T @ chosen, np.eye(positive), atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(x @ chosen, axis=0), known[:positive], atol=1e-12 * max(known))
    assert len(calls) <= d


def test_steep_variance_takes_few_steps():
    x = np.random.default_rng(3).standard_normal((400, 100)) * 0.5 ** np.arange(100)
    calls = []

    def product(p):
        calls.append(1)
        return float((x @ p) @ (x @ p)), x.T @ (x @ p)

    _, sigma = bidiagonal(product, 100, float((x * x).sum()), 5)
    np.testing.assert_allclose(sigma[:5], np.linalg.svd(x)[1][:5], rtol=1e-12)
    assert len(calls) < 40


def test_exact_beyond_64_bit_products():
    values = np.array([[1 << 40, -5], [-(1 << 40), 7], [3, 9]], np.int64)
    sums = [int(s) for s in values.sum(axis=0)]
    for n in (3, 1 << 30):
        exact = [[n * int(v) - s for v, s in zip(row, sums)] for row in values]
        assert differences(values, n, sums).tolist() == exact
    with pytest.raises(OverflowError):
        exact_deviation(values, 1 << 30, sums)
    small = values // (1 << 30)
    sums = [int(s) for s in small.sum(axis=0)]
    assert exact_deviation(small, 3, sums).tolist() == [sum((3 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in small]
