import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenhand.sources.points import generate_fair_points, parse_points, read_points, write_points


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


BAD = ["1,2,", "x,2,A", "", "1,NaN,A", "1,Infinity,B", "1,2,3,A", "5", "1,,A"]


@pytest.mark.parametrize("bad", BAD)
def test_strict_fails_on_a_bad_line(spark, bad):
    with pytest.raises((PySparkException, ValueError)):
        parse_points(lines(spark, ["3,4,B", bad]), dim=2).collect()


def test_permissive_separates_rejects(spark):
    good, rejects = parse_points(lines(spark, [" 1 ,2,A", *BAD, "3,1e3,B"]), "permissive", dim=2)
    assert sorted((tuple(r.x), r.g) for r in good.collect()) == [((1.0, 2.0), "A"), ((3.0, 1000.0), "B")]
    assert sorted(r.value for r in rejects.collect()) == sorted(BAD)
    assert all(r.reason for r in rejects.collect())


@pytest.mark.parametrize("order", [1, -1])
def test_dimension_does_not_depend_on_the_order_of_lines(spark, order):
    values = ["1,2,3,A", "oops", *["1,2,A"] * 5][::order]
    good, rejects = parse_points(lines(spark, values).coalesce(1), "permissive")
    assert (good.count(), rejects.count()) == (5, 2)


def test_dimension_of_strict_lines_must_agree(spark):
    assert parse_points(lines(spark, ["1,2,A", "3,4,B"])).count() == 2
    with pytest.raises(ValueError, match="set dim"):
        parse_points(lines(spark, ["1,2,A", "1,2,3,A"]))


def test_wide_lines_use_the_same_rules(spark):
    wide = ",".join(str(i) for i in range(100))
    good, rejects = parse_points(lines(spark, [wide + ",A", wide + ",", wide + ",x,A"]), "permissive", dim=100)
    assert [len(r.x) for r in good.collect()] == [100]
    assert rejects.count() == 2


def test_text_round_trip(spark, points, tmp_path):
    rows = [([1.25, -2.5], "A"), ([0.00004, 3], "B"), ([1e6, 7.12345], "A")]
    write_points(points(rows), str(tmp_path / "points"))
    back = read_points(spark, str(tmp_path / "points"), num_partitions=5)
    assert back.rdd.getNumPartitions() == 5
    found = sorted((tuple(r.x), r.g) for r in back.collect())
    assert found == sorted([((1.25, -2.5), "A"), ((0.0, 3.0), "B"), ((1e6, 7.1235), "A")])


@pytest.mark.parametrize("n,k", [(1000, 3), (7, 5), (0, 1), (101, 7)])
def test_generator_sizes(spark, n, k):
    made = generate_fair_points(spark, n, k, seed=3, perc_a=30, distance=12, with_blob=True)
    sizes = {r.blob: r["count"] for r in made.groupBy("blob").count().collect()}
    n_a = n * 30 // 100
    each = (n - n_a) // k
    expected = {0: n_a, **{i: each for i in range(1, k)}, k: n - n_a - each * (k - 1)}
    assert sizes == {blob: size for blob, size in expected.items() if size}


def test_generator_places_blobs_and_repeats_with_the_seed(spark):
    made = generate_fair_points(spark, 20000, 2, seed=5, perc_a=40, distance=20, with_blob=True)
    stats = made.groupBy("blob").agg(F.avg(F.col("x")[0]).alias("m"), F.stddev(F.col("x")[1]).alias("s"))
    for row in stats.collect():
        assert abs(row.m - 20 * row.blob) < 0.5
        assert abs(row.s - (0.5 if row.blob == 0 else 5.0)) < 0.3
    again = generate_fair_points(spark, 20000, 2, seed=5, perc_a=40, distance=20, with_blob=True)
    assert made.exceptAll(again).count() == 0


def test_generator_draws_missing_parameters_in_range(spark):
    for seed in range(5):
        made = generate_fair_points(spark, 1000, 1, seed)
        n_a = made.where("g = 'A'").count()
        assert 100 <= n_a <= 400
    with pytest.raises(ValueError):
        generate_fair_points(spark, 10, 0, 1)
