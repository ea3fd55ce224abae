import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def points(spark):
    """Build points ``(x, g)`` from ``(coordinates, label)`` pairs."""

    def build(rows, partitions=3):
        data = [([float(v) for v in x], g) for x, g in rows]
        return spark.createDataFrame(data, "x array<double>, g string").repartition(partitions)

    return build


@pytest.fixture
def hist(spark):
    """Build a histogram from a dict."""

    def build(counts):
        return spark.createDataFrame(list(counts.items()), "item bigint, freq bigint")

    return build
