"""Labelled points: text source and sink, and a distributed generator.

Text form: one point per line, ``x1,...,xd,label``, no header. Typed form:
``(x array<double>, g string)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Up to this dimension the coordinates are cast one by one inside generated code.
UNROLLED_DIMENSION = 64

# Fixed values of the generated data set: shares in percent, distances and spreads.
PERC_A_RANGE = (10, 40)
DISTANCE_RANGE = (10, 30)
SIGMA_A = 0.5
SIGMA_B = 5.0
LINE_FORMAT = "%.4f"


def parse_points(lines: DataFrame, mode: str = "strict", dim: int | None = None):
    """Parse a column ``value`` of text lines into points ``(x, g)``.

    Without ``dim`` all well-formed lines set the dimension, which takes a pass over them: in
    ``strict`` mode they must agree, in ``permissive`` mode the most frequent dimension counts.
    ``strict`` fails on any bad line. ``permissive`` returns ``(points, rejects)``
    with rejects as ``(value, reason)``.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError("mode must be 'strict' or 'permissive'")
    if dim is None:
        dim = _common_dimension(lines, mode)
    parsed = _parsed(lines, dim)
    if mode == "strict":
        message = F.concat(F.lit("bad point line ("), F.col("reason"), F.lit("): "), F.col("value"))
        valid = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
        return parsed.where(valid).select("x", "g")
    points = parsed.where(F.col("reason").isNull()).select("x", "g")
    rejects = parsed.where(F.col("reason").isNotNull()).select("value", "reason")
    return points, rejects


def _common_dimension(lines: DataFrame, mode: str) -> int:
    """The dimension of the well-formed lines, from one aggregate over all of them.

    ``strict`` refuses lines of several dimensions. ``permissive`` takes the most frequent one, and the
    smallest of equally frequent ones, whatever the order of lines and files.
    """
    sizes = (
        _parsed(lines, None)
        .where(F.col("reason").isNull())
        .groupBy(F.size("x").alias("d"))
        .agg(F.count("*").alias("n"))
    )
    if mode == "permissive":
        most = sizes.agg(F.max(F.struct("n", -F.col("d"))).alias("m")).head()["m"]
        return 1 if most is None else -most[1]
    found = sizes.agg(F.min("d").alias("low"), F.max("d").alias("high")).head()
    if found["low"] != found["high"]:
        raise ValueError(f"lines have from {found['low']} to {found['high']} coordinates; set dim to reject the others")
    return 1 if found["low"] is None else found["low"]


def _parsed(lines: DataFrame, dim: int | None) -> DataFrame:
    """``(value, x, g, reason)``; ``reason`` is null for a well-formed line."""
    fields = lines.select("value", F.split("value", ",").alias("f"))
    if dim is not None and dim <= UNROLLED_DIMENSION:
        x = F.expr("array(" + ", ".join(f"try_cast(get(f, {j}) as double)" for j in range(dim)) + ")")
    else:
        x = F.expr("transform(slice(f, 1, size(f) - 1), v -> try_cast(v as double))")
    # Coordinates minus themselves are 0 unless one is null, NaN or infinite.
    if dim is not None and dim <= UNROLLED_DIMENSION:
        finite = F.expr(" + ".join(f"(x[{j}] - x[{j}])" for j in range(dim)) + " = 0")
    else:
        finite = F.expr("aggregate(x, 0.0D, (s, v) -> s + (v - v)) = 0")
    wrong_dimension = F.lit(False) if dim is None else F.col("n_fields") != dim + 1
    reason = (
        F.when(F.col("n_fields") < 2, "no coordinate")
        .when(F.col("g") == "", "empty label")
        .when(wrong_dimension, "wrong dimension")
        .when(~F.coalesce(finite, F.lit(False)), "coordinate is not a finite number")
    )
    typed = fields.select("value", x.alias("x"), F.element_at("f", -1).alias("g"), F.size("f").alias("n_fields"))
    # The generator is a fence: a filter on its output is not pushed into the parsing,
    # where each mention of a column would split and cast the line again.
    return typed.select(F.inline(F.array(F.struct("value", "x", "g", reason.alias("reason")))))


def read_points(
    spark: SparkSession,
    path: str,
    mode: str = "strict",
    num_partitions: int | None = None,
    dim: int | None = None,
):
    """Read labelled points from text files; see :func:`parse_points` for ``mode`` and ``dim``."""
    parsed = parse_points(spark.read.text(path), mode, dim)
    if num_partitions is None:
        return parsed
    if mode == "strict":
        return parsed.repartition(num_partitions)
    points, rejects = parsed
    return points.repartition(num_partitions), rejects


def format_points(points: DataFrame) -> DataFrame:
    """Text lines of points, four decimals per coordinate."""
    numbers = F.transform("x", lambda v: F.format_string(LINE_FORMAT, v))
    return points.select(F.concat_ws(",", numbers, F.col("g")).alias("value"))


def write_points(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write points as text files that :func:`read_points` reads back."""
    format_points(points).write.mode(mode).text(path)


def generate_fair_points(
    spark: SparkSession,
    n: int,
    k: int,
    seed: int,
    perc_a: int | None = None,
    distance: int | None = None,
    with_blob: bool = False,
) -> DataFrame:
    """Points in the plane on which standard and fair centres differ clearly.

    Group A is one tight blob at the origin with ``perc_a`` percent of the
    points. Group B is ``k`` wide blobs along the diagonal, ``distance`` apart,
    of equal size with the remainder in the last. Omitted parameters are drawn
    from ``seed``. ``with_blob`` adds the blob number (0 for A, 1..k for B).
    """
    if n < 0 or k < 1:
        raise ValueError("n must not be negative and k must be at least 1")
    draw = np.random.default_rng(seed)
    drawn_perc = int(draw.integers(PERC_A_RANGE[0], PERC_A_RANGE[1] + 1))
    drawn_distance = int(draw.integers(DISTANCE_RANGE[0], DISTANCE_RANGE[1] + 1))
    perc_a = drawn_perc if perc_a is None else perc_a
    distance = drawn_distance if distance is None else distance
    n_a = n * perc_a // 100
    blob_size = (n - n_a) // k
    number = F.lit(k)
    if blob_size:
        number = F.least(F.expr(f"(id - {n_a}L) div {blob_size}L") + 1, F.lit(k).cast("bigint"))
    blob = F.when(F.col("id") < n_a, 0).otherwise(number).cast("int")
    placed = spark.range(n).select(blob.alias("blob"), F.randn(seed).alias("u"), F.randn(seed + 1).alias("v"))
    sigma = F.when(F.col("blob") == 0, SIGMA_A).otherwise(SIGMA_B)
    at = (F.col("blob") * distance).cast("double")
    points = placed.select(
        F.array(at + sigma * F.col("u"), at + sigma * F.col("v")).alias("x"),
        F.when(F.col("blob") == 0, "A").otherwise("B").alias("g"),
        "blob",
    )
    return points if with_blob else points.drop("blob")
