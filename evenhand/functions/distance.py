"""Distances between a point column and centres, as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_literal(value: float) -> str:
    """SQL text of a double that parses back to exactly the same bits."""
    return f"({float(value)!r}D)"


def sq_distance_sql(coords: Sequence[str], center: Sequence[float]) -> str:
    """SQL text of the squared distance between scalar columns and a fixed centre.

    The terms are added from the first coordinate to the last, so the result
    does not depend on how many coordinates or centres there are.
    """
    if len(coords) != len(center):
        raise ValueError(f"{len(coords)} coordinates but a centre of dimension {len(center)}")
    terms = [f"({x} - {double_literal(c)}) * ({x} - {double_literal(c)})" for x, c in zip(coords, center)]
    return " + ".join(terms)


def sq_distance(x: Column | str, c: Column | str) -> Column:
    """Squared Euclidean distance of two ``array<double>`` columns.

    Arrays of different length give null, because the missing terms are null.
    """
    x = F.col(x) if isinstance(x, str) else x
    c = F.col(c) if isinstance(c, str) else c
    squares = F.zip_with(x, c, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda total, term: total + term)


def distance(x: Column | str, c: Column | str) -> Column:
    """Euclidean distance of two ``array<double>`` columns."""
    return F.sqrt(sq_distance(x, c))
