"""Nearest-centre assignment: narrow in every form, no join and no shuffle.

Few centres of low dimension are unrolled into one expression that stays inside
whole-stage code generation. Larger centre sets go through Arrow batches with
the centres in broadcast blocks of bounded size; each block refines the result
of the ones before it, so the number of centres is not limited by one block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evenhand.functions import kernels
from evenhand.functions.centers import center_matrix
from evenhand.functions.distance import sq_distance_sql

# Largest K * d and d that are unrolled; beyond them the generated method is too long for the JIT compiler.
UNROLLED_CELLS = 64
UNROLLED_DIMENSION = 16
# Largest centre block that is broadcast to one Arrow pass.
BLOCK_BYTES = 64 << 20


def is_unrolled(c: np.ndarray) -> bool:
    return c.size <= UNROLLED_CELLS and c.shape[1] <= UNROLLED_DIMENSION


def assign(points: DataFrame, centers, keep: Sequence[str] | None = None) -> DataFrame:
    """Add the nearest centre (``cluster``) and the squared distance to it (``dist2``).

    ``points`` has a column ``x array<double>``; ties go to the smallest cluster.
    ``keep`` names the input columns to return (default: all of them).
    """
    c = center_matrix(centers)
    if not len(c):
        raise ValueError("at least one centre is needed")
    kept = list(points.columns if keep is None else keep)
    if is_unrolled(c):
        return _assign_unrolled(points, c, kept)
    return _assign_arrow(points, c, kept)


def with_coordinates(points: DataFrame, d: int, keep: Sequence[str]) -> DataFrame:
    """Spread ``x`` into scalar columns ``_x0, _x1, ...``.

    A point of another dimension, or with a null coordinate, is an error, as it is in the Arrow form.
    """
    # Comparing each coordinate is part of the generated code; a higher-order function is not.
    known = " and ".join(f"x[{j}] is not null" for j in range(d))
    first = (
        f"case when size(x) = {d} and {known} then x[0] "
        f"else raise_error('every point must have {d} coordinates, none of them null') end as _x0"
    )
    others = [f"x[{j}] as _x{j}" for j in range(1, d)]
    return points.selectExpr(*_quoted(keep), first, *others)


def with_nearest(spread: DataFrame, c: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """Add ``cluster`` and ``dist2`` to points whose coordinates are scalar columns."""
    k, d = c.shape
    coords = [f"_x{j}" for j in range(d)]
    distances = [f"{sq_distance_sql(coords, row)} as _d{i}" for i, row in enumerate(c.tolist())]
    names = [f"_d{i}" for i in range(k)]
    smallest = f"least({', '.join(names)})" if k > 1 else names[0]
    with_distances = spread.selectExpr(*_quoted(keep), *distances)
    with_smallest = with_distances.selectExpr(*_quoted(keep), *names, f"{smallest} as dist2")
    cases = " ".join(f"when {name} = dist2 then {i}" for i, name in enumerate(names[:-1]))
    cluster = f"case {cases} else {k - 1} end" if k > 1 else "0"
    # The generator is a fence: a filter or join on the cluster is not pushed below it,
    # where it would repeat every distance and outgrow the code generator.
    return with_smallest.selectExpr(*_quoted(keep), f"inline(array(struct({cluster} as cluster, dist2)))")


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def _assign_unrolled(points: DataFrame, c: np.ndarray, keep: list[str]) -> DataFrame:
    return with_nearest(with_coordinates(points, c.shape[1], keep), c, keep)


def _assign_arrow(points: DataFrame, c: np.ndarray, keep: list[str]) -> DataFrame:
    extra = [] if "x" in keep else ["x"]
    current = points.select(*keep, *extra)
    added = [T.StructField("cluster", T.IntegerType(), False), T.StructField("dist2", T.DoubleType(), False)]
    rows = max(1, BLOCK_BYTES // (8 * c.shape[1]))
    for first in range(0, len(c), rows):
        last_block = first + rows >= len(c)
        carried = keep if last_block else keep + extra
        block = points.sparkSession.sparkContext.broadcast(c[first : first + rows])
        refine = first > 0

        def run(batches, block=block, first=first, carried=carried, refine=refine):
            return kernels.append_nearest(batches, block.value, first, carried, refine)

        schema = T.StructType([current.schema[name] for name in carried] + added)
        current = current.mapInArrow(run, schema)
    return current
