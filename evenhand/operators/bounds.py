"""Rounds that skip distances: bounds of every point are kept from one round to the next.

Worth it for many centres of high dimension, where the distances cost more than the
bounds: these are 20 bytes for each point, written and read once a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import kernels
from evenhand.operators.moments import PARTIAL, merged_moments, with_sides
from evenhand.storage import new_path

# Rows of one stored block of points.
BLOCK_ROWS = 4096
BLOCK_SCHEMA = "block bigint, d int, x binary, side binary, exact binary"
ROUND_SCHEMA = f"block bigint, bounds binary, distances bigint, {PARTIAL}"


def _blocks(batches, ids_per_partition: int):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() * ids_per_partition
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            lengths = part.column("x").value_lengths().to_pylist()
            d = lengths[0] or 0
            x = kernels.coordinates(part.column("x"), d)
            sides = [part.column(name).to_numpy(zero_copy_only=False).astype(np.int8) for name in ("side", "exact")]
            values = [[block], [d], [x.tobytes()], *([side.tobytes()] for side in sides)]
            kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            names = ["block", "d", "x", "side", "exact"]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, values, kinds)), names)
            block += 1


def _packed(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> bytes:
    return cluster.astype("<i4").tobytes() + upper.astype("<f8").tobytes() + lower.astype("<f8").tobytes()


def _unpacked(bounds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(bounds) // 20
    cluster = np.frombuffer(bounds, "<i4", n)
    return cluster, np.frombuffer(bounds, "<f8", n, 4 * n).copy(), np.frombuffer(bounds, "<f8", n, 12 * n).copy()


def _round(batches, shift: kernels.CenterShift):
    """Bounds of every block under the new centres, and the moments of the partition."""
    c, sums = shift.new, kernels.MomentSums()
    empty = [pa.array([None], kind) for kind in _PARTIAL_KINDS]
    for batch in batches:
        for row in batch.to_pylist():
            if row["d"] != c.shape[1]:
                raise ValueError(f"every point must have {c.shape[1]} coordinates, none of them null")
            x = np.frombuffer(row["x"]).reshape(-1, row["d"])
            side, exact = (np.frombuffer(row[name], np.int8).astype(np.int32) for name in ("side", "exact"))
            if row["bounds"] is None:
                cluster, upper, lower = kernels.two_nearest(x, c)
                upper *= 1 + kernels.BOUND_SLACK
                lower *= 1 - kernels.BOUND_SLACK
                count = len(x) * len(c)
            else:
                cluster, upper, lower, count = shift.advance(x, *_unpacked(row["bounds"]))
            sums.add(x, cluster, side, exact)
            bounds = pa.array([_packed(cluster, upper, lower)], pa.binary())
            values = [pa.array([row["block"]], pa.int64()), bounds, pa.array([count], pa.int64()), *empty]
            yield pa.RecordBatch.from_arrays(values, names=_NAMES)
    found = sums.arrays()
    missing = [pa.nulls(len(found[0]), kind) for kind in (pa.int64(), pa.binary(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*missing, *found], names=_NAMES)


_NAMES = ["block", "bounds", "distances", *kernels.MomentSums.COLUMNS]
_PARTIAL_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64())


class BoundedRounds:
    """Moments of the points ``(x[, g])`` round after round, for centres that move little by little.

    Points are stored once in blocks, partitioned by block. A round joins each block with its bounds, which it
    replaces: a point whose bounds rule out all other centres keeps its cluster without any distance, so results equal
    those of :func:`cluster_moments`, ties included. Bounds are written to the shared folder, so a lost
    executor costs a task of the current round. ``distances`` lists the distances that each round took.
    """

    def __init__(self, points: DataFrame, grouped: bool = True) -> None:
        self.spark = points.sparkSession
        path = new_path(self.spark, "points")
        prepared = with_sides(points, grouped)
        prepared.mapInArrow(lambda batches: _blocks(batches, 1 << 32), BLOCK_SCHEMA).write.parquet(path)
        stored = self.spark.read.schema(BLOCK_SCHEMA).parquet(path)
        # The same partitioning every round: only bounds move, never points.
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = stored.repartition(self.partitions, "block").persist()
        self.centers: np.ndarray | None = None
        self.bounds: DataFrame | None = None
        self.distances: list[int] = []

    def moments(self, c: np.ndarray) -> DataFrame:
        """``(cluster, side, n, n_exact, mean, spread)`` of the points nearest to each centre."""
        c = np.asarray(c, np.float64)
        if self.bounds is None or self.centers.shape != c.shape:
            joined = self.blocks.withColumn("bounds", F.lit(None).cast("binary"))
            before = c
        else:
            bounds = self.bounds.repartition(self.partitions, "block").hint("shuffle_hash")
            joined, before = self.blocks.join(bounds, "block"), self.centers
        shift = self.spark.sparkContext.broadcast(kernels.CenterShift(before, c))
        path = new_path(self.spark, "bounds")
        joined.mapInArrow(lambda batches: _round(batches, shift.value), ROUND_SCHEMA).write.parquet(path)
        shift.unpersist()
        done = self.spark.read.schema(ROUND_SCHEMA).parquet(path)
        self.distances.append(done.agg(F.coalesce(F.sum("distances"), F.lit(0))).head()[0])
        self.bounds, self.centers = done.where(F.col("block").isNotNull()).select("block", "bounds"), c
        return merged_moments(done.where(F.col("cluster").isNotNull()))

    def close(self) -> None:
        self.blocks.unpersist()
