"""Centre sets: a small ordered table at the API, a K x d matrix inside the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A centre set is held by the driver and sent to every executor, so its size is checked.
MAX_CENTERS = 1_000_000
MAX_CENTER_BYTES = 1 << 30


def center_matrix(centers: DataFrame | np.ndarray | list) -> np.ndarray:
    """K x d matrix of a centre set given as a table ``(cluster, c)``, a matrix or nested lists."""
    if isinstance(centers, DataFrame):
        size = centers.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("c")), F.lit(0)).alias("cells")).head()
        if size["n"] > MAX_CENTERS:
            raise ValueError(f"more than {MAX_CENTERS} centres")
        if 8 * size["cells"] > MAX_CENTER_BYTES:
            raise ValueError(f"centre set of {8 * size['cells']} bytes is above {MAX_CENTER_BYTES}")
        rows = centers.select("cluster", "c").toArrow().sort_by("cluster")
        ids = rows.column("cluster").to_pylist()
        if ids != list(range(len(ids))):
            raise ValueError("cluster ids must be 0..K-1 without gaps")
        centers = rows.column("c").to_pylist()
    matrix = np.asarray(centers, dtype=np.float64)
    if matrix.size == 0:
        return np.empty((0, 0))
    if matrix.ndim != 2:
        raise ValueError("all centres must have the same dimension")
    if not np.isfinite(matrix).all():
        raise ValueError("centres must be finite")
    if matrix.nbytes > MAX_CENTER_BYTES:
        raise ValueError(f"centre set of {matrix.nbytes} bytes is above {MAX_CENTER_BYTES}")
    return matrix


def center_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """Centre set as a table ``(cluster int, c array<double>)``."""
    schema = pa.schema([("cluster", pa.int32()), ("c", pa.list_(pa.float64()))])
    table = pa.table({"cluster": range(len(matrix)), "c": np.asarray(matrix).tolist()}, schema=schema)
    return spark.createDataFrame(table)
