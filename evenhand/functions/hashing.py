"""Pairwise-independent hash families ``((a*x + b) mod P) mod C`` as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest modulus whose products of two residues fit in 64 bits.
DEFAULT_PRIME = 2147483647
# For items of 64 bits: only items that are equal modulo 2^61 - 1 collide in every row.
WIDE_PRIME = (1 << 61) - 1
# Hash rows are unrolled into expressions, so their number is checked.
MAX_ROWS = 256

COEFFICIENTS = ("cm_a", "cm_b", "cs_a", "cs_b", "sg_a", "sg_b")


class HashRow(NamedTuple):
    """Coefficients of one sketch row: Count-Min bucket, Count-sketch bucket, sign."""

    cm_a: int
    cm_b: int
    cs_a: int
    cs_b: int
    sg_a: int
    sg_b: int


def check_prime(prime: int) -> int:
    if not 2 <= prime <= DEFAULT_PRIME and prime != WIDE_PRIME:
        raise ValueError(f"prime must be between 2 and {DEFAULT_PRIME}, or {WIDE_PRIME}")
    return prime


def _wide_residue_sql(a: int, b: int, x: str) -> str:
    """SQL text of ``(a*x + b) mod (2^61 - 1)`` from products of at most 62 bits.

    Both factors are cut into a high part and 31 low bits. Modulo 2^61 - 1, a factor 2^62 is 2, and ``m * 2^31``
    is the upper 31 bits of ``m`` plus its 30 lower bits moved up.
    """
    p, low = WIDE_PRIME, (1 << 31) - 1
    high_a, low_a = a >> 31, a & low
    item = f"pmod({x}, {p}L)"
    high_x, low_x = f"shiftright({item}, 31)", f"({item} & {low}L)"
    cross = f"(({high_a}L * {low_x} + {low_a}L * {high_x}) % {p}L)"
    moved = f"(shiftright({cross}, 30) + shiftleft({cross} & {(1 << 30) - 1}L, 31))"
    upper = f"(({2 * high_a}L * {high_x} + {moved} % {p}L) % {p}L)"
    return f"(({upper} + ({low_a}L * {low_x}) % {p}L + {b}L) % {p}L)"


def residue_sql(a, b, x: str, prime: int) -> str:
    """SQL text of ``(a*x + b) mod prime``. The item is reduced first, so no item overflows or gives a negative value."""
    if check_prime(prime) == WIDE_PRIME:
        return _wide_residue_sql(a, b, x)
    return f"pmod({a}L * pmod({x}, {prime}L) + {b}L, {prime}L)"


def bucket_sql(a, b, c: int, x: str, prime: int) -> str:
    """SQL text of the bucket 0..c-1 of ``x`` as a bigint."""
    if c < 1:
        raise ValueError("there must be at least one bucket")
    return f"({residue_sql(a, b, x, prime)} % {c}L)"


def sign_sql(a, b, x: str, prime: int) -> str:
    """SQL text of +1 for an even residue, -1 for an odd one."""
    return f"if({residue_sql(a, b, x, prime)} % 2 = 0, 1, -1)"


def hash_bucket(a: int, b: int, c: int, x: str, prime: int = DEFAULT_PRIME) -> Column:
    """Bucket 0..c-1 of the bigint column named ``x``."""
    return F.expr(f"cast({bucket_sql(a, b, c, x, prime)} as int)")


def hash_sign(a: int, b: int, x: str, prime: int = DEFAULT_PRIME) -> Column:
    """+1 or -1 for the bigint column named ``x``."""
    return F.expr(sign_sql(a, b, x, prime))


def draw_rows(d: int, prime: int, seed: int) -> list[HashRow]:
    """``d`` seeded coefficient rows, multipliers in 1..prime-1 and offsets in 0..prime-1."""
    if not 1 <= d <= MAX_ROWS:
        raise ValueError(f"the number of rows must be between 1 and {MAX_ROWS}")
    check_prime(prime)
    draw = np.random.default_rng(seed)
    low = [1, 0, 1, 0, 1, 0]
    return [HashRow(*row) for row in draw.integers(low, prime, size=(d, 6)).tolist()]


def make_hashes(spark: SparkSession, d: int, prime: int = DEFAULT_PRIME, seed: int = 0) -> DataFrame:
    """Hash family as a table ``(d, cm_a, cm_b, cs_a, cs_b, sg_a, sg_b)``."""
    return hash_table(spark, draw_rows(d, prime, seed))


def hash_table(spark: SparkSession, rows: Sequence[HashRow]) -> DataFrame:
    """Table form of explicitly given coefficient rows."""
    columns = {"d": pa.array(range(len(rows)), pa.int32())}
    for i, name in enumerate(COEFFICIENTS):
        columns[name] = pa.array([row[i] for row in rows], pa.int64())
    return spark.createDataFrame(pa.table(columns))


def hash_rows(hashes: DataFrame | Sequence[HashRow]) -> list[HashRow]:
    """Coefficient rows in row order. A table of more than ``MAX_ROWS`` rows is refused."""
    if isinstance(hashes, DataFrame):
        found = hashes.select("d", *COEFFICIENTS).limit(MAX_ROWS + 1).collect()
        found.sort(key=lambda row: row["d"])
        if [row["d"] for row in found] != list(range(len(found))):
            raise ValueError("hash rows must be numbered 0..D-1 without gaps")
        rows = [HashRow(*row[1:]) for row in found]
    else:
        rows = [HashRow(*row) for row in hashes]
    if not 1 <= len(rows) <= MAX_ROWS:
        raise ValueError(f"the number of rows must be between 1 and {MAX_ROWS}")
    return rows
