"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation with distributed products."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evenhand.llm.common import Batches, written

#: An entry c becomes the integer floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Largest floor(SCALE * c) that is taken, so that integers stay exact in double precision.
LARGEST = 1 << 52
#: Entries of one stored block.
BLOCK_ENTRIES = 1 << 19
#: A deviation below this share of the largest counts as none.
LEAST_DEVIATION = 1e-10
#: A triplet counts as found when its residual falls below this share of the largest deviation.
RESIDUAL = 1e-14


class Rows(NamedTuple):
    """The finite vectors as integers: their stored blocks, number, sums and exact total of squared deviations."""

    blocks: DataFrame
    n: int
    sums: list[int]


class Whitening(NamedTuple):
    """Unit components as columns, standard deviation of each, share of the variance, and the largest error of whitening."""

    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def finite_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of vectors without null or non-finite entries, and their entries as doubles, one row each."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    entries = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(owner[~np.isfinite(entries)], minlength=len(lengths)) > 0
    kept = np.flatnonzero((lengths > 0) & ~bad)
    sizes = set(lengths[kept].tolist())
    if len(sizes) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(sizes)[:5]}")
    return kept, entries[~bad[owner]].reshape(len(kept), *(sizes or {0}))


def _scaled(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) in the smallest integer type that holds the block."""
    values = np.floor(SCALE * entries)
    most = np.abs(values).max(initial=0)
    if most > LARGEST:
        raise ValueError("an entry is too large for exact integers")
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _blocks(batches: Batches, id_type: pa.DataType) -> Batches:
    names = ["ids", "d", "kind", "body"]
    for batch in batches:
        kept, entries = finite_vectors(batch.column("vector"))
        if not len(kept):
            continue
        ids = batch.column("id").take(pa.array(kept))
        step = max(1, BLOCK_ENTRIES // entries.shape[1])
        for start in range(0, len(kept), step):
            values = _scaled(entries[start : start + step])
            part = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), ids.slice(start, len(values)))
            columns = [pa.array([x]) for x in (values.shape[1], values.dtype.str, values.tobytes())]
            yield pa.RecordBatch.from_arrays([part, *columns], names)


def _values(batch: pa.RecordBatch):
    """``(position, integers without OFFSET)`` of every stored block of a batch."""
    columns = (batch.column(name).to_pylist() for name in ("d", "kind", "body"))
    for at, (d, kind, body) in enumerate(zip(*columns)):
        yield at, np.frombuffer(body, kind).reshape(-1, d)


def _collected(blocks: DataFrame, partial: Callable, merge: Callable) -> bytes | None:
    """One value from all blocks: a part for each task, merged by a single task as they come in."""

    def parts(batches: Batches) -> Batches:
        found = None
        for batch in batches:
            for _, values in _values(batch):
                own = partial(values)
                found = own if found is None else merge(found, own)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["part"])

    def whole(batches: Batches) -> Batches:
        found = None
        for batch in batches:
            for part in batch.column("part").to_pylist():
                found = part if found is None else merge(found, part)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["part"])

    sent = blocks.select("d", "kind", "body").mapInArrow(parts, "part binary")
    rows = sent.repartition(1).mapInArrow(whole, "part binary").collect()
    return bytes(rows[0]["part"]) if rows else None


def _summed(blocks: DataFrame, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of an array of doubles whose size does not depend on them."""
    return np.frombuffer(
        _collected(
            blocks,
            lambda values: partial(values).tobytes(),
            lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes(),
        )
    )


def _integer_sums(values: np.ndarray) -> bytes:
    """Number, dimension and exact sums of a block, as text of any length."""
    small = len(values) * int(np.abs(values.astype(np.int64)).max(initial=0)) < 1 << 62
    sums = values.sum(axis=0, dtype=np.int64) if small else values.astype(object).sum(axis=0)
    return json.dumps([len(values), *map(int, sums)]).encode()


def _added(a: bytes, b: bytes) -> bytes:
    left, right = json.loads(a), json.loads(b)
    if len(left) != len(right):
        raise ValueError(f"vectors have different lengths: {sorted({len(left) - 1, len(right) - 1})}")
    return json.dumps([x + y for x, y in zip(left, right)]).encode()


def integer_rows(vectors: DataFrame, id_column: str, vector_column: str) -> Rows:
    """The finite vectors of a table as stored blocks of integers, with their number and sums."""
    id_type = vectors.schema[id_column].dataType
    chosen = vectors.select(vectors[id_column].alias("id"), vectors[vector_column].alias("vector"))
    schema = f"ids array<{id_type.simpleString()}>, d bigint, kind string, body binary"
    blocks = written(chosen.mapInArrow(lambda batches: _blocks(batches, id_type), schema), "whitening-blocks")
    found = _collected(blocks, _integer_sums, _added)
    n, *sums = json.loads(found) if found else [0]
    return Rows(blocks, n, sums)


def differences(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` exactly, as 64-bit integers or, where these are too small, as Python's."""
    most = max(int(np.abs(values.astype(np.int64)).max(initial=0)), max(map(abs, sums)) // n + 1)
    if 2 * n * most < 1 << 62:
        return n * values.astype(np.int64) - np.array(sums, np.int64)
    return n * values.astype(object) - np.array(sums, object)


def centred(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` as doubles, from exact differences."""
    return (differences(values, n, sums) / n).astype(np.float64)


def exact_deviation(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of ``(n * x - S)^2`` of every row; an error where 64 bits do not hold it."""
    far = differences(values, n, sums)
    if float(np.abs(far).max(initial=0)) ** 2 * far.shape[1] >= 1 << 62:
        far = far.astype(object)
    total = (far * far).sum(axis=1)
    if max(total, default=0) >= 1 << 63:
        raise OverflowError("a deviation does not fit 64 bits")
    return total.astype(np.int64)


def bidiagonal(product: Callable, d: int, total: float, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values, falling, of a matrix X known by its products.

    ``product(p)`` gives ``(|Xp|^2, X'Xp)`` for a vector p; ``total`` is the squared Frobenius norm of X. Left
    vectors have one entry per row of X. They are never stored: the k-th is X times the k-th column of ``P``,
    so ``P`` and their images under X' (``Z``) stand for them, and both sides are reorthogonalised in full.

    Ends when the ``wanted`` triplets have converged and no larger one can lie outside of the basis (the squared
    norm that it has not captured is smaller than the last of them), or with a basis of all d dimensions. Where
    products give no new direction, as with equal deviations or few rows, it goes on from a drawn one.
    """
    draw = np.random.default_rng(seed)
    V, P, Z = (np.zeros((d, 0)) for _ in range(3))
    B = np.zeros((0, 0))
    v, beta = None, 0.0
    while True:
        k = V.shape[1]
        scale = np.linalg.norm(B, 2) if k else np.sqrt(total)
        if k and beta <= 1e-14 * scale:
            v, beta = draw.standard_normal(d), 0.0
        elif v is None:
            v = draw.standard_normal(d)
        for _ in range(2 if k else 0):
            v = v - V @ (V.T @ v)
        v = v / np.linalg.norm(v)
        before = Z.T @ v
        p = v - P @ before
        square, image = product(p)
        # What is left of earlier left vectors in Xp, measured by the product itself.
        rest = P.T @ image
        p, image = p - P @ rest, image - Z @ rest
        alpha = np.sqrt(max(square - rest @ rest, 0.0))
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = B
        if k:
            grown[k - 1, k] = beta
        if alpha > 1e-14 * scale:
            grown[k, k] = alpha
            p, image = p / alpha, image / alpha
        else:
            p, image, alpha = np.zeros(d), np.zeros(d), 0.0
        B, V = grown, np.column_stack([V, v])
        P, Z = np.column_stack([P, p]), np.column_stack([Z, image])
        v = image - alpha * V[:, -1]
        for _ in range(2):
            v = v - V @ (V.T @ v)
        beta = float(np.linalg.norm(v))
        left, sigma, right = np.linalg.svd(B)
        if k + 1 == d:
            break
        if k + 1 >= wanted:
            last = sigma[wanted - 1]
            converged = beta * np.abs(left[-1, :wanted]).max() <= RESIDUAL * sigma[0]
            if converged and total - float((B * B).sum()) < last * last - 1e-13 * total:
                break
    return V @ right.T, sigma


def fit_whitening(rows: Rows, components: int = 32) -> Whitening:
    """Components of the covariance (divisor n) of stored rows, by falling deviation."""
    n, sums, d = rows.n, rows.sums, len(rows.sums)
    none = Whitening(np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not n:
        return none
    total = float(_summed(rows.blocks, lambda values: np.array([np.square(centred(values, n, sums)).sum()]))[0])
    if not total:
        return none

    def product(p: np.ndarray) -> tuple[float, np.ndarray]:
        def both(values: np.ndarray) -> np.ndarray:
            x = centred(values, n, sums)
            w = x @ p
            return np.concatenate([[w @ w], x.T @ w])

        found = _summed(rows.blocks, both)
        return float(found[0]), found[1:]

    wanted = min(components, d)
    vectors, sigma = bidiagonal(product, d, total, wanted)
    wanted = int((sigma[:wanted] > LEAST_DEVIATION * sigma[0]).sum())
    vectors, deviations = vectors[:, :wanted], sigma[:wanted] / np.sqrt(n)

    def moments(values: np.ndarray) -> np.ndarray:
        white = centred(values, n, sums) @ vectors / deviations
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    found = _summed(rows.blocks, moments) / n
    mean, square = found[:wanted], found[wanted:].reshape(wanted, wanted)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(wanted)).max())
    return Whitening(vectors, deviations, np.square(sigma[:wanted]) / total, error)


def whiten(vectors: DataFrame, id_column: str, vector_column: str, components: int = 32) -> DataFrame:
    """Whitened coordinates of every finite vector: one row for each vector and component.

    Returns ``(<id_column>, component, n, deviation, whitened, explained, identity_error)``. Entries are scaled to
    integers first, so sums and ``deviation`` (squared distance from the mean, times n squared) are exact.
    Components are unit eigenvectors of the covariance with divisor n, numbered from 1 by falling eigenvalue;
    equal eigenvalues share a subspace, of which some basis is taken. A direction whose standard deviation is below
    LEAST_DEVIATION of the largest has none to divide by and is left out, so there may be fewer than ``components``.

    The vectors are read once and stored as blocks of small integers; each step of the bidiagonalisation is one
    pass over these, from which a task sends one vector of the dimension's size. There are at most as many
    steps as dimensions, fewer where the variance falls off.

    Vectors that are null or empty, or hold a null, NaN or infinite entry, are dropped; vectors of different
    lengths are an error. A null id stays null, repeated rows are kept and count each, an empty table or one
    whose vectors are all equal gives no rows, and other columns are not read.
    """
    rows = integer_rows(vectors, id_column, vector_column)
    model, n, sums = fit_whitening(rows, components), rows.n, rows.sums
    wanted = len(model.deviations)

    def coordinates(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column("ids")
            for at, values in _values(batch):
                if not wanted:
                    continue
                white = centred(values, n, sums) @ model.components / model.deviations
                each = np.repeat(np.arange(len(values)), wanted)
                deviation = exact_deviation(values, n, sums)
                columns = {
                    id_column: ids[at].values.take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(values))),
                    "n": pa.array(np.full(len(each), n, np.int64)),
                    "deviation": pa.array(deviation[each]),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(model.explained, len(values))),
                    "identity_error": pa.array(np.full(len(each), model.identity_error)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = vectors.schema[id_column].dataType.simpleString()
    return rows.blocks.select("ids", "d", "kind", "body").mapInArrow(
        coordinates,
        f"{id_column} {kind}, component int, n bigint, deviation bigint, whitened double, explained double,"
        " identity_error double",
    )
