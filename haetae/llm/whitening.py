"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import cut_lineage

#: Values of a batch that are worked on as doubles at once.
AT_ONCE = 1 << 21
_LONG = (1 << 63) - 1


def pivoted_cholesky(matrix: np.ndarray, least: float = 1e-13) -> np.ndarray:
    """A factor L of ``matrix`` = L L^T with as many columns as the matrix has rank.

    The largest remaining diagonal element is the next pivot; it ends when that is under ``least`` of the first. With
    its rows in pivot order L is lower triangular.
    """
    left, columns, first = matrix.copy(), [], 0.0
    for _ in range(len(matrix)):
        at = int(left.diagonal().argmax())
        pivot = left[at, at]
        first = first or pivot
        if pivot <= max(least * first, 0.0):
            break
        column = left[:, at] / math.sqrt(pivot)
        left -= np.outer(column, column)
        left[at, :] = left[:, at] = 0.0  # what rounding left there
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((len(matrix), 0))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds of disjoint ones, as in a tournament."""
    ring = np.arange(n + n % 2)
    for _ in range(len(ring) - 1):
        a, b = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
        there = (a < n) & (b < n)
        yield a[there], b[there]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor`` factor^T by falling size, and its unit eigenvectors as columns.

    Pairs of columns are rotated until all are orthogonal to working precision: the squared norms of the columns are
    then the eigenvalues, and the columns divided by their norms are the eigenvectors.
    """
    u = factor[:, np.argsort(-(factor * factor).sum(0), kind="stable")].copy()
    for _ in range(sweeps if u.shape[1] > 1 else 0):
        worst = 0.0
        for i, j in _rounds(u.shape[1]):
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            turn = np.abs(ab) > 1e-15 * size
            worst = max(worst, float((np.abs(ab) / np.where(size > 0, size, 1)).max(initial=0)))
            zeta = np.where(turn, (bb - aa) / np.where(turn, 2 * ab, 1), 0)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(turn, t, 0)
            c = 1 / np.hypot(1, t)
            u[:, i], u[:, j] = c * a - c * t * b, c * t * a + c * b
        if worst <= 1e-15:
            break
    values = (u * u).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return values[order], u[:, order] / np.sqrt(values[order])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in slices of about AT_ONCE values, and the vectors of each as whole numbers."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, AT_ONCE // max(1, len(batch.column(at).values) // batch.num_rows))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield part, _matrix(part.column(at))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each dimension of a task's vectors: (dim, total), the number of rows as dim -1."""
    n, total = 0, None
    for _, x in _blocks(batches, 0):
        n += len(x)
        part = x.sum(0) if np.abs(x).max(initial=0) < 2**40 else x.astype(object).sum(0)
        total = part.astype(object) if total is None else total + part
    if n:
        numbers = [n, *total]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in numbers])], names=["dim", "total"])


def _products(mean: np.ndarray, base: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over a task's vectors of the products of their components, centred before and projected on ``base`` if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for _, x in _blocks(batches, 0):
            y = x - mean
            y = y if base is None else y @ base
            made = y.T @ y if made is None else made + y.T @ y
        if made is not None:
            i, j = np.triu_indices(len(made))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(made[i, j])], names=["i", "j", "v"])

    return run


def _covariance(fit: DataFrame, run: Callable, dims: int, n: int) -> np.ndarray:
    """The tasks' sums added up: a symmetric matrix of ``dims`` rows, divided by ``n``."""
    out = np.zeros((dims, dims))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int] | np.ndarray:
    """Sum over the dimensions of (n x - S)^2 in whole numbers; beyond a long the greatest long."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(t) for t in total), default=0)
    if len(total) * most * most <= _LONG:
        y = x * n - np.array(total, np.int64)
        return (y * y).sum(1)
    y = x.astype(object) * n - np.array(total, object)
    return [min(_LONG, int(v)) for v in (y * y).sum(1)]


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and leading component.

    Components of a vector are x = floor(``scale`` * c). The covariance, with divisor n, is over each distinct x vector
    once; its unit eigenvectors are numbered from 1 by falling eigenvalue e, up to ``components`` and the covariance's
    rank. whitened is x less the mean, projected on the component, over sqrt(e); explained is e over the trace;
    identity_error is the largest absolute entry of whitened's covariance less the identity.

    Null vectors and those with a null or non-finite component take no part. If lengths differ, the length that most
    distinct vectors have counts (the smaller on ties) and others take no part. Null ids, repeated rows (each gets its
    rows) and other columns (not read) make no difference; empty tables, vectors without components and vectors that are
    all the same give no rows. Numbers beyond a long count as the nearest long.

    Distinct vectors are found by a group with map-side combine, so copies are shuffled once for each task at most, and
    are written once; three narrow passes over them sum rows, products and the products of the projections. The driver
    gets one matrix of dimensions squared, whatever the number of rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    bound = lambda c: F.when(c >= 2.0**63, F.lit(_LONG)).when(c <= -(2.0**63), F.lit(-_LONG - 1)).otherwise(F.floor(c).cast("long"))
    rows = rows.select("vec_id", F.transform("v", lambda c: bound(c * F.lit(scale))).alias("x"))
    fit = cut_lineage(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    lengths = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = vectors.sparkSession.createDataFrame([], schema)
    if lengths is None or not lengths["size"]:
        return empty
    dims = lengths["size"]
    fit, rows = (df.filter(F.size("x") == dims) for df in (fit, rows))
    sums = {r["dim"]: int(r["total"]) for r in fit.mapInArrow(_sums, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n, total = sums[-1], [sums[d] for d in range(dims)]
    mean = np.array([t / n for t in total])
    values, base = one_sided_jacobi(pivoted_cholesky(covariance := _covariance(fit, _products(mean), dims, n)))
    if not len(values):
        return empty
    m = min(components, len(values))
    base = base[:, :m] / np.sqrt(values[:m])
    error = float(np.abs(_covariance(fit, _products(mean, base), m, n) - np.eye(m)).max())
    explained = values[:m] / np.trace(covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            at, k = np.repeat(np.arange(len(x)), m), len(x)
            away = np.repeat(np.array(_deviations(x, n, total), np.int64), m)
            made = [pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(away), pa.array(((x - mean) @ base).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *made], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, schema.replace("vec_id long", f"vec_id {kind}"))
