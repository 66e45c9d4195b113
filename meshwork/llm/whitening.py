"""Whitening of embeddings by spectral divide and conquer.

1. Every entry c of a vector becomes the whole number floor(64 c) + 1000000;
   the fit list is each distinct vector of such numbers once (a distributed
   ``distinct``: copies are combined before the shuffle).
2. Count and sums of the fit list are exact whole numbers. A second pass
   centres each vector, exactly, and then multiplies: tasks add up blocks of
   vectors and send one half matrix each, which Spark sums by cell.
3. ``spectral_components`` splits the covariance matrix V (D x D, on the
   driver: its size is given by the dimension, not by the rows). The mean of
   the eigenvalues of a block is its trace over its size, so shifted by it the
   block has eigenvalues of both signs unless all are equal. The polar factor
   U of the shifted block, by the QDWH iteration, gives the spectral
   projectors (I + U)/2 and (I - U)/2; an orthogonal basis of their ranges
   splits the block in two that are solved alike, down to single components.
4. The components (D x 16 numbers) travel to the tasks with the mean, and each
   vector is projected; no shuffle. A pass over the fit list measures the
   covariance of the result against the identity.

Edge cases: rows whose vector is null, empty or holds null or non-finite
entries are dropped; so are vectors of another length than most have (ties:
the longer). Entries too large for 64 bits saturate. Components without
variance (eigenvalue below rounding) cannot be scaled to one and are not
returned: fewer than 17 different vectors give fewer than 16 components, a
single one none. Equal eigenvalues: any orthogonal basis of their subspace, in
a fixed order. Repeated rows and ids are returned each; columns beside id and
vector are not looked at, whatever their names.
"""
from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, OFFSET = 64, 1_000_000
#: Rows that a task handles at once.
BLOCK_ROWS = 4096
_EPS = np.finfo(float).eps


def polar_factor(a):
    """The orthogonal polar factor of a symmetric matrix, by QDWH: Halley's
    iteration with weights that follow a lower bound of the least singular
    value. Steps with large weights use a QR factorisation, later ones a
    Cholesky factorisation; from any bound above 1e-16 six steps are enough."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = max(1 / (np.linalg.norm(np.linalg.inv(x), 2) * 1.1) if np.linalg.cond(x) < 1 / _EPS else _EPS, _EPS)
    one = np.eye(n)
    for _ in range(40):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square**2) if square < 1 else 0.0
        h = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * np.sqrt(1 + root)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            new = b / c * x + (h - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            factor = np.linalg.cholesky(one + c * (x.T @ x))
            solved = np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
            new = b / c * x + (h - b / c) * solved
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (h + b * square) / (1 + c * square), 1.0)
        if moved <= (4 * _EPS) ** (1 / 3) and 1 - low < 1e-8:
            return x
    return x


def _basis(projector, k):
    """Orthogonal bases of the range (k columns) and the null space of a
    spectral projector: columns of largest rest first, orthogonalised twice."""
    n = len(projector)
    start = np.zeros((n, k))
    rest = projector.copy()
    for j in range(k):
        at = int(np.argmax((rest * rest).sum(axis=0)))
        column = rest[:, at]
        for _ in range(2):
            column = column - start[:, :j] @ (start[:, :j].T @ column)
        start[:, j] = column / np.linalg.norm(column)
        rest -= np.outer(start[:, j], start[:, j] @ rest)
    q, _ = np.linalg.qr(projector @ start, mode="complete")
    return q[:, :k], q[:, k:]


def _split(v):
    """Bases of two invariant subspaces of a symmetric block, or None if it is
    a multiple of the identity. A shift next to an eigenvalue gives no clean
    projector; the next one tried lies towards the largest diagonal entry."""
    n, size = len(v), np.linalg.norm(v)
    mean = np.trace(v) / n
    if np.linalg.norm(v - mean * np.eye(n)) <= n * _EPS * size:
        return None
    best = None
    reach = np.linalg.norm(v - mean * np.eye(n)) / np.sqrt(n)
    for step in (0, 0.5, -0.5, 0.25, -0.25, 0.75, -0.75, 0.1, -0.1, 0.9, -0.9):
        u = polar_factor(v - (mean + step * reach) * np.eye(n))
        k = int(round((np.trace(u) + n) / 2))
        if not 0 < k < n:
            continue
        upper, lower = _basis((u + np.eye(n)) / 2, k)
        error = np.linalg.norm(upper.T @ v @ lower)
        if best is None or error < best[0]:
            best = error, upper, lower
        if error <= 10 * n * _EPS * size:
            break
    return None if best is None else best[1:]


def spectral_components(v):
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric
    positive semi-definite matrix."""
    v = (v + v.T) / 2
    found, todo = [], [(v, np.eye(len(v)))]
    while todo:
        block, basis = todo.pop()
        parts = _split(block) if len(block) > 1 else None
        if parts is None:
            found.append(basis)
            continue
        for part in parts:
            inner = part.T @ block @ part
            todo.append(((inner + inner.T) / 2, basis @ part))
    vectors = np.hstack(found)
    # twice is enough: columns orthogonal to working precision
    vectors = vectors @ (1.5 * np.eye(len(v)) - 0.5 * vectors.T @ vectors)
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(v))])
    return values[order], vectors * signs


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows that can be whitened."""
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    limit = float(2**62)
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-limit)), F.lit(limit))) + OFFSET)
    return rows.select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, dim: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(x, n: int, sums):
    """n x - S, exact: in 64 bits where it fits, else in Python's integers."""
    top = max(int(x.max()), -int(x.min()), 1) * n + max(abs(int(s)) for s in sums)
    if top < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviation(centred):
    """Sums of squares, exact: of halves of 26 bits in numpy, put together in
    Python's integers; None beyond 38 digits."""
    if centred.dtype != object and int(np.abs(centred).max()) < 2**52:
        high, low = centred >> 26, centred & (2**26 - 1)
        parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        sums = [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts))]
    else:
        sums = [int(s) for s in (centred.astype(object) ** 2).sum(axis=1)]
    return [decimal.Decimal(s) if s < 10**38 else None for s in sums]


def _moments(dim, n, sums, project=None):
    """Tasks' sums of products of centred vectors (projected, if wanted)."""
    def rows(batches):
        size = dim if project is None else project.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                y = _centred(_matrix(batch.column(0).slice(lo, BLOCK_ROWS), dim), n, sums).astype(float) / n
                y = y if project is None else y @ project
                total += y.T @ y
        i, j = np.triu_indices(size)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             names=["i", "j", "s"])
    return rows


def _covariance(fit: DataFrame, dim, n, sums, project=None):
    """The covariance matrix of the fit list (divisor n)."""
    size = dim if project is None else project.shape[1]
    cells = fit.mapInArrow(_moments(dim, n, sums, project), "i int, j int, s double")
    v = np.zeros((size, size))
    for i, j, s in cells.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # at most size**2 cells
        v[i, j] = v[j, i] = s / n
    return v


def _whiten(dim, n, sums, project, explained, error):
    k = project.shape[1]

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                centred = _centred(_matrix(part.column(1), dim), n, sums)
                white = (centred.astype(float) / n) @ project
                m = len(white)
                deviation = pa.array(_deviation(centred), pa.decimal128(38, 0))
                owner = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), deviation.take(owner), pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows


def whiten(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component`` from 1,
    ``n`` (size of the fit list), ``deviation`` (decimal(38, 0), exact;
    null beyond 38 digits),
    ``whitened``, ``explained`` (share of the variance), ``identity_error``."""
    rows = whole_vectors(embeddings, id_col, vector_col)
    id_type = dict(rows.dtypes)["vec_id"]
    schema = (f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], schema)
    dim = sizes[0]["d"]
    rows = rows.where(F.size("x") == dim)
    fit = materialise(rows.select("x").distinct())
    wide = lambda i: F.sum(F.element_at("x", i + 1).cast("decimal(38,0)"))
    n, *sums = fit.agg(F.count("*"), *(wide(i) for i in range(dim))).first()
    sums = [int(s) for s in sums]
    v = _covariance(fit, dim, n, sums)
    values, vectors = spectral_components(v)
    k = min(components, int((values > dim * _EPS * max(values[0], 0)).sum()))
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    project = vectors[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(_covariance(fit, dim, n, sums, project) - np.eye(k)).max())
    return rows.mapInArrow(_whiten(dim, n, sums, project, values[:k] / np.trace(v), error), schema)
