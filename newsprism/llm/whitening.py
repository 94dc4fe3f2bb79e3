"""Whitening of embeddings by their leading principal components (operator 11).

A component c of a vector becomes the long ``x = floor(1024 c) + 100000``. Two passes of Spark give
the exact sums per dimension and the covariance, each row centred (``(n x - S) / n``, exact
integers up to the division) before it is multiplied; partial sums leave a task as one triangle of
``dims * (dims + 1) / 2`` numbers, whatever the rows. The covariance of at most ``dims ** 2``
numbers goes to the driver: Householder reflections bring it to tridiagonal form, Sturm counts
bisect its leading eigenvalues, inverse iteration gives their vectors, reorthogonalised within
clusters of close eigenvalues. The components (``MOST`` at most) are broadcast, a third pass
measures the covariance of the projections, a fourth puts them out. All passes are maps over the
table; nothing but the partial sums is shuffled.

Results for odd rows: a vector that is null, or holds null or non-finite entries, takes no part,
nor does an empty one; if vectors differ in length, those of the commonest length (the longer, of
equally common ones) take part; an entry of magnitude 2^30 or more does not leave the sums exact
and its vector takes no part. Repeated rows count and come back each; a null vec_id is kept.
Directions without variance (eigenvalue below ``dims`` rounding errors of the first) cannot be
scaled to 1 and are no components, so an empty table, one row and equal rows give no result. A
``deviation`` beyond 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

MOST = 8  # components put out
LIMIT = float(1 << 30)
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_EPS = np.finfo(float).eps


def integers(column: pa.Array, offset: int = 0, limit: float = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of the sound vectors in a list column: their places and
    ``floor(1024 c) + offset`` as an int64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    value = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    for length in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == length)
        c = value[at[rows][:, None] + np.arange(length)]
        sound = (np.abs(c) < limit).all(1)  # false for NaN, too
        if sound.any():
            yield rows[sound], np.floor(1024.0 * c[sound]).astype(np.int64) + offset


# ------------------------------------------------------------------ eigenvectors (driver, dims x dims)
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with ``a = q t q'``, by Householder reflections."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0:
            continue
        x /= scale
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        if x @ x == 0:
            continue
        v = x / np.sqrt(x @ x)
        # both sides at once: a - v w' - w v'
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        head = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = head
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each x: the negative pivots of
    its factorisation shifted by x."""
    least = np.finfo(float).tiny * max(1.0, float((e * e).max(initial=0.0)))
    count = np.zeros(len(x), np.int64)
    pivot = d[0] - x
    for i in range(len(d)):
        if i:
            pivot = d[i] - x - (e[i - 1] * e[i - 1]) / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: bisection of Gershgorin's interval by Sturm counts."""
    reach = np.concatenate([np.abs(e), [0]]) + np.concatenate([[0], np.abs(e)])
    norm = float((np.abs(d) + reach).max())
    lo = np.full(k, (d - reach).min() - _EPS * norm)
    hi = np.full(k, (d + reach).max() + _EPS * norm)
    place = len(d) - 1 - np.arange(k)  # of the eigenvalue, counted from the smallest
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi) | (hi - lo <= _EPS * np.maximum(np.abs(mid), _EPS * norm))).all():
            return mid
        above = sturm_count(d, e, mid) > place
        hi, lo = np.where(above, mid, hi), np.where(above, lo, mid)


def _solve(d: np.ndarray, e: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """``t z = b`` for a tridiagonal t, by elimination with row exchanges (pivots of ``least`` at least)."""
    n = len(d)
    diag, up, up2, z = d.tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        low = float(e[i])
        if abs(low) > abs(diag[i]):
            diag[i], low = low, diag[i]
            up[i], diag[i + 1] = diag[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            z[i], z[i + 1] = z[i + 1], z[i]
        if abs(diag[i]) < least:
            diag[i] = least if diag[i] >= 0 else -least
        f = low / diag[i]
        diag[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
        z[i + 1] -= f * z[i]
    if abs(diag[-1]) < least:
        diag[-1] = least if diag[-1] >= 0 else -least
    for i in range(n - 1, -1, -1):
        s = z[i]
        if i + 1 < n:
            s -= up[i] * z[i + 1]
        if i + 2 < n:
            s -= up2[i] * z[i + 2]
        z[i] = s / diag[i]
    return np.array(z)


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse iteration; within a cluster
    (gaps below a thousandth of the norm) each is kept orthogonal to those before it."""
    n = len(d)
    norm = float(max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny))
    rng = np.random.default_rng(11)
    z = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        # equal eigenvalues are set apart a little, as equal shifts would give equal vectors
        shift = min(value, shift - 10 * _EPS * norm) if k > first else value
        v = rng.standard_normal(n)
        best, left = None, np.inf
        for _ in range(12):
            v /= np.abs(v).max()
            v = _solve(d - shift, e, v, _EPS * norm)
            v /= np.abs(v).max()  # far from overflow before squaring
            for _ in range(2):
                v -= z[:, first:k] @ (z[:, first:k].T @ v)
            size = np.sqrt(v @ v)
            if not size > 1e-8:
                v = rng.standard_normal(n)
                continue
            v /= size
            t = d * v
            t[:-1] += e * v[1:]
            t[1:] += e * v[:-1]
            rest = float(np.abs(t - value * v).max())
            if rest < left:
                best, left = v.copy(), rest
            elif best is not None:
                break
        z[:, k] = best
    return z


def principal_components(v: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the leading components of a covariance."""
    d, e, q = tridiagonal(v)
    values = leading_eigenvalues(d, e, min(most, len(d)))
    values = values[values > len(d) * _EPS * max(float(values[0]), 0.0)]
    if not len(values):
        return values, np.zeros((len(d), 0))
    return values, q @ tridiagonal_vectors(d, e, values)


# ------------------------------------------------------------------ passes
def _matching(table: DataFrame, fn, schema: str, size: int | None = None) -> DataFrame:
    """``fn(batches)`` over (vec_id column, rows, x) of the batches, x of length ``size``."""

    def run(batches):
        def parts():
            for batch in batches:
                for rows, x in integers(batch.column("embedding"), 100_000):
                    if size is None or x.shape[1] == size:
                        yield batch.column("vec_id"), rows, x

        yield from fn(parts())

    return table.mapInArrow(run, schema)


def _sums(parts) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, list[int]]] = {}
    for _, _, x in parts:
        n, s = total.get(x.shape[1], (0, [0] * x.shape[1]))
        total[x.shape[1]] = n + len(x), [a + int(b) for a, b in zip(s, x.sum(0))]
    for size, (n, s) in total.items():
        values = [Decimal(v) for v in (n, *s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size + 1, size, np.int32)), pa.array(np.arange(-1, size, dtype=np.int32)),
             pa.array(values, pa.decimal128(38, 0))], names=["size", "i", "s"])


def centred(x: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """(x - s / n as doubles, sum over a row of (n x - s)^2 as longs or Python integers)."""
    big = float(np.abs(x).max(initial=0)) * n + max(abs(v) for v in s)
    if big < 2**62:
        apart = n * x - np.array(s, np.int64)
        reach = float(np.abs(apart).max(initial=0))
        squares = (apart * apart).sum(1) if reach * reach * x.shape[1] < 2**62 else (apart.astype(object) ** 2).sum(1)
        return apart / n, squares
    apart = n * x.astype(object) - np.array(s, object)
    return (apart / n).astype(float), (apart * apart).sum(1)


def _triangle(fn, k: int):
    """Partial sums of ``rows' rows`` and of the rows of ``fn(x)``: (i, j, v), i <= j, j = k the sums."""
    i, j = np.triu_indices(k)

    def run(parts):
        square, plain, seen = np.zeros((k, k)), np.zeros(k), False
        for _, _, x in parts:
            w = fn(x)
            square += w.T @ w
            plain += w.sum(0)
            seen = True
        if seen:
            at = np.arange(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i, at]).astype(np.int32)),
                 pa.array(np.concatenate([j, np.full(k, k)]).astype(np.int32)),
                 pa.array(np.concatenate([square[i, j], plain]))], names=["i", "j", "v"])

    return run


def _covariance(table: DataFrame, fn, size: int, k: int, n: int) -> np.ndarray:
    """Covariance (divisor n) of the rows ``fn(x)``, which are centred already; what rounding
    leaves of their mean is taken off."""
    cells = _matching(table, _triangle(fn, k), "i int, j int, v double", size)
    square, plain = np.zeros((k, k)), np.zeros(k)
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dims^2 at most
        if j == k:
            plain[i] = v
        else:
            square[i, j] = square[j, i] = v
    return square / n - np.outer(plain / n, plain / n)


def whiten(spark: SparkSession, table: DataFrame, *, most: int = MOST) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound row
    of ``table(vec_id, embedding)`` and each of its ``most`` leading components."""
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sums = _matching(table, _sums, "size int, i int, s decimal(38,0)")
    sums = stored(spark, sums.groupBy("size", "i").agg(F.sum("s").alias("s")), "sums")
    usual = sums.where("i = -1").orderBy(F.col("s").desc(), F.col("size").desc()).first()
    if usual is None:
        return spark.createDataFrame([], OUT)
    size, n = usual["size"], int(usual["s"])
    s = [int(r["s"]) for r in sums.where((F.col("size") == size) & (F.col("i") >= 0)).orderBy("i").collect()]
    v = _covariance(table, lambda x: centred(x, n, s)[0], size, size, n)
    values, vectors = principal_components(v, most)
    if not len(values):
        return spark.createDataFrame([], OUT)
    k = len(values)
    scaled = spark.sparkContext.broadcast(vectors / np.sqrt(values))
    explained = values / np.trace(v)
    error = float(np.abs(_covariance(table, lambda x: centred(x, n, s)[0] @ scaled.value, size, k, n) - np.eye(k)).max())

    def project(parts):
        for ids, rows, x in parts:
            for lo in range(0, len(rows), 8192):
                apart, squares = centred(x[lo : lo + 8192], n, s)
                white = apart @ scaled.value
                m = len(white)
                deviation = [q if q < 2**63 else None for q in squares.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(rows[lo : lo + 8192], k))),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _matching(table, project, OUT, size)
