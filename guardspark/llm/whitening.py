"""Whitening of embeddings: principal components from a pivoted Cholesky factor.

Components become integers (floor of scale times the entry, plus an offset),
so that sums and the fit list, each distinct vector once, are exact. The
scatter matrix, centred before multiplying, is summed per task, then over a
few groups of tasks, then on the driver (GROUPS matrices of dim x dim).

* **Pivoted Cholesky**: P' A P = L L', largest remaining diagonal first; it
  stops where that is rounding noise, so L has as many columns as A has rank.
* **One-sided Jacobi** on L itself: columns are rotated in pairs until all
  are orthogonal, L J = U S. Then A = U S^2 U': the rotated columns' squared
  norms are the eigenvalues, the normalised columns the components. A is
  never rotated, so small eigenvalues keep their relative precision.

The error of the result is measured on the whitened fit list itself.

Edge cases: vectors that are null or hold null or non-finite entries take no
part; of vectors of several widths the most frequent width takes part (ties:
the larger); rows with a null or repeated id each have their rows; where the
covariance has rank r, there are min(r, ``components``) components (none for a
single distinct vector, or an empty table: no rows); ``deviation`` is null
where it does not fit a signed 64-bit integer; entries beyond +-2^52 / scale
are clipped to that; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, at_least_slots

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
GROUPS = 32
TILE = 4096
SWEEPS = 60
ROWS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): A[order][:, order] = L L' with L lower trapezoidal, its
    columns as many as the rank."""
    a = np.array(a, np.float64)
    d = len(a)
    order, lower = np.arange(d), np.zeros((d, d))
    noise = d * np.finfo(float).eps * max(a.diagonal().max(initial=0), 0)
    for j in range(d):
        rest = a.diagonal()[j:] - (lower[j:, :j] ** 2).sum(axis=1)
        p = j + int(np.argmax(rest))
        if rest[p - j] <= noise:
            return lower[:, :j], order
        for m in (a, lower):
            m[[j, p]] = m[[p, j]]
        a[:, [j, p]] = a[:, [p, j]]
        order[[j, p]] = order[[p, j]]
        lower[j, j] = np.sqrt(rest[p - j])
        lower[j + 1:, j] = (a[j + 1:, j] - lower[j + 1:, :j] @ lower[j, :j]) / lower[j, j]
    return lower, order


def _pairings(n: int):
    """Rounds of disjoint column pairs, every pair once (a round-robin)."""
    ring = list(range(n)) + ([None] if n % 2 else [])
    for _ in range(len(ring) - 1):
        pairs = [(x, y) for x, y in zip(ring[:len(ring) // 2], reversed(ring[len(ring) // 2:])) if x is not None and y is not None]
        yield np.array(pairs, int).reshape(-1, 2).T
        ring = ring[:1] + ring[-1:] + ring[1:-1]


def one_sided_jacobi(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): squared norms of the rotated columns, falling, and
    the normalised columns."""
    u = lower.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for x, y in _pairings(u.shape[1]):
            p, q = u[:, x], u[:, y]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            size = np.sqrt(pp * qq)
            off = np.divide(np.abs(pq), size, out=np.zeros_like(pq), where=size > 0)
            worst = max(worst, off.max(initial=0))
            turn = off > np.finfo(float).eps
            zeta = np.divide(qq - pp, 2 * pq, out=np.zeros_like(pq), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            u[:, x], u[:, y] = c * p - c * t * q, c * t * p + c * q
        if worst <= 4 * np.finfo(float).eps:
            break
    values = (u * u).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order] / np.sqrt(values[order])


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a scatter
    matrix, as many as its rank."""
    lower, order = pivoted_cholesky(scatter)
    values, vectors = one_sided_jacobi(lower)
    back = np.empty_like(vectors)
    back[order] = vectors
    return values, back


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def summed(df: DataFrame, column: str, of_tile, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over the rows of ``df`` of ``of_tile(matrix)``, an array of
    ``shape``: per task, then per group of tasks, then on the driver."""
    def total(parts):
        acc = np.zeros(shape)
        for x in parts:
            acc += x
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=["m"])

    def tiles(batches):
        def each():
            for b in batches:
                m = _matrix(b.column(0))
                for lo in range(0, len(m), TILE):
                    yield of_tile(m[lo:lo + TILE])
        return total(each())

    def groups(batches):
        return total(np.frombuffer(m, np.float64).reshape(shape) for b in batches for m in b.column(0).to_pylist())

    parts = df.select(column).mapInArrow(tiles, "m binary").repartition(GROUPS).mapInArrow(groups, "m binary")
    out = np.zeros(shape)
    for r in parts.collect():
        out += np.frombuffer(r["m"], np.float64).reshape(shape)
    return out


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x) of the usable vectors."""
    v = F.col(vec_col).cast("array<double>")
    bound = F.lit(float(1 << 52))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, bound), -bound)).cast("long") + F.lit(offset).cast("long"))
    usable = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(usable & (F.size(v) > 0)).select(F.col(id_col).alias("vec_id"), whole.alias("x"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2 per row, exact; None where it
    does not fit 64 bits."""
    s = np.array(sums, object)
    wide = max(abs(v) for v in sums) + n * int(np.abs(x).max(initial=0)) >= 1 << 62
    if not wide:
        d = n * x - s.astype(np.int64)
        if float((d.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2.0 ** 62:
            return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - s
    return [t if t < 1 << 63 else None for t in (d * d).sum(axis=1)]


def whiten(vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1),
    n (distinct vectors), deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    stage = Stage(spark, "whitening")
    rows = stage.put(integer_vectors(at_least_slots(vectors), id_col, vec_col, scale, offset), "integers")
    widths = {r["w"]: r["count"] for r in rows.groupBy(F.size("x").alias("w")).count().collect()}    # a row per width
    if not widths:
        return spark.createDataFrame([], ROWS)
    dim = max(widths, key=lambda w: (widths[w], w))
    rows = rows.where(F.size("x") == dim)
    # Equal vectors meet by partial aggregation first: a hot one is one row per task.
    fit = stage.put(rows.groupBy("x").agg(F.lit(1).alias("_")).select("x"), "fit")
    found = fit.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim))).first()
    n, sums = found["n"], [int(found[f"s{i}"]) for i in range(dim)]
    base = np.array([s // n for s in sums], np.int64)              # integers first: the rest of the mean is below one
    rest = np.array([(s - n * (s // n)) / n for s in sums])

    def centred(x):
        return (x - base).astype(np.float64) - rest

    def scatter(x):
        c = centred(x)
        return c.T @ c

    values, vecs = components(summed(fit, "x", scatter, (dim, dim)))
    share = values / values.sum() if len(values) else values
    values, vecs = values[:count] / n, vecs[:, :count]
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], ROWS)
    project = vecs / np.sqrt(values)

    def check(x):
        w = centred(x) @ project
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = summed(fit, "x", check, (k + 1, k)) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())

    def run(batches):
        for b in batches:
            ids, x = b.column(0), _matrix(b.column(1))
            for lo in range(0, len(x), TILE):
                tile = x[lo:lo + TILE]
                m = len(tile)
                each = np.repeat(np.arange(m), k)
                dev = pa.array(deviations(tile, n, sums), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, m).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), dev.take(pa.array(each)), pa.array((centred(tile) @ project).reshape(-1)),
                     pa.array(np.tile(share[:k], m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, ROWS)
