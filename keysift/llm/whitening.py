"""Whitening of vectors by their leading principal components.

The components are found by subspace iteration with Chebyshev filters. The covariance V is never
formed: all that is asked of the table is V Q for a thin block Q, one distributed pass that sums
Xc' (Xc Q) over the centred rows Xc. A filter of degree DEGREE is the three-term recurrence of
the Chebyshev polynomial that stays small on the unwanted part of the spectrum and grows fast above
it; its interval reaches from a Lanczos estimate of the least eigenvalue up to the least
Ritz value of the block. QR and a Rayleigh-Ritz step follow, and the rounds go on until
every wanted pair's residual |V q - e q| is at rounding level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import cut

COMPONENTS = 16
#: Vectors of the block beyond the wanted ones, and passes per round at most.
GUARD, DEGREE = 16, 8
#: A pair is certified when its residual is below this share of the largest eigenvalue; a round that no longer
#: improves on residuals below the second is at rounding level.
CERTIFIED, ROUNDING = 2e-14, 1e-11
ROUNDS = 400
#: How much more a filter may amplify the largest eigenvalue than the unwanted ones; beyond it rounding hides the
#: smaller wanted ones, so the degree is less.
GROWTH = 1e10
#: Entries below this share of the trace are no variance but rounding.
ZERO = 1e-13
SCALE, SHIFT = 64, 1_000_000
#: Entries of at least this size have no exact grid point and count as non-finite.
FAR = 2.0 ** 52 / SCALE
ROWS = 4096
SEED = 12


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _total(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``of`` gives for a block of them: ``size`` numbers per task, summed by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in _chunks(batches):
            total += of(_matrix(batch.column("x"))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    parts = fit.select("x").mapInArrow(work, "part array<double>")
    found = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["at"]] = r["value"]
    return out


def _sums(fit: DataFrame) -> list[int]:
    """Exact sums of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in _chunks(batches):
            x = _matrix(batch.column("x"))
            a, b = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
            high, low = (a, b) if high is None else (high + a, low + b)
        if high is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(high), pa.array(low)], ["at", "high", "low"])

    wide = "decimal(38,0)"
    rows = fit.select("x").mapInArrow(work, "at int, high long, low long").groupBy("at").agg(
        F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()
    return [(int(r["high"]) << 26) + int(r["low"]) for r in sorted(rows, key=lambda r: r["at"])]


def _centred(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """n * x - S, exactly: in 64 bits where that holds it, else in integers of any size."""
    small = np.array(sums, np.int64) if all(abs(s) < 1 << 62 for s in sums) else None
    wide = np.array(sums, object)

    def of(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, len(sums)), np.int64)
        if small is not None and n * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62:
            return n * x - small
        return n * x.astype(object) - wide

    return of


def _squares(d: np.ndarray) -> list[int | None]:
    """Each row's exact sum of squares; null beyond a long."""
    if not len(d):
        return []
    if d.dtype != object and max(abs(int(d.max())), abs(int(d.min()))) ** 2 * d.shape[1] < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    found = [sum(int(v) * int(v) for v in row) for row in d.tolist()]
    return [s if s < 1 << 63 else None for s in found]


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive operator, and unit eigenvectors as columns.

    ``times`` applies it to a block. Raises RuntimeError when ROUNDS rounds certify nothing.
    """
    rng = np.random.Generator(np.random.PCG64(SEED))
    wanted = min(wanted, dim)
    block = min(dim, wanted + GUARD)
    q = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    krylov = rng.standard_normal(dim)
    krylov, before, alphas, betas = krylov / np.linalg.norm(krylov), np.zeros(dim), [], []
    low, worst = 0.0, math.inf
    vq = times(q)
    for turn in range(ROUNDS):
        e, turned = np.linalg.eigh((lambda m: (m + m.T) / 2)(q.T @ vq))
        e, turned = e[::-1], turned[:, ::-1]
        q, vq = q @ turned, vq @ turned
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0).max()
        top = max(e[0], 0.0)
        if block == dim or residual <= CERTIFIED * top or (residual <= ROUNDING * top and residual > worst / 2):
            return e[:wanted], q[:, :wanted]
        worst = min(worst, residual)
        high = max(e[-1], ZERO * top)
        half, mid = max((high - low) / 2, ZERO * top), (high + low) / 2
        reach = max((top - mid) / half, 1.0)
        degree = max(1, min(DEGREE, int(math.acosh(GROWTH) / max(math.acosh(reach), 1e-9))))
        first = s = 1 / reach
        x, y = q, (vq - mid * q) * (s / half)
        for _ in range(degree - 1):
            if len(alphas) < DEGREE:  # the same pass carries one Lanczos vector
                both = times(np.column_stack([y, krylov]))
                vy, v = both[:, :-1], both[:, -1] - (betas[-1] * before if betas else 0.0)
                alphas.append(float(krylov @ v))
                v = v - alphas[-1] * krylov
                betas.append(float(np.linalg.norm(v)))
                before, krylov = krylov, v / betas[-1] if betas[-1] > ZERO * top else np.zeros(dim)
                ended = len(alphas) == DEGREE
            else:
                vy, ended = times(y), False
            new = 1 / (2 / first - s)
            x, y, s = y, (vy - mid * y) * (2 * new / half) - s * new * x, new
            if ended:  # for the next rounds
                t = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
                low = max(0.0, float(np.linalg.eigvalsh(t)[0]) - betas[-1])
        size = np.linalg.norm(y, axis=0)
        q = np.linalg.qr(y / np.where(size > 0, size, 1.0))[0]
        vq = times(q)
    raise RuntimeError(f"no certified components after {ROUNDS} rounds: residual {worst}")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened coordinates of each vector on its table's first components.

    A vector's entries c become x = floor(64 c) + 1000000; the covariance is that of the distinct x vectors. A row per
    usable row and component of positive variance, at most ``components``: ``id_col``, ``component`` (from 1),
    ``n`` (distinct vectors), ``deviation`` (exact sum of (n x - S)^2; null beyond a long), ``whitened``,
    ``explained`` (share of the whole variance) and ``identity_error`` (how far the whitened covariance
    is from the identity). A component's sign makes its largest entry positive.

    Vectors that are null, empty, or hold null, non-finite or far (beyond 2^46) entries give no row, nor do
    those of another length than most (of equally many, the longest stays). Equal vectors are fitted once and
    every row of them is returned; rows of a null or repeated id are rows like others. A table with
    fewer than two distinct vectors has no variance, hence no row. Other columns are not read.
    """
    raw = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < FAR)) & (F.size("v") > 0)
    grid = raw.where(fine).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    rows = cut(grid, "grid")
    kind = grid.schema["id"].dataType.simpleString()
    schema = "id " + kind + ", component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dim = lengths["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = cut(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = _sums(fit)
    centred = _centred(n, sums)
    place = lambda x: centred(x).astype(np.float64) / n

    def times(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            if not len(x):
                return np.zeros(q.shape)
            c = place(x)
            return c.T @ (c @ q)

        return _total(fit, of, q.size).reshape(q.shape) / n

    trace = float(_total(fit, lambda x: (place(x) ** 2).sum(axis=0) if len(x) else np.zeros(dim), dim).sum()) / n
    if not trace > 0:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    e, q = leading(times, dim, components)
    use = e > ZERO * trace
    e, q = e[use], q[:, use]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    k = len(e)
    white = q / np.sqrt(e)

    def moments(x: np.ndarray) -> np.ndarray:
        w = place(x) @ white if len(x) else np.zeros((0, k))
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    found = _total(fit, moments, k * k + k) / n
    mean = found[k * k:]
    error = float(np.abs(found[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            d = centred(_matrix(batch.column("x")))
            size = len(d)
            if not size:
                continue
            w = (d.astype(np.float64) / n) @ white
            again = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(again), pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()),
                 pa.array(np.full(size * k, n), pa.int64()), pa.array(_squares(d), pa.int64()).take(again), pa.array(w.ravel()),
                 pa.array(np.tile(e / trace, size)), pa.array(np.full(size * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
