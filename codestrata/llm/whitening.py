"""Whitened embeddings: leading principal components by Jacobi-Davidson, without a covariance matrix.

Entries become the whole numbers ``x = floor(64 * c) + 1000000``. The fit list holds every
distinct vector of them once: n vectors with the sums S of each dimension, both exact. The
covariance V (divisor n) is only ever applied to a few vectors at a time: a Spark job over
the fit list centres every row exactly, ``(n * x - S) / n``, multiplies, and adds up the
partial products of the partitions. The driver holds the search space, a few dozen vectors
of the width of an embedding, whatever the number of rows.

Search: Rayleigh-Ritz on the subspace gives approximate pairs. Pairs whose residual is at
rounding level are locked. For each of the others the correction equation, projected away
from the locked pairs and the current approximations, is solved by MINRES; all of them
advance in step, so that a step costs one job. The corrections extend the subspace, which
is cut back to its best directions when it grows too wide.

Cases: rows without a vector, with a null or non-finite entry, or with an entry beyond 2**45
(x would not fit exact arithmetic) take no part, nor do empty vectors and those of another
length than the most frequent one (of equally frequent ones, the shortest). A null vec_id
stays, repeated rows stay each. Dimensions without variance give no component: there are as
many as V has eigenvalues above 1e-12 of its trace, ``COMPONENTS`` at most, and no rows at
all if there is none. Equal eigenvalues: any orthonormal basis, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import ship
from codestrata.session import cut_lineage, release

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000

#: Larger entries do not fit exact arithmetic.
LARGEST = float(1 << 45)

#: Residuals count as rounding errors below this share of the largest eigenvalue.
PRECISION = 1e-13

#: If rounding keeps a residual above it, steps without progress end the search below this share.
STALLED = 1e-11

#: Steps of MINRES for one correction, and the share of the residual at which it ends.
INNER, ENOUGH = 6, 1e-3

#: Vectors that a partition multiplies at a time.
ROWS = 4096


class Fit(NamedTuple):
    """What the fit list gives: its size, sums, components (columns), eigenvalues, trace and largest deviation from the identity."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def integers(rows: DataFrame, column: str = "embedding") -> Column:
    """The vector as whole numbers, null if it takes no part."""
    def whole(c: Column) -> Column:
        return F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST), F.lit(False))

    usable = (F.size(column) > 0) & F.forall(column, whole)
    return F.when(usable, F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of all rows that take part."""
    rows = embeddings.select("vec_id", integers(embeddings).alias("x")).filter("x is not null")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("x") == (common.d if common else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            cut = batch.slice(at, ROWS)
            yield cut, _matrix(cut.column(column))


def _added(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], kind: str, size: int) -> list:
    """Sum over the fit list of ``work(x)``, an array of ``size`` numbers: each partition adds up its own, Spark the partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0):
            more = work(x).ravel()
            total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    summed = "decimal(38,0)" if kind == "long" else "double"
    parts = fit.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum(F.col("v").cast(summed)).alias("v"))
    out = [0] * size
    for row in parts.collect():  # as many rows as numbers asked for
        out[row.i] = row.v
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / float(n)


def products(fit: DataFrame, n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance applied to the columns of a matrix, by one job."""
    def apply(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ block)

        return np.array(_added(fit, work, "double", block.size), float).reshape(block.shape) / n

    return apply


def _away(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The block without its parts in an orthonormal basis; twice, for orthogonality to rounding."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions that the block adds to the basis; those within rounding of it are left out."""
    found = basis[:, :0]
    for v in block.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = _away(_away((v / size)[:, None], basis), found)
        left = np.linalg.norm(v)
        if left > 1e-8:
            v = _away(_away(v / left, basis), found)
            found = np.hstack([found, v / np.linalg.norm(v)])
    return found


def corrections(apply: Callable, away: np.ndarray, shifts: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """MINRES for ``P (V - shift) P t = -residual`` of every column, in step; P projects away from a basis."""
    b = _away(-residuals, away)
    beta = np.linalg.norm(b, axis=0)
    goal, x = beta * ENOUGH, np.zeros_like(b)
    v_old, v = np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    eta, c, c_old, s, s_old = beta.copy(), *(np.full_like(beta, k) for k in (1.0, 1.0, 0.0, 0.0))
    norm, going = beta.copy(), beta > 0
    previous = beta * 0
    for _ in range(INNER):
        if not going.any():
            break
        p = np.zeros_like(b)
        p[:, going] = _away(apply(_away(v[:, going], away)) - shifts[going] * v[:, going], away)
        alpha = (v * p).sum(0)
        p = p - alpha * v - previous * v_old
        following = np.linalg.norm(p, axis=0)
        # rotate the new column of the tridiagonal matrix
        r1 = c * alpha - c_old * s * previous
        r2, r3 = s * alpha + c_old * c * previous, s_old * previous
        size = np.hypot(r1, following)
        safe = np.where(size > 0, size, 1)
        c_old, s_old, c, s = c, s, np.where(size > 0, r1 / safe, 1), np.where(size > 0, following / safe, 0)
        direction = (v - r3 * w_old - r2 * w) / safe
        w_old, w = w, direction
        x = x + np.where(going & (size > 0), c * eta, 0) * direction
        eta = -s * eta
        norm = np.where(going, np.abs(eta), norm)
        v_old, v = v, p / np.where(following > 0, following, 1)
        previous = following
        going = going & (norm > goal) & (following > 1e-14 * beta)
    return _away(x, away)


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues (falling) and their unit eigenvectors of a symmetric operator on d dimensions."""
    rng = np.random.default_rng(7)
    widest = max(4 * wanted, wanted + 8)
    basis = _orthonormal(rng.standard_normal((d, min(d, wanted + 4))), np.zeros((d, 0)))
    image = apply(basis)
    best, idle = np.inf, 0
    for _ in range(rounds):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn[:, :wanted], image @ turn[:, :wanted]
        residuals = moved - ritz * values[:wanted]
        sizes, scale = np.linalg.norm(residuals, axis=0), max(abs(values[0]), np.finfo(float).tiny)
        locked = np.logical_and.accumulate(sizes <= PRECISION * scale)
        worst = sizes.max()
        idle = 0 if worst < best / 2 else idle + 1
        best = min(best, worst)
        if locked.all() or (idle >= 3 and worst <= STALLED * scale) or basis.shape[1] == d and worst <= STALLED * scale:
            return values[:wanted], ritz
        if basis.shape[1] + wanted > min(widest, d) and basis.shape[1] > 2 * wanted and widest < d:
            keep = 2 * wanted
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
        steps = corrections(apply, ritz, values[:wanted][~locked], residuals[:, ~locked])
        more = _orthonormal(steps, basis)
        if not more.shape[1]:
            more = _orthonormal(rng.standard_normal((d, min(4, d - basis.shape[1]))), basis)
        image = np.hstack([image, apply(more)])
        basis = np.hstack([basis, more])
    raise ArithmeticError(f"residual {worst / scale:.1e} of the largest eigenvalue after {rounds} rounds")


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the distinct vectors of ``usable`` rows; None if there is no variance."""
    ship(rows.sparkSession)
    fit = cut_lineage(rows.select("x").distinct())
    try:
        n, d = fit.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        if n < 2:
            return None
        sums = np.array([int(v) for v in _added(fit, lambda x: x.sum(0), "long", d)], dtype=np.int64)
        trace = _added(fit, lambda x: (_centred(x, n, sums) ** 2).sum(keepdims=True), "double", 1)[0] / n
        if not trace > 0:
            return None
        values, vectors = jacobi_davidson(products(fit, n, sums), d, min(components, d))
        real = values > 1e-12 * trace
        values, vectors = values[real], vectors[:, real]

        def squares(x: np.ndarray) -> np.ndarray:
            y = _centred(x, n, sums) @ vectors / np.sqrt(values)
            return y.T @ y

        k = len(values)
        covariance = np.array(_added(fit, squares, "double", k * k), float).reshape(k, k) / n
        return Fit(n, sums, vectors, values, trace, float(np.abs(covariance - np.eye(k)).max()))
    finally:
        release(fit)


def _deviation(diff: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if np.abs(diff).max(initial=0) < 1 << 28 and diff.shape[1] < 128:
        return (diff * diff).sum(1).tolist()
    return [sum(v * v for v in row) for row in diff.tolist()]


def whitened(rows: DataFrame, fit: Fit | None) -> DataFrame:
    """A row for each ``usable`` row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    ship(rows.sparkSession)
    n, sums, k = fit.n, fit.sums, len(fit.values)
    turn, explained, error = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace, fit.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, 1):
            m, diff = len(x), n * x - sums
            deviations = np.array(_deviation(diff), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(np.repeat(deviations, k)), pa.array(((diff / float(n)) @ turn).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, schema)


def op13(embeddings: DataFrame) -> DataFrame:
    rows = usable(embeddings)
    return whitened(rows, fitted(rows))
