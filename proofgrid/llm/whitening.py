"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson iteration.

The covariance is never built. Every product of it with a block of vectors is one pass over the embeddings: tasks
centre their vectors, multiply, and emit one partial block each; partial blocks are added in groups of tasks and then
on the driver (dimension x block numbers, whatever the number of rows). The rest of the iteration works on blocks of
that size: Rayleigh-Ritz on a growing subspace, correction equations of all open pairs solved side by side by MINRES
with the found vectors projected out, locking of the pairs whose residual is at rounding level, restart with the best
Ritz vectors when the subspace is full. At the end all residuals are taken again by one pass of their own.

Vectors are used as integers, ``x = floor(scale * c) + shift``. Sums are exact decimals; with base = floor(S / n) and
rest = S - n * base a centred entry is (x - base) - rest / n, and n * x - S = n * (x - base) - rest exactly.

Rows whose vector is null, empty, of another length than ``dimension`` (default: the most frequent length, the longer of
equally frequent ones), or holds null, non-finite entries or entries whose x is no long, are dropped. Repeated rows and
ties count each. Equal eigenvalues leave their eigenvectors open up to a rotation; any choice is returned. Components
whose eigenvalue is below ``rank_floor`` times the trace are no directions of the data and are left out, so a table with
one distinct vector, and an empty table, give no rows. Extra columns are not read, so their names can't clash. Long
vectors are whole: a task holds ``rows_per_block`` vectors at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import saved

EPS = float(np.finfo(np.float64).eps)
GROUPS = 8     # partial blocks are added in so many groups of tasks before the driver adds the rest
Apply = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """Exact sums of the fit list, and the components as columns of ``vectors`` with falling ``values``."""

    n: int
    sums: tuple[int, ...]
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    passes: int
    identity_error: float

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], dtype=np.int64)


def integer_vectors(rows: DataFrame, vector: str, scale: int = 64, shift: int = 1_000_000, dimension: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The usable rows with ``_x``, their vectors as longs."""
    limit = float(2**62 // scale)
    fine = F.forall(vector, lambda c: F.coalesce((F.abs(c.cast("double")) < limit) & ~F.isnan(c), F.lit(False)))
    usable = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + F.lit(shift).cast("bigint"))
    out = usable.select(*keep, x.alias("_x"))
    if dimension is None:
        sizes = out.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dimension = sizes["d"] if sizes else 0
    return out.filter(F.size("_x") == dimension)


def blocks(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the vector column as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            values = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part, values.reshape(part.num_rows, -1)


def added(partial: DataFrame) -> list[np.ndarray]:
    """The sums of all rows of ``partial`` (task int, block array<double>): in groups of tasks first, then here."""
    schema = "block array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].values.to_numpy()
                total = block.copy() if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["block"])

    grouped = partial.repartition(GROUPS, F.pmod("task", F.lit(GROUPS))).mapInArrow(add, schema)
    return [np.array(r["block"]) for r in grouped.collect()]


def summed(x: DataFrame, of: Callable[[np.ndarray], np.ndarray], rows_per_block: int) -> np.ndarray | None:
    """Sum of ``of(matrix of x)`` over all rows, one partial a task."""

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for _, m in blocks(batches, "_x", rows_per_block):
            got = of(m).ravel()
            total = got if total is None else total + got
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["task", "block"])

    parts = added(x.select("_x").mapInArrow(partials, "task int, block array<double>"))
    return np.sum(parts, axis=0) if parts else None


def minres(apply: Apply, rhs: np.ndarray, project: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Approximate solutions of P (A - shift) P t = rhs, one per column, all columns by the same passes."""
    t = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(rhs), np.where(live, rhs / np.where(live, beta, 1), 0)
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    c_old, s_old, c, s = (np.full(rhs.shape[1], f) for f in (1.0, 0.0, 1.0, 0.0))
    eta, first, beta_v = beta.copy(), beta.copy(), np.zeros(rhs.shape[1])
    for _ in range(steps):
        if not live.any():
            break
        p = project(apply(v) - v * shifts)
        alpha = np.sum(v * p, axis=0)
        p = p - v * alpha - v_old * beta_v
        beta_new = np.linalg.norm(p, axis=0)
        # rotations of the Lanczos matrix
        delta, epsilon = c * alpha - c_old * s * beta_v, s_old * beta_v
        gamma = s * alpha + c_old * c * beta_v
        rho = np.hypot(delta, beta_new)
        safe = np.where(rho > 0, rho, 1)
        c_new, s_new = np.where(rho > 0, delta / safe, 1.0), np.where(rho > 0, beta_new / safe, 0.0)
        w_new = (v - w_old * epsilon - w * gamma) / safe
        t = t + np.where(live & (rho > 0), c_new * eta, 0) * w_new
        eta = -s_new * eta
        live = live & (rho > 0) & (beta_new > EPS * np.abs(alpha)) & (np.abs(eta) > goal * first)
        v_old, v = v, np.where(live, p / np.where(beta_new > 0, beta_new, 1), 0)
        w_old, w, beta_v = w, w_new, beta_new
        c_old, s_old, c, s = c, s, c_new, s_new
    return project(t)


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of ``new`` outside ``basis``, orthonormal to it and to each other; what is left of none is dropped."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10]
    return new - basis @ (basis.T @ new)


def jacobi_davidson(apply: Apply, dim: int, count: int, inner: int = 6, spare: int = 8, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` leading eigenpairs of a symmetric positive operator: (values falling, vectors, residuals).

    ``apply`` multiplies a block of vectors. Pairs are locked in order of size when their residual falls to rounding
    level; the iteration ends when all are locked and a fresh product of all of them confirms it, and fails if rounding
    level isn't reached in ``rounds`` rounds.
    """
    count = min(count, dim)
    start = min(dim, count + spare)
    most = min(dim, max(3 * start, start + 2 * count))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, start)))[0]
    image = apply(basis)
    for _ in range(rounds):
        h = basis.T @ image
        values, s = np.linalg.eigh((h + h.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        ritz, ritz_image = basis @ s, image @ s
        wide = values[:count]
        level = 16 * EPS * max(abs(values[0]), np.finfo(np.float64).tiny) * np.sqrt(dim)
        residual = ritz_image[:, :count] - ritz[:, :count] * wide
        norms = np.linalg.norm(residual, axis=0)
        locked = norms <= level
        if locked.all():
            vectors = np.linalg.qr(ritz[:, :count])[0]
            vectors = vectors * np.sign(np.sum(vectors * ritz[:, :count], axis=0))
            fresh = apply(vectors)
            wide = np.sum(vectors * fresh, axis=0)
            norms = np.linalg.norm(fresh - vectors * wide, axis=0)
            if (norms <= 4 * level).all():
                order = np.argsort(-wide, kind="stable")
                return wide[order], vectors[:, order], norms[order]
            basis = np.linalg.qr(np.hstack([vectors, ritz[:, count:start]]))[0]
            image = apply(basis)
            continue
        open_ = np.flatnonzero(~locked)
        found = ritz[:, :count]      # locked vectors and the open ones themselves are projected out of the corrections

        def project(block: np.ndarray, found: np.ndarray = found) -> np.ndarray:
            return block - found @ (found.T @ block)

        # a pair that is still far off is corrected around its own value, like the others; the solve need not be exact
        t = minres(apply, -project(residual[:, open_]), project, wide[open_], inner, 0.1)
        if basis.shape[1] + len(open_) > most:       # restart with the best Ritz vectors and their images
            keep = min(start, basis.shape[1])
            basis, image = ritz[:, :keep], ritz_image[:, :keep]
        fresh = orthonormal(t, basis)
        if fresh.shape[1] == 0:      # nothing new: refresh images that carry the rounding of many rotations
            basis = np.linalg.qr(ritz[:, : min(start, ritz.shape[1])])[0]
            image = apply(basis)
            continue
        basis, image = np.hstack([basis, fresh]), np.hstack([image, apply(fresh)])
    raise RuntimeError(f"Jacobi-Davidson: {int((~locked).sum())} pairs above rounding level after {rounds} rounds")


def fit(x: DataFrame, components: int = 32, rows_per_block: int = 2048, rank_floor: float = 1e-13) -> Fit | None:
    """The components of all rows of ``x`` (``_x`` array<bigint>, one length); None without rows or without spread."""
    first = x.select(F.size("_x").alias("d")).first()
    if first is None:
        return None
    dim = first["d"]
    total = x.select(F.posexplode("_x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    rows = sorted(total.collect())
    n, sums = rows[0]["n"], tuple(int(r["s"]) for r in rows)
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64) / n
    passes = 0

    def apply(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(m: np.ndarray) -> np.ndarray:
            centred = (m - base) - rest
            return centred.T @ (centred @ block)

        return summed(x, product, rows_per_block).reshape(block.shape) / n

    trace = float(summed(x, lambda m: np.array([np.sum(((m - base) - rest) ** 2)]), rows_per_block)[0]) / n
    if trace <= 0:
        return None
    values, vectors, residuals = jacobi_davidson(apply, dim, components)
    real = values > rank_floor * trace
    values, vectors, residuals = values[real], vectors[:, real], residuals[real]

    scaled = vectors / np.sqrt(values)
    mean = summed(x, lambda m: np.sum(((m - base) - rest) @ scaled, axis=0), rows_per_block) / n

    def second(m: np.ndarray) -> np.ndarray:
        y = ((m - base) - rest) @ scaled - mean
        return y.T @ y

    covariance = summed(x, second, rows_per_block).reshape(len(values), len(values)) / n
    error = float(np.max(np.abs(covariance - np.eye(len(values))))) if len(values) else 0.0
    return Fit(n, sums, trace, vectors, values, residuals, passes, error)


def deviations(m: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> list[Decimal]:
    """Exact sums of (n * x - S)^2 per row: in 64 bits where the result surely fits, in Python's integers otherwise."""
    off = m - base
    bound = n * (int(np.abs(off).max(initial=0)) + 1)
    if bound * bound * m.shape[1] < 2**62:
        d = n * off - rest
        return [Decimal(int(v)) for v in np.sum(d * d, axis=1)]
    d = n * off.astype(object) - rest.astype(object)
    return [Decimal(int(v)) for v in np.sum(d * d, axis=1)]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32, dimension: int | None = None, rows_per_block: int = 2048) -> DataFrame:
    """A row per usable row and component: id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error."""
    id_type = rows.schema[id_col].dataType.simpleString()
    # one array of longs a row, written once: every pass reads it again
    x = saved(integer_vectors(rows.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")), "_v", dimension=dimension, keep=("_id",)))
    schema = f"_id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(x, components, rows_per_block)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    n, base, rest = model.n, model.base, model.rest
    k, explained, scaled, error = len(model.values), model.values / model.trace, model.vectors / np.sqrt(model.values), model.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in blocks(batches, "_x", rows_per_block):
            r = part.num_rows
            y = ((m - base) - rest / n) @ scaled
            each = pa.array(np.repeat(np.arange(r), k))
            deviation = pa.array(deviations(m, n, base, rest), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, n)), deviation.take(each),
                    pa.array(y.ravel()), pa.array(np.tile(explained, r)), pa.array(np.full(r * k, error)),
                ],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(project, schema).withColumnRenamed("_id", id_col)
