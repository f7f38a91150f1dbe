"""Operator 11: principal components of embeddings by matrix-free block subspace iteration, and whitening.

No covariance matrix is formed. One Spark pass over the rows gives V Q = X'(X Q) / n for a block Q of orthonormal columns,
X being the centred rows; each task returns a partial product of d rows, which Spark adds up. The driver then does what
has the block's size: Rayleigh-Ritz on Q'(V Q), the residual of every Ritz pair, and QR for the next block. The iteration
ends when the residuals of all k components are at rounding. Where the spectrum is flat, so that the measured contraction
would need many more passes, the block grows (at most to d columns, when one pass ends it).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import SEED
from framegrain.llm.vectors import matrix, whole_vectors

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Columns of the first block beyond the components asked for.
MORE_COLUMNS = 8
#: A Ritz pair is certified when its residual is below this share of the largest eigenvalue.
CERTAIN = 1e-13
#: Passes that the block may still need by its contraction; beyond these it doubles.
PATIENCE = 6
#: Directions with less than this share of the largest eigenvalue have no variance but rounding.
RANK = 1e-12


@dataclass(frozen=True)
class Components:
    """Unit eigenvectors (columns) of the covariance by falling eigenvalue, with what certifies them."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: tuple[int, ...]  # columns of each pass


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n from the exact whole number n x - S."""
    return (n * x - sums).astype(np.float64) / n


def totals(x: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    def task(batches):
        import pyarrow as pa

        n, s = 0, np.zeros(d, np.int64)
        for b in batches:
            n += b.num_rows
            s += matrix(b.column(0), d).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.append([n], s))], ["i", "v"])

    got = {r["i"]: r["v"] for r in x.select("x").mapInArrow(task, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def product(x: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V: one pass. The driver receives d times the columns of q, however many rows there are."""
    d, p = q.shape
    held = x.sparkSession.sparkContext.broadcast((np.array(sums, np.int64), q))  # d and d x p numbers

    def task(batches):
        import pyarrow as pa

        s, block = held.value
        out, squares, seen = np.zeros((d, p)), 0.0, False
        for b in batches:
            c = _centred(matrix(b.column(0), d), n, s)
            out += c.T @ (c @ block)
            squares += float(np.einsum("ij,ij->", c, c))
            seen |= b.num_rows > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * p + 1)), pa.array(np.append(out.ravel(), squares))], ["i", "v"])

    total = np.zeros(d * p + 1)
    for r in x.select("x").mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        total[r["i"]] = r["v"]
    held.unpersist()
    return total[:-1].reshape(d, p) / n, float(total[-1]) / n


def principal_components(x: DataFrame, d: int, k: int = COMPONENTS, seed: int = SEED) -> Components:
    """The k leading components of the column x (fewer if d is smaller); x is read once for each pass, so it should be stored."""
    n, sums = totals(x, d)
    k = min(k, d)
    if not n or not k:
        return Components(n, tuple(sums), np.zeros(0), np.zeros((d, 0)), 0.0, np.zeros(0), ())
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + MORE_COLUMNS))))[0]
    before, passes = math.inf, []
    while True:
        z, trace = product(x, n, sums, q)
        passes.append(q.shape[1])
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, z @ turn
        residuals = np.linalg.norm(image - ritz * values, axis=0)[:k]
        worst, wanted = float(residuals.max()), CERTAIN * math.sqrt(d) * max(float(values[0]), 0.0)
        if worst <= wanted or q.shape[1] == d:
            break
        q = np.linalg.qr(image)[0]
        # What is left in orders of magnitude against what the last pass gained.
        gained = math.log(before / worst) if math.isfinite(before) else math.inf
        if gained <= 0 or math.log(worst / wanted) > PATIENCE * gained:
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1]))]))[0]
            worst = math.inf
        before = worst
    return Components(n, tuple(sums), values[:k].copy(), ritz[:, :k].copy(), trace, residuals, tuple(passes))


def _whitened(c: np.ndarray, fit: Components, keep: int) -> np.ndarray:
    return (c @ fit.vectors[:, :keep]) / np.sqrt(fit.values[:keep])


def identity_error(x: DataFrame, fit: Components, d: int, keep: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from one more pass."""
    if not keep:
        return 0.0
    held = x.sparkSession.sparkContext.broadcast(fit)

    def task(batches):
        import pyarrow as pa

        model = held.value
        second, first, seen = np.zeros((keep, keep)), np.zeros(keep), False
        for b in batches:
            w = _whitened(_centred(matrix(b.column(0), d), model.n, np.array(model.sums, np.int64)), model, keep)
            second += w.T @ w
            first += w.sum(axis=0)
            seen |= b.num_rows > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(keep * (keep + 1))), pa.array(np.append(second.ravel(), first))], ["i", "v"])

    total = np.zeros(keep * (keep + 1))
    for r in x.select("x").mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        total[r["i"]] = r["v"]
    mean = total[keep * keep :] / fit.n
    return float(np.abs(total[: keep * keep].reshape(keep, keep) / fit.n - np.outer(mean, mean) - np.eye(keep)).max())


def whiten(df: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """One row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, shorter than the longest, or holds a null, NaN or infinite entry are left out of the fit and of
    the result. A null id stays null; repeated rows each count and each come back. Components without variance (constant
    rows, fewer rows than dimensions, a single row) have no whitened value and no rows; an empty input gives an empty result.
    deviation is exact and null where it exceeds a long. Other columns are ignored. Equal eigenvalues leave their components
    free within the space they span. df is read once for each pass.
    """
    x, d = whole_vectors(df, scale, shift, id_col, vec_col)
    fit = principal_components(x, d, k, seed)
    keep = int((fit.values > RANK * max(1e-300, float(fit.values[0]))).sum()) if len(fit.values) else 0
    error = identity_error(x, fit, d, keep)
    held = x.sparkSession.sparkContext.broadcast(fit)

    def task(batches):
        import pyarrow as pa

        model = held.value
        sums = np.array(model.sums, np.int64)
        share = model.values[:keep] / (model.trace or 1.0)
        for b in batches:
            rows = max(1, 65_536 // max(1, keep))
            for part in (b.slice(at, rows) for at in range(0, b.num_rows, rows)):
                off = model.n * matrix(part.column(1), d) - sums
                c = off.astype(np.float64) / model.n
                top = int(np.abs(off).max(initial=0))
                exact = (off * off).sum(axis=1).tolist() if top * top * d < 1 << 63 else [sum(v * v for v in r) for r in off.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), keep))),
                        pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * keep, model.n)),
                        deviation.take(pa.array(np.repeat(np.arange(m), keep))),
                        pa.array(_whitened(c, model, keep).ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * keep, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.select("vec_id", "x").mapInArrow(task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
