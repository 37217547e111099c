"""Whitening of embeddings through Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With the distinct vectors as rows of X, less their mean, each step multiplies X by a direction and Xᵀ by the outcome, and
orthogonalises both against all earlier ones. That leaves X = U B Vᵀ with a small upper bidiagonal B, whose singular value
decomposition gives the components and their deviations. One distributed pass makes one step. The long vectors u are never
stored: each is X p for a short p that the driver holds, so a lost executor costs a rescan of its rows and nothing else.
All steps are done, as many as there are dimensions: vectors of equal or nearly equal deviations would be missed by fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.vectors import matrix, one_length
from quarry.session import write_out

TINY = 1e-12  # of the rows' norm: a direction without length
SLACK = 1e-10  # of a direction's length: what may remain along earlier ones
REPEATS = 3


@dataclass(frozen=True)
class Whitener:
    """``n`` distinct vectors with sums ``sums`` per dimension; components as columns, their variances, and the whole variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _summed(rows: DataFrame, width: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``partial`` makes of a block of them: one short list per task meets in a grouped sum."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(matrix(batch.column(0), width).astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "part"])

    sums = rows.select("x").mapInArrow(tasks, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()  # a few numbers per dimension
    return np.array([r["part"] for r in sorted(sums, key=lambda r: r["at"])])


def bidiagonalise(rows: DataFrame, mean: np.ndarray, norm: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns v (dimensions × steps) and the bidiagonal matrix B with Xᵀ X = V Bᵀ B Vᵀ, X the rows less ``mean``.

    Where a direction leads nowhere new (X has too low a rank, or the directions so far keep among themselves), B gets a zero
    and the next direction starts at random, orthogonal to all others.
    """
    width = len(mean)
    random = np.random.default_rng(7)
    v_all, b = np.zeros((width, steps)), np.zeros((steps, steps))
    p_all, z_all = np.zeros((width, 0)), np.zeros((width, 0))  # u = X p and Xᵀ u of the u so far
    owner: list[int] = []  # the step of each u

    def fresh(upto: int) -> np.ndarray:
        v = random.standard_normal(width)
        for _ in range(2):
            v -= v_all[:, :upto] @ (v_all[:, :upto].T @ v)
        return v / np.linalg.norm(v)

    v = fresh(0)
    for step in range(steps):
        v_all[:, step] = v
        p = v - p_all @ (z_all.T @ v)  # z·v is u·(X v), so this takes all earlier u off X v
        for _ in range(REPEATS):
            here, earlier = p, p_all

            def products(x: np.ndarray) -> np.ndarray:
                x = x - mean
                u = x @ here
                return np.concatenate([[u @ u], (x @ earlier).T @ u, x.T @ u])

            found = _summed(rows, width, products)
            length, along, back = np.sqrt(found[0]), found[1:1 + len(owner)], found[1 + len(owner):]
            if length <= TINY * norm or not len(along) or np.abs(along).max() <= SLACK * length:
                break
            p = p - p_all @ along
        if length <= TINY * norm:
            v = fresh(step + 1) if step + 1 < steps else v
            continue
        b[step, step] = length
        owner.append(step)
        p_all, z_all = np.column_stack([p_all, p / length]), np.column_stack([z_all, back / length])
        if step + 1 == steps:
            break
        v = back / length - length * v
        for _ in range(2):
            v = v - v_all[:, :step + 1] @ (v_all[:, :step + 1].T @ v)
        beta = np.linalg.norm(v)
        if beta <= TINY * norm:
            v = fresh(step + 1)
        else:
            b[step, step + 1] = beta
            v = v / beta
    return v_all, b


def fit(vectors: DataFrame, components: int = 4) -> Whitener | None:
    """The whitener of the distinct vectors among ``x``; None without a vector.

    ``components`` is the most that are kept; directions without variance (below 1e-12 of the rows' norm) are never among them.
    """
    fitted = write_out(vectors.select("x").distinct())
    width = one_length(fitted)
    if not width:
        return None
    n = fitted.count()
    whole = F.col("entry").cast("decimal(38,0)")
    moments = (fitted.select(F.posexplode("x").alias("at", "entry")).groupBy("at")
               .agg(F.sum(whole).alias("s"), F.sum(whole * whole).alias("q")).collect())  # a row per dimension
    moments = sorted(moments, key=lambda r: r["at"])
    sums = [int(r["s"]) for r in moments]
    total = sum(n * int(r["q"]) - int(r["s"]) ** 2 for r in moments) / n ** 2
    mean = np.array([s / n for s in sums])
    if total == 0:
        return Whitener(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)
    norm = float(np.sqrt(total * n))
    v, b = bidiagonalise(fitted, mean, norm, width)
    _, sigma, right = np.linalg.svd(b)
    kept = [i for i in range(min(components, width)) if sigma[i] > TINY * norm]
    found = v @ right[kept].T
    found = found / np.linalg.norm(found, axis=0)
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0)
    variances = sigma[kept] ** 2 / n
    shape = found / np.sqrt(variances)

    def second(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ shape
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    sums_y = _summed(fitted, width, second) / n
    first, cross = sums_y[:len(kept)], sums_y[len(kept):].reshape(len(kept), len(kept))
    error = float(np.abs(cross - np.outer(first, first) - np.eye(len(kept))).max())
    return Whitener(n, sums, found, variances, total, error)


def whiten(vectors: DataFrame, made: Whitener | None) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum over dimensions of (n·x − sum)², null beyond the range of a long. Repeated rows and null
    keys are kept as they are. Without any variance (one distinct vector, or none) there are no components and no rows.
    """
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if made is None or not made.components.shape[1]:
        return vectors.sparkSession.createDataFrame([], shape)
    width, count = made.components.shape
    mean, scaled = made.mean, made.components / np.sqrt(made.variances)
    n, sums, shares, error = made.n, made.sums, made.variances / made.total, made.identity_error

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), width)
            far = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums))
            kind = np.int64 if far * far * width < 1 << 63 else object
            off = x.astype(kind) * n - np.array(sums, dtype=kind)
            deviation = [d if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]
            y = (x.astype(np.float64) - mean) @ scaled
            each = np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(each), n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(each)),
                pa.array(y.ravel()), pa.array(np.tile(shares, batch.num_rows)), pa.array(np.full(len(each), error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(rows, shape)
