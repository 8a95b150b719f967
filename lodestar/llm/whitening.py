"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. Each pass over the vectors multiplies it with a block of directions, XᵀXQ of the centred vectors: a
task sums its own part, and Spark adds the parts row by row. A Chebyshev polynomial of the covariance, by its three-term
recurrence, damps the part of the spectrum that isn't wanted; QR makes the block orthogonal again, and Rayleigh-Ritz turns it into
eigenvectors. That goes on until the residuals certify each wanted vector, and a block of probes outside finds nothing larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import list_array, small_batches, stored

#: An entry c becomes floor(SCALE * c) + SHIFT; beyond LARGEST it stays there.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 62
#: Components, directions of the block beyond them, probes, steps that bound the spectrum.
COMPONENTS, GUARD, PROBES, STEPS = 32, 16, 8, 12
#: A vector is certified if its residual is at most ANGLE of the gap to its neighbours, or at most ROUNDING units of rounding.
ANGLE, ROUNDING = 1e-12, 16
#: The filter's degree at most, its amplification at most in early rounds, and rounds.
DEGREE, AMPLIFY, ROUNDS = 12, 1e6, 60
SEED = 13


class Centred:
    """Stored integer vectors with their exact mean, and sums over all of them by Spark."""

    def __init__(self, table: DataFrame, dim: int):
        self.table, self.dim = table, dim
        rows = self._by_task(_limbs(dim), "dim int, n long, hi decimal(38,0), lo decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()
        total = {r["dim"]: (int(r["hi"]) << 32) + int(r["lo"]) for r in rows}
        self.n = int(rows[0]["n"]) if rows else 0
        self.whole = np.array([total[k] // self.n for k in range(dim)], np.int64) if self.n else np.zeros(dim, np.int64)
        self.part = np.array([total[k] % self.n for k in range(dim)], np.int64) if self.n else np.zeros(dim, np.int64)

    def _by_task(self, run: Callable, schema: str) -> DataFrame:
        return self.table.select("x").mapInArrow(run, schema)

    def sums(self, each: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum over all vectors of ``each(centred vectors)``, a matrix of ``width`` columns; a task sends one."""
        centre = self.centre()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch):
                    own = each(centre(integers(batch.column(0))))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), list_array(list(total), pa.float64())], names=["row", "v"])

        added = self._by_task(run, "row int, v array<double>").groupBy("row").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(width))).alias("v"))
        return np.array([r["v"] for r in sorted(added.collect(), key=lambda r: r["row"])])

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, rest = self.whole, self.part / max(1, self.n)
        return lambda x: (x - whole).astype(np.float64) - rest

    def product(self, q: np.ndarray) -> np.ndarray:
        """Covariance times ``q``: one pass."""
        return self.sums(lambda c: c.T @ (c @ q), q.shape[1]) / self.n

    def trace(self) -> float:
        return float(self.sums(lambda c: np.einsum("ij,ij->j", c, c)[None], self.dim).sum()) / self.n

    def identity_error(self, w: np.ndarray) -> float:
        """The largest absolute entry of the covariance of the vectors on ``w``, less the identity."""
        k = w.shape[1]
        mean = self.sums(lambda c: (c @ w).sum(axis=0)[None], k)[0] / self.n

        def square(c: np.ndarray) -> np.ndarray:
            own = c @ w - mean
            return own.T @ own

        return float(np.abs(self.sums(square, k) / self.n - np.eye(k)).max())


def integers(column: pa.Array) -> np.ndarray:
    """Rows of equal lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _limbs(dim: int) -> Callable:
    """Exact sums of a task's integers, as upper and lower halves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hi, lo = 0, [0] * dim, [0] * dim
        for batch in batches:
            if len(batch):
                x = integers(batch.column(0))
                n += len(x)
                hi = [a + b for a, b in zip(hi, (x >> 32).sum(axis=0).tolist(), strict=True)]
                lo = [a + b for a, b in zip(lo, (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(hi).cast(kind), pa.array(lo).cast(kind)], names=["dim", "n", "hi", "lo"])

    return run


def spectrum(product: Callable[[np.ndarray], np.ndarray], dim: int, steps: int = STEPS) -> tuple[float, float]:
    """(a lower, an upper bound) of the eigenvalues by a Lanczos run: its extreme Ritz values less or plus their residuals."""
    q = np.random.default_rng(SEED).normal(size=(dim, 1))
    basis, diagonal, beside = q / np.linalg.norm(q), [], []
    for _ in range(min(steps, dim)):
        r = product(basis[:, -1:])
        diagonal.append(float(basis[:, -1] @ r[:, 0]))
        for _ in range(2):
            r = r - basis @ (basis.T @ r)
        beside.append(float(np.linalg.norm(r)))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        basis = np.hstack([basis, r / beside[-1]])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1))
    rest = beside[-1] * np.abs(vectors[-1])
    return max(0.0, float(values[0] - rest[0])), float(values[-1] + rest[-1])


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of that degree that is small on low..cut, scaled to one at ``top``, applied to ``q``; ``vq`` is its product."""
    middle, half = (cut + low) / 2, (cut - low) / 2
    first = half / (top - middle)
    sigma, before, now = first, q, (vq - middle * q) * (first / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, now = now, (product(now) - middle * now) * (2 * new / half) - sigma * new * before
        sigma = new
    return now


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the ``wanted`` largest eigenvalues of a positive semidefinite matrix known by its
    products. A block that spans all dimensions needs one Rayleigh-Ritz step."""
    k = min(dim, wanted + guard)
    wanted = min(wanted, k)
    random = np.random.default_rng(SEED + 1)
    low, _ = spectrum(product, dim) if k < dim else (0.0, 0.0)
    q = np.linalg.qr(random.normal(size=(dim, k)))[0]
    best, idle = np.inf, 0
    for _ in range(ROUNDS):
        vq = product(q)
        h = q.T @ vq
        values, s = np.linalg.eigh((h + h.T) / 2)
        values, q, vq = values[::-1], q @ s[:, ::-1], vq @ s[:, ::-1]
        if k == dim or values[0] <= 0:
            return values[:wanted], q[:, :wanted]
        residual = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        apart = np.abs(np.diff(values))
        gap = np.minimum(np.append(np.inf, apart[: wanted - 1]), apart[:wanted])
        floor = ROUNDING * np.finfo(float).eps * values[0] * np.sqrt(dim)
        worst = float((residual / np.maximum(ANGLE * gap, floor)).max())
        idle = 0 if worst < best / 2 else idle + 1
        best = min(best, worst)
        cut = float(values[-1])
        bottom = low if low < 0.999 * cut else 0.5 * cut
        steep = np.arccosh(max(1 + 1e-9, (values[0] - (cut + bottom) / 2) / ((cut - bottom) / 2))) if cut > bottom else np.inf
        degree = int(np.clip(np.log(2 * AMPLIFY) / steep if steep > 0 else DEGREE, 2, DEGREE))
        if worst <= 1 or idle >= 4:
            outside = random.normal(size=(dim, min(PROBES, dim - k)))
            for _ in range(2):
                outside = np.linalg.qr(outside - q @ (q.T @ outside))[0]
            if cut > floor and outside.shape[1] < dim - k:
                outside = filtered(product, outside, product(outside), bottom, cut, float(values[0]), degree)
                for _ in range(2):
                    outside = np.linalg.qr(outside - q @ (q.T @ outside))[0]
            found, s = np.linalg.eigh(outside.T @ product(outside))
            if found[-1] <= values[wanted - 1] + floor:
                return values[:wanted], q[:, :wanted]
            q, best, idle = np.linalg.qr(np.hstack([q[:, : k - outside.shape[1]], outside @ s]))[0], np.inf, 0
            continue
        q = np.linalg.qr(filtered(product, q, vq, bottom, cut, float(values[0]), degree) if cut > floor else vq)[0]  # without a spectrum to damp one product does
    raise ArithmeticError(f"no certified eigenvectors after {ROUNDS} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another length than most have (of
    equally frequent lengths the longest counts; empty vectors have no component). All others are fitted: repeated rows, and rows of
    equal or null ids, each count and have rows of their own. Components without variance can't be scaled and are left out, so a
    table of one vector, or of equal ones, gives no rows, as an empty one does. ``deviation`` is exact, or null where it isn't a long.
    Entries whose product with 64 is beyond 2^62 count as that. Other columns are left out, whatever their names.
    The driver holds matrices of the vectors' length times the block, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    usable = base.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))) + SHIFT)
    table = stored(usable.select("id", whole.alias("x"), F.size("v").alias("dim")), "whitening")
    most = table.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    kind = table.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None or most["dim"] == 0:
        return spark.createDataFrame([], schema)
    dim = most["dim"]
    data = Centred(table.where(F.col("dim") == dim), dim)
    values, q = eigenpairs(data.product, dim, components)
    trace = data.trace()
    some = values > 64 * np.finfo(float).eps * max(values[0], 0.0) * dim
    values, q = values[some], q[:, some]
    if not len(values) or trace <= 0:
        return spark.createDataFrame([], schema)
    w = q / np.sqrt(values)
    error, explained, k = data.identity_error(w), values / trace, len(values)
    n, start, part, centre = data.n, data.whole, data.part, data.centre()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = integers(batch.column(1))
            c = centre(x)
            length = n * n * np.einsum("ij,ij->i", c, c)
            fits = (length < 9.2e18) & (np.abs(c).max(axis=1) * n < 9.2e18)
            own = n * np.where(fits[:, None], x - start, 0) - part
            exact = pa.array(np.einsum("ij,ij->i", own * fits[:, None], own), mask=~fits)
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), exact.take(rows), pa.array((c @ w).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return data.table.select("id", "x").mapInArrow(run, schema)
