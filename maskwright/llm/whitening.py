"""Embedding whitening: components of the covariance by cyclic Jacobi rotations, and every vector's whitened coordinates.

Entries are brought to whole numbers, x = floor(scale * c) + shift, so that sums are exact. Three passes over the vectors, each with
one small partial a task that is summed in a second round of tasks: counts and sums; the centred scatter, of which the driver holds one
matrix a length; and the scatter of the whitened coordinates themselves, which gives ``identity_error`` as it came out, not as
it should be. The driver applies Jacobi rotations (disjoint pairs at once, every pair once a sweep) until no off-diagonal entry is
over rounding *relative to its two diagonal entries*, which keeps small eigenvalues accurate; models are broadcast.

x is centred twice: by the whole number next to its mean, exactly, then by the rest of the mean, which is at most a half.

Vectors are fitted with the others of their length. What is gathered and broadcast has ``MOST_BYTES`` at most over all lengths, else
that is an error: lengths are few in a table of embeddings.

Defined results: vectors that are null or hold a null or non-finite entry are left out, as are vectors of no entries, which have no
component; repeated rows count each; a null id stays; floats, doubles and integers are taken as doubles, and 64 times an entry is cut to
2 ** 53 either way; components whose eigenvalue is nothing but rounding (equal vectors, fewer vectors than entries) have a null
``whitened`` and count for no ``identity_error``, which is null where no other is left; ``explained`` is null where nothing varies;
``deviation`` is null where it doesn't fit a long; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 256 << 20
EPS = float(np.finfo(np.float64).eps)
LOW = 26  # sums of whole numbers are kept as sums of their low bits and of the rest


@dataclasses.dataclass
class Model:
    """Of one length: n vectors with sums S = n * middle + rest; components are rows, by falling eigenvalue."""

    n: int
    middle: np.ndarray
    rest: list[int]
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    total: float = 0.0
    mean: np.ndarray | None = None  # of the whitened coordinates
    error: float | None = None

    @property
    def delta(self) -> np.ndarray:
        return np.array([r / self.n for r in self.rest])

    @property
    def good(self) -> np.ndarray:
        return self.values > self.total * len(self.middle) * EPS

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle).astype(np.float64) - self.delta

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates on all components; those of rounding alone are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.good, 1 / np.sqrt(self.values), np.nan)
        return self.centred(x) @ self.components.T * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - S) ** 2) of each row, exactly; None where a long can't hold it."""
        z = x - self.middle
        most = self.n * int(np.abs(z).max(initial=0)) + max((abs(r) for r in self.rest), default=0)
        if z.shape[1] * most * most < 1 << 63:
            return np.square(self.n * z - np.array(self.rest, np.int64)).sum(1).tolist()
        found = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in z.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def whole(rows: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.clip(np.floor(scale * rows), -(2.0**53), 2.0**53).astype(np.int64) + shift


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as rows) of a symmetric matrix."""
    d = len(matrix)
    size = d + d % 2  # pairs are dealt as in a tournament, with a bye where d is odd
    a, v = np.zeros((size, size)), np.eye(size)
    a[:d, :d] = (matrix + matrix.T) / 2
    # Scaled by a power of two, so that neither products of entries nor their roots leave the range.
    unit = 2.0 ** math.frexp(float(np.abs(a).max()) or 1.0)[1] if d else 1.0
    a /= unit
    order = np.arange(size)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(size - 1, 1)):
            p, q = order[: size // 2], order[::-1][: size // 2]
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            on = np.abs(apq) > np.maximum(EPS * np.sqrt(np.abs(app * aqq)), 1e-290)
            if on.any():
                turned = True
                p, q, app, aqq, apq = p[on], q[on], app[on], aqq[on], apq[on]
                tau = (aqq - app) / (2 * apq)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                rp, rq = a[p], a[q]
                a[p], a[q] = c[:, None] * rp - s[:, None] * rq, s[:, None] * rp + c[:, None] * rq
                cp, cq = a[:, p], a[:, q]
                a[:, p], a[:, q] = c * cp - s * cq, s * cp + c * cq
                a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            order[1:] = np.roll(order[1:], 1)
        if not turned:
            break
    else:
        # A matrix that lacks rank keeps rounding beside its empty diagonal entries; nothing else may be left.
        if np.abs(a - np.diag(np.diag(a))).max() > size * EPS * np.abs(np.diag(a)).sum():
            raise RuntimeError(f"rotations did not settle within {sweeps} sweeps")
    values, vectors = np.diag(a)[:d] * unit, v[:d, :d].T
    ranked = np.argsort(-values, kind="stable")
    vectors = vectors[ranked]
    sign = np.sign(vectors[np.arange(d), np.abs(vectors).argmax(1)]) if d else np.zeros(0)
    return values[ranked], vectors * sign[:, None]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _by_length(column: pa.Array, most: int = 2048):
    """(rows, matrix) of each length in a batch, few rows at a time."""
    for lo in range(0, len(column), most):
        part = column.slice(lo, most)
        sizes = np.diff(np.asarray(part.offsets))
        flat, at = np.asarray(part.flatten()), np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            yield lo + rows, flat[at[rows][:, None] + np.arange(dim)]


def _summed(rows: DataFrame, of: type, add) -> dict[int, list[np.ndarray]]:
    """{length: arrays}, each summed over all vectors: ``add(matrix)`` gives a matrix's arrays of type ``of``.

    One partial a task and length; a second round of tasks adds the partials up, so the driver gets about the square root of their number.
    """
    code = np.dtype(of).str

    def partials(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, matrix in _by_length(batch.column(0)):
                new, had = add(matrix), held.get(matrix.shape[1])
                held[matrix.shape[1]] = new if had is None else [a + b for a, b in zip(had, new)]
        yield from written(held)

    def merged(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dim, parts in read(batch):
                had = held.get(dim)
                held[dim] = parts if had is None else [a + b for a, b in zip(had, parts)]
        yield from written(held)

    def written(held):
        part = TaskContext.get().partitionId()
        for dim, parts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([part]), pa.array([[np.ascontiguousarray(p, of).tobytes() for p in parts]], pa.list_(pa.binary()))], names=["dim", "part", "sums"])

    def read(batch):
        for dim, parts in zip(batch.column("dim").to_pylist(), batch.column("sums").to_pylist()):
            yield dim, [np.frombuffer(p, code) for p in parts]

    schema = "dim long, part long, sums array<binary>"
    one = rows.select("v").mapInArrow(partials, schema)
    wide = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    table = one.repartition(wide, "part").mapInArrow(merged, schema).toArrow()
    out: dict[int, list[np.ndarray]] = {}
    for batch in table.to_batches():
        for dim, parts in read(batch):
            had = out.get(dim)
            out[dim] = parts if had is None else [a + b for a, b in zip(had, parts)]
    return out


def fit(rows: DataFrame, components: int | None = 32, scale: float = 64.0, shift: int = 1_000_000) -> dict[int, Model]:
    """A model for each length in ``rows`` (vec_id, v: usable vectors). ``components`` None keeps all."""
    cast = lambda m: whole(m, scale, shift)

    def first(matrix):
        x = cast(matrix)
        return [np.array([len(x)]), (x >> LOW).sum(0), (x & ((1 << LOW) - 1)).sum(0)]

    models = {}
    for dim, (n, high, low) in _summed(rows, np.int64, first).items():
        n, sums = int(n[0]), [(int(h) << LOW) + int(r) for h, r in zip(high, low)]
        middle = [(2 * s + n) // (2 * n) for s in sums]
        models[dim] = Model(n, np.array(middle, np.int64), [s - n * m for s, m in zip(sums, middle)])
    if sum(8 * d * d for d in models) > MOST_BYTES:
        raise ValueError(f"{len(models)} lengths of vectors up to {max(models)}: their matrices take over {MOST_BYTES} bytes")
    if not models:
        return models
    context = rows.sparkSession.sparkContext
    centre = context.broadcast(models)

    def scatter(matrix):
        c = centre.value[matrix.shape[1]].centred(cast(matrix))
        return [c.sum(0), (c.T @ c).ravel()]

    for dim, (rest, square) in _summed(rows, np.float64, scatter).items():
        model = models[dim]
        values, vectors = jacobi(square.reshape(dim, dim) / model.n)
        model.total = float(np.trace(square.reshape(dim, dim))) / model.n
        model.values, model.components = np.maximum(values, 0.0)[:components], vectors[:components]
        with np.errstate(divide="ignore", invalid="ignore"):
            model.mean = np.where(model.good, model.components @ rest / model.n / np.sqrt(model.values), 0.0)
    ready = context.broadcast(models)

    def whitened(matrix):
        model = ready.value[matrix.shape[1]]
        w = np.where(model.good, model.whitened(cast(matrix)), 0.0) - model.mean
        return [(w.T @ w).ravel()]

    for dim, (square,) in _summed(rows, np.float64, whitened).items():
        model, k = models[dim], len(models[dim].values)
        got = (square.reshape(k, k) / model.n)[np.ix_(model.good, model.good)]
        model.error = float(np.abs(got - np.eye(len(got))).max()) if len(got) else None
    return models


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int | None = 32, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """vec_id, n, deviation, whitened, explained (arrays by component) and identity_error of every usable vector."""
    rows = usable(vectors, id_col, vector_col)
    models = rows.sparkSession.sparkContext.broadcast(fit(rows, components, scale, shift))
    numbers = T.StructType.fromDDL("n long, deviation long, whitened array<double>, explained array<double>, identity_error double")

    def over(batches):
        for batch in batches:
            for at, matrix in _by_length(batch.column(1)):
                model, x = models.value[matrix.shape[1]], whole(matrix, scale, shift)
                found = model.whitened(x)
                k, m = found.shape[1], len(found)
                ends = pa.array(np.arange(m + 1, dtype=np.int32) * k)
                flat = lambda values, ends=ends: pa.ListArray.from_arrays(ends, pa.array(values.ravel(), from_pandas=True))
                share = model.values / model.total if model.total > 0 else np.full(k, np.nan)
                new = [pa.array([model.n] * m, pa.int64()), pa.array(model.deviation(x), pa.int64()), flat(found), flat(np.tile(share, (m, 1))), pa.array([model.error] * m, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *new], names=["vec_id", *numbers.names])

    return rows.mapInArrow(over, T.StructType([rows.schema["vec_id"], *numbers]))
