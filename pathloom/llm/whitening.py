"""Embedding whitening by an exact integer scatter.

Vectors become whole numbers, x = floor(scale * c). The fit list, each distinct x once, is written as a table. Each task takes
a shift (its first vector) off the x, puts a 1 before each and adds up products of 22-bit limbs: a block's product of two
limbs is exact in doubles, the blocks' sum exact in 64 bits, and what is carried out of them are integers of any size. So the
count, the sums and the cross-products of all tasks are exact, however the rows were dealt and however large they are, and
merge row by row of the matrix. The driver, which gets one matrix for each dimension, undoes nothing by subtraction of
rounded numbers: n * XtX - S * St is formed in integers, only then divided by n * n, rounded once, and decomposed by ``eigh``.

Rows are whitened from n * x - S, an exact integer too. A second pass over the fit list measures how far the covariance of the
whitened values (centred within each task, merged by their means) is from the identity.

Defined cases: rows whose vector is null or has a null or non-finite entry are dropped; entries beyond a long are taken as the
nearest long; vectors of another dimension are a fit list and a model of their own; a component whose eigenvalue is zero at
double precision (so all of them if n is 1, or the vectors are empty) has no value and is left out; equal eigenvalues keep
the order ``eigh`` gives; repeated rows and ids are each whitened and count once in the fit; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, materialize, temporary

LIMB, BLOCK = 22, 512  # BLOCK products of two limbs stay within 2**53
FLUSH = 500  # sums of so many blocks stay within 2**63
WIDE = 1 << 62


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    d = rows.select(rows[key].cast("long").alias("vec_id"), rows[vector].cast("array<double>").alias("v"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return d.where(F.col("v").isNotNull() & usable).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2**22 of its place, is y; the last has the sign."""
    out, most = [], int(max(y.max(), -1 - y.min())) if y.size else 0
    while most >> LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y, most = y >> LIMB, most >> LIMB
    return [*out, y.astype(np.float64)]


class Scatter:
    """Exact sums of the products of (1, x - shift), one matrix for count, sums and cross-products."""

    def __init__(self, shift: np.ndarray):
        self.shift, d = shift, len(shift) + 1
        self.total = np.zeros((d, d), object)
        self.pending: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK] - self.shift
            limbs = _limbs(np.concatenate([np.ones((len(part), 1), np.int64), part], axis=1))
            for i, a in enumerate(limbs):
                for j, b in enumerate(limbs):
                    made = (a.T @ b).astype(np.int64)
                    self.pending[i + j] = self.pending[i + j] + made if i + j in self.pending else made
            self.blocks += len(limbs)
            if self.blocks >= FLUSH:
                self.flush()

    def flush(self) -> None:
        for k, m in self.pending.items():
            self.total = self.total + m.astype(object) * (1 << (LIMB * k))
        self.pending, self.blocks = {}, 0

    def matrix(self) -> np.ndarray:
        """The sums of the products of (1, x)."""
        self.flush()
        g, s = self.total.copy(), self.shift.astype(object)
        n, sums = g[0, 0], g[0, 1:].copy()
        g[1:, 1:] += np.outer(s, sums) + np.outer(sums, s) + n * np.outer(s, s)
        g[0, 1:] += n * s
        g[1:, 0] = g[0, 1:]
        return g


def _by_dimension(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length in a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    return [(at := np.flatnonzero(lengths == d), flat[starts[at][:, None] + np.arange(d)].reshape(len(at), d).astype(np.int64)) for d in np.unique(lengths).tolist()]


def scatter(fit_list: DataFrame) -> dict[int, np.ndarray]:
    """The exact matrix of each dimension."""

    def run(batches):
        near: dict[int, Scatter] = {}
        far: dict[int, Scatter] = {}  # of entries so large that the shift might pass a long
        for b in batches:
            for _, x in _by_dimension(b.column(0)):
                d, wide = x.shape[1], bool(x.size) and max(int(x.max()), -int(x.min())) >= WIDE
                held = far if wide else near
                if d not in held:
                    held[d] = Scatter(np.zeros(d, np.int64) if wide else x[0].copy())
                held[d].add(x)
        for d, s in [*near.items(), *far.items()]:
            m = s.matrix()
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array([[str(v) for v in row[i:]] for i, row in enumerate(m)], pa.list_(pa.string()))], names=["dim", "i", "row"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # a row for each task
        total = [0] * len(rows["row"].iloc[0])
        for r in rows["row"]:
            total = [t + int(v) for t, v in zip(total, r, strict=True)]
        return pd.DataFrame({"dim": [key[0]], "i": [key[1]], "row": [[str(v) for v in total]]})

    shape = "dim int, i int, row array<string>"
    out: dict[int, np.ndarray] = {}
    for r in arrow(fit_list.select("x"), run, shape).groupBy("dim", "i").applyInPandas(merge, shape).collect():  # a matrix for each dimension
        m = out.setdefault(r.dim, np.zeros((r.dim + 1, r.dim + 1), object))
        for k, v in enumerate(r.row):
            m[r.i, r.i + k] = m[r.i + k, r.i] = int(v)
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # unit rows
    values: np.ndarray  # falling
    explained: np.ndarray
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact squared deviations, n * n times too large, and the whitened values."""
        top = max(int(x.max()), -int(x.min())) if x.size else 0
        fits = self.n * top + max(map(abs, self.sums), default=0) < WIDE
        z = (self.n * x - np.array(self.sums, np.int64)) if fits else self.n * x.astype(object) - np.array(self.sums, object)
        most = int(np.abs(z).max()) if z.size else 0
        squares = z if fits and most * most * x.shape[1] < WIDE else z.astype(object)
        deviation = [int(v) for v in (squares * squares).sum(axis=1)]
        centred = z / float(self.n) if fits else (z / self.n).astype(np.float64)
        return deviation, centred @ self.vectors.T / np.sqrt(self.values)


def decompose(matrix: np.ndarray, components: int) -> Whitening:
    n, sums = matrix[0, 0], matrix[0, 1:]
    m = n * matrix[1:, 1:] - np.outer(sums, sums)  # exact
    d = len(sums)
    v = np.array([[a / (n * n) for a in row] for row in m], np.float64).reshape(d, d)
    if not d:
        return Whitening(n, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    kept = min(components, int((values > values[0] * d * np.finfo(float).eps).sum()) if values[0] > 0 else 0)
    values, vectors = values[:kept], vectors[:kept]
    signs = np.sign(vectors[np.arange(kept), np.abs(vectors).argmax(axis=1)]) if kept else np.zeros(0)
    trace = sum(m[i, i] for i in range(d)) / (n * n)
    return Whitening(n, [int(s) for s in sums], vectors * signs[:, None], values.copy(), values / trace if trace else values)


def _identity_errors(fit_list: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    def run(batches):
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for _, x in _by_dimension(b.column(0)):
                w = models[x.shape[1]].apply(x)[1]
                mean = w.mean(axis=0)
                new = len(w), mean, (w - mean).T @ (w - mean)
                held[x.shape[1]] = _joined(held[x.shape[1]], new) if x.shape[1] in held else new
        for d, (n, mean, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([c.ravel().tolist()], pa.list_(pa.float64()))], names=["dim", "n", "mean", "c"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # a row for each task
        total = None
        for r in rows.sort_values("n").itertuples():
            mean = np.asarray(r.mean, np.float64)
            new = r.n, mean, np.asarray(r.c, np.float64).reshape(len(mean), len(mean))
            total = _joined(total, new) if total else new
        gap = np.abs(total[2] / total[0] - np.eye(len(total[1])))
        return pd.DataFrame({"dim": [key[0]], "error": [float(gap.max()) if gap.size else 0.0]})

    partial = arrow(fit_list.select("x"), run, "dim int, n long, mean array<double>, c array<double>")
    return {r.dim: r.error for r in partial.groupBy("dim").applyInPandas(merge, "dim int, error double").collect()}


def _joined(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def fit(x: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """x: of ``quantised``. The whitening of each dimension, with at most so many components."""
    with temporary(x.sparkSession):
        listed = materialize(x.select("x").distinct(), "whitening-fit")  # partial aggregation merges copies before the shuffle
        models = {d: decompose(m, components) for d, m in scatter(listed).items()}
        for d, e in _identity_errors(listed, models).items():
            models[d].identity_error = e
    return models


def whiten(x: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """Per row: vec_id, n, deviation (null beyond 38 digits), whitened and explained by component, identity_error."""

    def run(batches):
        for b in batches:
            for at, v in _by_dimension(b.column(1)):
                m = models[v.shape[1]]
                deviation, w = m.apply(v)
                same = lambda a, kind: pa.array([a] * len(at), kind)  # noqa: B023, E731
                columns = [b.column(0).take(pa.array(at)), same(m.n, pa.int64()), pa.array(map(str, deviation), pa.string()), pa.array(w.tolist(), pa.list_(pa.float64())), same(m.explained.tolist(), pa.list_(pa.float64())), same(m.identity_error, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    made = arrow(x.select("vec_id", "x"), run, "vec_id long, n long, deviation string, whitened array<double>, explained array<double>, identity_error double")
    return made.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def report(rows: DataFrame, components: int = 4) -> DataFrame:
    """One row for each vector and component; a deviation beyond a long is null."""
    x = quantised(rows)
    w = whiten(x, fit(x, components))
    each = w.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
