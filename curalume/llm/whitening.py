"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation over distributed rows.

With X the centred rows, a step takes u = X v, orthogonal to all u before, and then X'u, orthogonal to all v before.
The vectors v are as wide as a row and stay with the driver. A vector u is as long as the table and is never
stored: u = X w for a w that the driver knows, so a row's entries of u follow from the row itself. One pass over the
table makes both products, X w and X'(X w), and each task adds up one vector. After each step the products with
the vectors before are removed once more, as rounding brings them back (full reorthogonalisation).
The singular values and right vectors of the small bidiagonal matrix are those of X.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalume.plans.tables import Scratch

_LARGE = 1 << 52
#: Singular values under this share of the root of all squares are rounding.
_TINY = 1e-12


class Whitening(NamedTuple):
    """A fitted whitening of integer vectors."""

    n: int  #: distinct vectors that it is fitted on
    sums: tuple[int, ...]  #: their sums by dimension
    components: np.ndarray  #: (components, dimensions), unit rows, by falling variance
    variances: np.ndarray
    trace: float  #: of the covariance
    identity_error: float = math.nan  #: largest absolute entry of the whitened fit list's covariance minus the identity
    steps: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows minus the mean; whole parts are taken off as integers, so a far mean costs no digits."""
        whole = np.array([s // self.n for s in self.sums], object)
        rest = np.array([s % self.n / self.n for s in self.sums])
        if _largest(x) < _LARGE and all(abs(q) < _LARGE for q in whole):
            return (x - whole.astype(np.int64)) - rest
        return (x.astype(object) - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sum)^2 for each row, exactly; None where that is beyond 64 bits."""
        most = self.n * _largest(x) + max(map(abs, self.sums))
        if most * most * len(self.sums) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        wide = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in wide]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor empty and has finite entries only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def integers(vector: str, scale: float = 256.0) -> Column:
    """floor(scale * entry) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], width: int, total: float, want: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading singular values and right vectors (rows) of X, and the steps made.

    product(w) gives |Xw|^2 and X'(Xw); `total` is the sum of all squares of X. Steps go on to the full width, or until
    the first `want` triplets have settled and what the squares found so far leave of `total` has no room for another
    one as large: so that of equal singular values, of which a Krylov space has one vector only, none is missed.
    A breakdown starts anew with a direction that has not been met.
    """
    generator, floor = np.random.default_rng(seed), _TINY * math.sqrt(total)
    v_all, w_all, z_all = (np.zeros((width, 0)) for _ in range(3))
    diagonal: list[float] = []
    above: list[float] = []

    def orthogonal(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - v_all @ (v_all.T @ r)
        return r

    def direction() -> np.ndarray:
        r = orthogonal(generator.standard_normal(width))
        return r / np.linalg.norm(r)

    v = direction()
    while True:
        w = v - w_all @ (z_all.T @ v)
        squares, z = product(w)
        again = w_all.T @ z
        w, z, alpha = w - w_all @ again, z - z_all @ again, math.sqrt(max(0.0, squares - again @ again))
        if alpha <= floor:
            alpha, w, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, z = w / alpha, z / alpha
        diagonal.append(alpha)
        v_all, w_all, z_all = np.c_[v_all, v], np.c_[w_all, w], np.c_[z_all, z]
        r = orthogonal(z - alpha * v)
        beta = float(np.linalg.norm(r))
        left, s, right = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
        k = len(diagonal)
        if k < width and k >= want:
            settled = (beta * np.abs(left[-1, :want]) <= 1e-15 * s[0]).all()
            if settled and total - (s**2).sum() < (1 - 1e-6) * s[want - 1] ** 2:
                break
        if k == width:
            break
        fresh = beta <= floor
        above.append(0.0 if fresh else beta)
        v = direction() if fresh else r / beta
    vectors = right[:want] @ v_all.T
    return s[:want], vectors / np.linalg.norm(vectors, axis=1)[:, None], k


def _added(rows: DataFrame, task: Callable, parts: int) -> np.ndarray:
    """The sum over all tasks of the vector that task(batches) makes. Beyond 256 tasks, groups of them are added up first."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([task(b.column(0) for b in batches).tolist()], pa.list_(pa.float64()))], names=["v"])

    def merge(batches):
        some = [np.array(v) for b in batches for v in b.column(0).to_pylist()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(some, 0).tolist()], pa.list_(pa.float64()))], names=["v"])

    made = rows.mapInArrow(run, "v array<double>")
    while parts > 256:
        parts = math.isqrt(parts)
        made = made.repartition(parts).mapInArrow(merge, "v array<double>")
    return np.sum([r.v for r in made.collect()], 0)


def _moments(rows: DataFrame, width: int) -> tuple[int, list[int], list[int]]:
    """Number of rows, sums and sums of squares by dimension, exactly: whole numbers of any size travel as text."""

    def run(batches):
        count, sums, squares = 0, np.zeros(width, object), np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            if _largest(x) ** 2 * max(1, len(x)) >= 1 << 62:
                x = x.astype(object)
            count, sums, squares = count + len(x), sums + x.sum(0).astype(object), squares + (x * x).sum(0).astype(object)
        numbers = [count, *sums.tolist(), *squares.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(numbers))], pa.int32()), pa.array([str(x) for x in numbers])], names=["at", "x"])

    def add(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + int(x)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([str(x) for x in total.values()])], names=["at", "x"])

    total = [0] * (2 * width + 1)
    for r in rows.mapInArrow(run, "at int, x string").repartition("at").mapInArrow(add, "at int, x string").collect():
        total[r["at"]] += int(r.x)
    return total[0], total[1 : width + 1], total[width + 1 :]


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = 4, scale: float = 256.0) -> Whitening | None:
    """Fit to the distinct integer vectors of all usable rows, each counted once; None if there is no row.

    Vectors of one width are fitted, the one that most distinct vectors have (the larger of equals). There
    are as many components as dimensions with variance, and `components` at most: none if all vectors are equal.
    """
    scratch = Scratch(vectors.sparkSession)
    try:
        found = scratch.saved(vectors.where(usable(vector)).select(integers(vector, scale).alias("x")).distinct(), "distinct")
        widths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        if not widths:
            return None
        width = widths[0].d
        fit = found.where(F.size("x") == width)
        n, sums, squares = _moments(fit, width)
        total = float(sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / n)
        model = Whitening(n, tuple(sums), np.zeros((0, width)), np.zeros(0), total / n)
        if total <= 0:
            return model._replace(identity_error=0.0)
        parts = fit.rdd.getNumPartitions()

        def product(w: np.ndarray) -> tuple[float, np.ndarray]:
            def task(columns):
                out = np.zeros(width + 1)
                for c in columns:
                    x = model.centred(_matrix(c, width))
                    u = x @ w
                    out += np.r_[u @ u, u @ x]
                return out

            out = _added(fit, task, parts)
            return float(out[0]), out[1:]

        s, v, steps = bidiagonalise(product, width, total, min(components, width))
        real = s > 1e-10 * s[0]
        model = model._replace(components=v[real], variances=s[real] ** 2 / n, steps=steps)

        def covariance(columns):
            out = np.zeros((real.sum(), real.sum()))
            mean = np.zeros(real.sum())
            for c in columns:
                y = model.whitened(_matrix(c, width))
                out += y.T @ y
                mean += y.sum(0)
            return np.r_[mean, out.ravel()]

        k = int(real.sum())
        seen = _added(fit, covariance, parts) / n
        off = seen[k:].reshape(k, k) - np.outer(seen[:k], seen[:k]) - np.eye(k)
        return model._replace(identity_error=float(np.abs(off).max()))
    finally:
        scratch.close()


_COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_embeddings(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component from 1.

    An entry c counts as the integer x = floor(scale * c); a value beyond 64 bits as the nearest one within. Rows whose
    vector is null, empty or holds a null or non-finite entry are left out, as are those of another width than the fitted one.
    Repeated rows, repeated and null ids keep a row each; a vector that occurs often is fitted once. deviation is the
    exact sum of (n * x - S)^2, null where that is beyond 64 bits; explained is the component's share of
    the covariance's trace. Directions without variance (a deviation
    of 1e-10 of the largest or less) are no components, so equal vectors and an empty table give no rows.
    Other columns are ignored.
    """
    model = fit_whitening(vectors, vector, components, scale)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], _COLUMNS)
    width, k = len(model.sums), len(model.variances)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            deviation = m.deviations(x) if len(x) else []
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), m.n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(m.whitened(x).ravel(), pa.float64()),
                    pa.array(np.tile(m.variances / m.trace, len(x))),
                    pa.array(np.full(len(each), m.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = vectors.where(usable(vector) & (F.size(vector) == width)).select(F.col(id).cast("long").alias("vec_id"), integers(vector, scale).alias("x"))
    return rows.mapInArrow(run, _COLUMNS)
