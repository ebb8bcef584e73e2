"""Embedding whitening from Welford's streaming moments and a symmetric QR eigen-solve.

Entries become whole numbers first (floor(scale * c) + shift), so sums are
exact. Each distinct vector is fitted once: every partition streams its vectors
through Welford's rank-one updates (mean, then the scatter about it, which is
centred before it is multiplied), partitions merge by the parallel update
formula up a tree, and the covariance is diagonalised by Householder reflections
to tridiagonal form and implicit QR steps with Wilkinson's shift. The same
moments, taken of the whitened vectors, say how far their covariance is from the
identity.

What reaches the driver and what tasks get back is of the order of the square of
the dimensions, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import kept, own
from groundloom.llm.partials import summed

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Scaled entries are held within this, so that they stay exact in a double.
HELD = float(1 << 53)
#: A component with less than this share of the first one's variance has none.
NO_VARIANCE = 1e-12
SAFE = 1 << 62


@dataclass
class Moments:
    """n vectors' exact sums, mean and scatter (the sum of outer products of what differs from the mean)."""

    n: int = 0
    sums: np.ndarray | None = None
    mean: np.ndarray | None = None
    scatter: np.ndarray | None = None

    def add(self, vectors: np.ndarray, origin: int = 0) -> Moments:
        """Rank-one updates, vector by vector, of what is above origin; integer vectors are also summed exactly."""
        if self.mean is None:
            d = vectors.shape[1]
            self.mean, self.scatter = np.zeros(d), np.zeros((d, d))
            self.sums = np.zeros(d, dtype=object)
        for x in (vectors - origin).astype("float64"):
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            self.scatter += np.multiply.outer(before, x - self.mean)
        if vectors.dtype.kind == "i":
            high, low = vectors >> 20, vectors & 0xFFFFF  # each part's sum over a batch fits 64 bits
            self.sums = self.sums + high.sum(0).astype(object) * (1 << 20) + low.sum(0).astype(object)
        return self

    def merge(self, other: Moments) -> Moments:
        """The parallel update formula."""
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.multiply.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.sums + other.sums, self.mean + apart * (other.n / n), scatter)

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """d, e, q with q.T @ a @ q tridiagonal: d on its diagonal, e beside it."""
    a, n = np.array(a, dtype="float64"), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if not length or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns, each with its largest entry positive."""
    n = len(a)
    d, e, q = tridiagonal(a)
    q, tiny, hi = np.ascontiguousarray(q.T), np.finfo(float).eps, n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        zero = np.flatnonzero(e[:hi] == 0)
        lo = int(zero[-1]) + 1 if len(zero) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # chase the bulge down
            r = np.hypot(x, z)
            c, s = (1.0, 0.0) if r == 0 else (x / r, z / r)
            if k > lo:
                e[k - 1] = r
            p, t, b = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * b + s * s * t, s * s * p - 2 * c * s * b + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * b
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    vectors = q[order].T
    if n:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(n)] < 0, -1.0, 1.0)
    return d[order], vectors


@dataclass
class Whitening:
    """A fitted whitening: n distinct vectors with these exact sums; one row of axes (unit) and one variance for each component."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = field(default=float("nan"))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - sums, exactly: as 64-bit integers where they fit, else as Python's."""
        most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))])
        if most * self.n < SAFE and max(map(abs, self.sums), default=0) < SAFE:
            return x * np.int64(self.n) - np.array(self.sums, dtype="int64")
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype("float64") / self.n) @ self.axes.T / np.sqrt(self.variances)


def whole(entry: Column, scale: float, shift: int) -> Column:
    scaled = entry.cast("double") * F.lit(float(scale))
    return F.floor(F.greatest(F.least(scaled, F.lit(HELD)), F.lit(-HELD))).cast("long") + F.lit(shift).cast("long")


def usable(vectors: DataFrame, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (array<bigint>): the rows whose vector is not null and holds finite entries only.

    A vector shorter than the longest is filled up with entries of 0 at its
    end, so that all have as many dimensions.
    """
    rows = own(vectors, "vec_id", "embedding")
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    x = rows.where(finite).select("vec_id", F.transform("embedding", lambda c: whole(c, scale, shift)).alias("x"))
    longest = x.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if longest[0] == longest[1]:
        return x
    return x.select("vec_id", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(longest[0]) - F.size("x"))).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def moments(rows: DataFrame, origin: int = 0, model: Whitening | None = None) -> Moments | None:
    """Moments of the vectors x (scatter and mean from origin, for small numbers), or of what the model makes of them."""

    def add(state: Moments, batch: pa.RecordBatch) -> Moments:
        x = matrix(batch)
        return state.add(x, origin) if model is None else state.add(model.whitened(model.centred(x)))

    return summed(rows.select("x"), Moments, add, Moments.merge)


def fit(x: DataFrame, components: int = COMPONENTS, origin: int = SHIFT) -> Whitening | None:
    """The whitening of the distinct vectors of x, or None if there is nothing to whiten (no vector, or no variance)."""
    each = kept(x.select("x").where(F.size("x") > 0).distinct(), "vectors")
    m = moments(each, origin)
    if m is None:
        return None
    values, axes = symmetric_qr(m.covariance())
    live = values[:components] > NO_VARIANCE * max(values[0], 0)
    if not values[0] > 0:
        return None
    model = Whitening(m.n, list(map(int, m.sums)), axes.T[:components][live], values[:components][live], float(np.trace(m.covariance())))
    again = moments(each, model=model)
    model.identity_error = float(np.abs(again.covariance() - np.eye(len(model.variances))).max())
    return model


ROWS = "vec_id bigint, deviation decimal(38,0), whitened array<double>"


def apply(x: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (one entry a component): one row for each row of x; a deviation of more than 38 digits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = model.centred(matrix(batch))
            most = max(int(apart.max(initial=0)), -int(apart.min(initial=0)))
            if apart.dtype != object and most * most * apart.shape[1] < SAFE:
                deviation = pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
            else:
                squares = (apart.astype(object) ** 2).sum(1).tolist()
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
            out = model.whitened(apart)
            ends = pa.array(np.arange(len(out) + 1, dtype="int32") * out.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["vec_id", "deviation", "whitened"])

    return x.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, ROWS)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    vectors: vec_id, embedding; other columns aren't read. Rows whose vector is
    null or holds null or non-finite entries are left out; shorter vectors are
    filled up with 0 (see usable()). Repeated rows and equal vectors are fitted
    once and each get their rows. There are as many components as asked for, or
    as dimensions, or as have variance, whichever is least: a component without
    variance can't be whitened. An empty table, one distinct vector, or empty
    vectors thus give no rows. Entries past 2**53 after scaling are held there.
    deviation is a decimal(38,0), null where it has more digits.
    """
    spark = vectors.sparkSession
    x = usable(vectors, scale, shift)
    model = fit(x, components, shift)
    if model is None:
        kinds = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], kinds)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.variances))
    each = apply(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """The rows with deviation as a long: null where it doesn't fit one."""
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
