"""Embedding whitening: streaming covariance by rank-one updates, merged over partitions, and a symmetric QR eigen-solve.

Entries become integers ``floor(64 c) + 1000000``.  The fit list holds each distinct integer vector once.  Every task keeps, for each
vector length, a count, a mean and a matrix of centred second moments and updates them by one vector at a time; the states of tasks are
merged by the formula for two parts, 64 at a time, until one is left.  That state has the size of a covariance matrix, whatever the
number of vectors, and is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, extended, free_name, partitions, without

SCALE, OFFSET = 64.0, 1_000_000
#: Entries beyond this become this, so that sums of a billion vectors stay exact.
LARGEST = 1 << 32
#: States that one task merges.
FAN_IN = 64
#: Rows that become output at a time, each a row for every component.
ROWS = 500
#: Components whose share of the largest variance is below this count as constant.
FLAT = 1e-12
_STATE = "part int, dim int, n long, origin binary, total binary, mean binary, moment binary"
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def complete(col: str) -> Column:
    """Neither null nor holding a null or non-finite entry."""
    c = F.col(f"`{col}`")
    return F.coalesce(c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integer_vector(col: str) -> Column:
    """``floor(64 c) + 1000000`` of every entry."""
    return F.transform(f"`{col}`", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("long") + OFFSET)


@dataclass
class Moments:
    """Count, exact integer sums, mean and centred second moments of vectors, as differences from an integer ``origin``."""

    origin: np.ndarray
    n: int = 0
    total: np.ndarray | None = None
    mean: np.ndarray | None = None
    moment: np.ndarray | None = None

    def __post_init__(self) -> None:
        d = len(self.origin)
        if self.mean is None:
            self.total, self.mean, self.moment = np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one update."""
        rel = x - self.origin
        self.n += 1
        self.total += rel.astype(np.int64)
        before = rel - self.mean
        self.mean += before / self.n
        self.moment += np.multiply.outer(before, rel - self.mean)

    def merge(self, other: Moments) -> None:
        """The state of another part."""
        shift = other.origin - self.origin
        n = self.n + other.n
        apart = (shift + other.mean) - self.mean
        self.moment += other.moment + np.multiply.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.total = self.total + other.total + shift.astype(np.int64) * other.n
        self.n = n

    def sums(self) -> list[int]:
        return [int(t) + self.n * int(o) for t, o in zip(self.total, self.origin)]

    def covariance(self) -> np.ndarray:
        return (self.moment + self.moment.T) / (2 * self.n)


_PARTS = ("origin", "total", "mean", "moment")


def _states(found: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in _PARTS]])
    part = TaskContext.get().partitionId()
    for d, m in found.items():
        yield pa.RecordBatch.from_pylist([{"part": part, "dim": d, "n": m.n} | {c: getattr(m, c).tobytes() for c in _PARTS}], schema)


def _read(row: dict) -> Moments:
    own = {c: np.frombuffer(row[c], t).copy() for c, t in zip(_PARTS, (np.int64, np.int64, np.float64, np.float64))}
    return Moments(own["origin"], row["n"], own["total"], own["mean"], own["moment"].reshape(len(own["mean"]), -1) if len(own["mean"]) else np.zeros((0, 0)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Moments] = {}
    for b in batches:
        for row in b.to_pylist():
            d, m = row["dim"], _read(row)
            if d in found:
                found[d].merge(m)
            else:
                found[d] = m
    yield from _states(found)


def vectors_of(col: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a list column, each as one array."""
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *col.value_lengths().to_pylist()])
    return (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))


def moments(vectors: DataFrame, col: str, models: dict[int, Model] | None = None) -> dict[int, Moments]:
    """Moments of the integer vectors in ``col`` by vector length, or of what the models whiten them to.

    Equal to a single pass over all vectors up to rounding; tasks that are run again start from nothing, so none counts twice."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for b in batches:
            for x in vectors_of(b.column(0)):
                d = len(x)
                if models is not None:
                    x = models[d].whiten(x)
                if d not in found:
                    found[d] = Moments(np.zeros(len(x), np.int64) if models is not None else x.astype(np.int64))
                found[d].add(x)
        yield from _states(found)

    states, width = arrow_map(vectors.select(f"`{col}`"), fold, _STATE), partitions(vectors.sparkSession)
    while True:
        width = -(-width // FAN_IN)
        states = arrow_map(states.repartitionById(width, F.pmod("part", F.lit(width))), _merge, _STATE)
        if width == 1:
            return {r["dim"]: _read(r.asDict()) for r in states.collect()}


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the orthogonal matrix ``q`` of ``q.T @ a @ q``, by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns: tridiagonal form, then implicit QR steps with Wilkinson's shift."""
    d = len(a)
    diag, off, q = tridiagonal(np.asarray(a, float))
    q = np.ascontiguousarray(q.T)  # rows are the vectors that rotations mix
    end, left = d - 1, sweeps * max(d, 1)
    while end > 0:
        small = np.abs(off[:end]) <= np.finfo(float).eps * (np.abs(diag[:end]) + np.abs(diag[1 : end + 1]))
        off[:end][small] = 0.0
        if off[end - 1] == 0.0:
            end -= 1
            continue
        if (left := left - 1) < 0:
            raise ArithmeticError("eigenvalues did not settle")
        start = end - 1
        while start > 0 and off[start - 1] != 0.0:
            start -= 1
        half = (diag[end - 1] - diag[end]) / 2
        shift = diag[end] - off[end - 1] ** 2 / (half + np.copysign(np.hypot(half, off[end - 1]), half))
        x, z = diag[start] - shift, off[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                off[k - 1] = r
            p, t, b = diag[k], diag[k + 1], off[k]
            diag[k], diag[k + 1] = c * c * p + 2 * c * s * b + s * s * t, s * s * p - 2 * c * s * b + c * c * t
            off[k] = c * s * (t - p) + (c * c - s * s) * b
            x = off[k]
            if k + 1 < end:
                z, off[k + 1] = s * off[k + 1], c * off[k + 1]
            q[[k, k + 1]] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-diag, kind="stable")
    return diag[order], q[order].T


@dataclass
class Model:
    """What one vector length needs: ``weights`` are components over the root of their eigenvalues."""

    n: int
    sums: list[int]
    origin: np.ndarray
    mean: np.ndarray
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.weights @ ((x - self.origin) - self.mean)

    def deviation(self, x: np.ndarray) -> int | None:
        """Sum of ``(n x - S)^2``, exact; None beyond a long."""
        out = sum((self.n * a - s) ** 2 for a, s in zip(x.tolist(), self.sums))
        return out if out < 1 << 63 else None


def fit(fit_list: DataFrame, col: str, components: int = 16) -> dict[int, Model]:
    """A model for each vector length of the distinct integer vectors in ``col``; signs make the largest entry positive."""
    models = {}
    for d, m in moments(fit_list, col).items():
        values, vectors = symmetric_eigen(m.covariance())
        k = int((values[:components] > FLAT * max(values[0], 0.0)).sum()) if d and values[0] > 0 else 0
        w = vectors[:, :k].T
        w = w * np.sign(w[np.arange(k), np.abs(w).argmax(1)])[:, None] if k else np.zeros((0, d))
        trace = float(np.trace(m.covariance()))
        models[d] = Model(m.n, m.sums(), m.origin, m.mean, w / np.sqrt(values[:k])[:, None], values[:k] / trace if k else np.zeros(0))
    for d, m in moments(fit_list, col, models).items():
        models[d].identity_error = float(np.abs(m.covariance() - np.eye(len(m.mean))).max()) if len(m.mean) else None
    return models


def whiten(df: DataFrame, col: str = "embedding", components: int = 16) -> DataFrame:
    """One row for each row of ``df`` and component: its columns but ``col``, then ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    Rows whose vector is null or holds a null or non-finite entry are left out; rows that repeat an id or a vector all stay, but the
    fit counts each integer vector once.  Vectors of another length are fitted and whitened among themselves.  Components of no
    variance have no row, so a single distinct vector, an empty vector and an empty table give none.  A deviation beyond a long is
    null; entries beyond 2^32 become that.  Input columns named as an output are replaced."""
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    x = free_name(df, "x")
    rows = without(df.where(complete(col)).withColumn(x, integer_vector(col)), [*names, col])
    fit_list = cut(rows.select(x).groupBy(x).agg(F.lit(1).alias("one")).select(x), "fit")
    models = fit(fit_list, x, components)
    discard(fit_list)
    others = [c for c in rows.columns if c != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                take, out = [], {c: [] for c in names}
                for i, v in enumerate(vectors_of(b.column(x))):
                    m = models[len(v)]
                    z = m.whiten(v).tolist()
                    take += [i] * len(z)
                    for c, values in zip(names, (range(1, len(z) + 1), [m.n] * len(z), [m.deviation(v)] * len(z), z, m.explained.tolist(), [m.identity_error] * len(z))):
                        out[c] += values
                cols = [b.column(c).take(pa.array(take, pa.int64())) for c in others]
                typed = [pa.array(out[c], t) for c, t in zip(names, (pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3))]
                yield pa.RecordBatch.from_arrays([*cols, *typed], [*others, *names])

    return arrow_map(rows.select(*[f"`{c}`" for c in others], x), run, extended(rows.drop(x), _OUT))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
