"""Embedding whitening: distributed centred covariance, own eigensolver, broadcast projection.

Entries are fixed-point longs ``x = floor(64 * c) + 1000000``. One pass over the rows sums
them exactly, a second sums the products of ``x`` less the rounded mean: every task keeps
one matrix and sends a row of it at a time, and Spark adds them up in two steps. The
covariance, whose size is that of a vector, is decomposed on the driver: Householder
reflections to a tridiagonal matrix, Sturm counts and bisection for the leading
eigenvalues, inverse iteration with reorthogonalisation inside clusters for their
vectors. The components are broadcast; a third pass measures the covariance of the
projected rows against the identity and the last one gives the rows.

* Rows whose vector is null or holds null or non-finite entries are dropped, as are empty
  vectors and those of another length than most of the rest have (of ties the longest).
* Products and sums are exact as long as they are below 2**53; ``x`` saturates at a long's
  range; a ``deviation`` beyond it is null.
* Repeated rows, equal and null ids count like any other. Equal eigenvalues get some
  orthonormal basis. Components whose eigenvalue is no more than ``FLAT`` times the
  greatest carry no variance and have no rows: equal vectors alone give no rows at all.
* No rows give no rows. Only the columns named are read, so extra ones cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larder.llm.common import LINES, sent, summed
from larder.session import materialise, ship_package

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Share of the greatest eigenvalue below which a component is rounding noise.
FLAT = 1e-11
# Eigenvalues nearer than this share of the norm are one cluster.
CLUSTER = 1e-3
# Numbers that a task holds of vectors of other lengths before it sends them on.
HELD = 1 << 20
# Long range, less what is added to it.
_TOP = float(2**63 - 2**21)


def vectors(column: pa.Array):
    """(length, row numbers, matrix of doubles) of the finite vectors of a list column, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    full = np.maximum(lengths, 0)
    ends = np.cumsum(full)
    bad = np.zeros(len(lengths), bool)
    bad[np.repeat(np.arange(len(lengths)), full)[~np.isfinite(values)]] = True
    for length in np.unique(lengths[(lengths > 0) & ~bad]):
        at = np.flatnonzero((lengths == length) & ~bad)
        yield int(length), at, values[(ends[at] - length)[:, None] + np.arange(length)]


def fixed(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -_TOP, _TOP).astype(np.int64) + SHIFT


def totals(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length and their exact sums by dimension."""

    def add(batches):
        held: dict[int, list] = {}

        def flush():
            for length, (n, high, low) in held.items():
                sums = [Decimal((int(h) << 31) + int(v)) for h, v in zip(high, low)]
                yield pa.record_batch([
                    pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()),
                    pa.array([n] * length, pa.int64()), pa.array(sums, pa.decimal128(38, 0))], ["length", "place", "n", "total"])
            held.clear()

        for batch in batches:
            for length, _, c in vectors(batch.column(0)):
                x = fixed(c)
                sums = held.setdefault(length, [0, np.zeros(length, np.int64), np.zeros(length, np.int64)])
                sums[0] += len(x)
                sums[1] += (x >> 31).sum(axis=0)
                sums[2] += (x & (2**31 - 1)).sum(axis=0)
            if sum(held) > HELD:
                yield from flush()
        yield from flush()

    parts = rows.select(vector).mapInArrow(add, "length int, place int, n long, total decimal(38,0)")
    sums = materialise(parts.groupBy("length", "place").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")), "vector-sums")
    most = sums.where("place = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return 0, []
    found = sums.where(F.col("length") == most["length"]).orderBy("place").collect()
    return most["n"], [int(r["total"]) for r in found]


def products(rows: DataFrame, vector: str, centre: np.ndarray) -> np.ndarray:
    """Sum over the vectors of the products of their centred entries."""
    size = len(centre)

    def add(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for length, _, c in vectors(batch.column(0)):
                if length == size:
                    y = (fixed(c) - centre).astype(np.float64)
                    total += y.T @ y
        if total.any():
            yield sent(total)

    return summed(rows.select(vector).mapInArrow(add, LINES), size)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and the Householder vectors that give a symmetric matrix that form."""
    a, mirrors = v.copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if not np.any(x[1:]):
            mirrors.append(np.zeros_like(x))
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ x
        w = 2 * (p - (x @ p) * x)
        rest -= np.outer(x, w) + np.outer(w, x)
        a[k + 1, k] -= 2 * x[0] * (x @ a[k + 1:, k])
        mirrors.append(x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def above(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: for every point the number of eigenvalues greater than it."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q, count = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q > 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, by bisection."""
    reach = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    slack = np.finfo(float).eps * max(1e-300, np.abs([low[0], high[0]]).max())
    low, high, rank = low - slack, high + slack, np.arange(1, k + 1)
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        enough = above(d, e, middle) >= rank
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return (low + high) / 2


def _solver(d: np.ndarray, e: np.ndarray, value: float, least: float):
    """LU with row exchanges of a shifted tridiagonal matrix, as a function of the right side."""
    n = len(d)
    main, up, up2 = (d - value).tolist(), [*e.tolist(), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        below = float(e[i])
        if abs(main[i]) >= abs(below):
            pivot = main[i] if abs(main[i]) > least else least
            main[i] = pivot
            factor = below / pivot
            main[i + 1] -= factor * up[i]
            steps.append((False, factor))
        else:
            factor = main[i] / below
            main[i], nxt = below, main[i + 1]
            main[i + 1] = up[i] - factor * nxt
            up[i], up2[i] = nxt, up[i + 1]
            up[i + 1] *= -factor
            steps.append((True, factor))
    if abs(main[-1]) <= least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.tolist()
        for i, (swapped, factor) in enumerate(steps):
            if swapped:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor * b[i]
        for i in range(n - 1, -1, -1):
            rest = up[i] * b[i + 1] if i + 1 < n else 0.0
            if i + 2 < n:
                rest += up2[i] * b[i + 2]
            b[i] = (b[i] - rest) / main[i]
        return np.array(b)

    return solve


def eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    n = len(v)
    k = min(k, n)
    scale = np.abs(v).max() if n else 0.0
    if not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, mirrors = tridiagonal(v / scale)
    values = leading(d, e, k)
    norm = max(np.abs(d).max(), np.abs(e).max() if len(e) else 0.0)
    near, least = CLUSTER * norm, np.finfo(float).eps * norm
    found, cluster, shift, draw = np.zeros((n, k)), 0, np.inf, np.random.default_rng(0)
    for j in range(k):
        if j and values[j - 1] - values[j] > near:
            cluster = j
        # Equal eigenvalues are parted a little, or one system would be solved twice.
        shift = min(values[j], shift - 10 * least) if j > cluster else values[j]
        solve, z = _solver(d, e, shift, least), draw.standard_normal(n)
        for _ in range(5):
            z = solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):
                z -= found[:, cluster:j] @ (found[:, cluster:j].T @ z)
                z /= np.linalg.norm(z)
        found[:, j] = z
    for i in range(len(mirrors) - 1, -1, -1):
        x = mirrors[i]
        found[i + 1:] -= 2 * np.outer(x, x @ found[i + 1:])
    return values * scale, found


@dataclass
class Whitening:
    """What is broadcast: counts and sums, the centre, and the scaled components as columns."""

    n: int
    sums: list[int]
    centre: np.ndarray
    offset: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.offset) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = x - self.centre
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.centre)]
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if len(rest) * most * most < 2**63:
            return ((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors of ``rows``."""
    n, sums = totals(rows, vector)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    offset = np.array([float(s - n * int(m)) / n for s, m in zip(sums, centre)])
    if not n:
        return Whitening(0, [], centre, offset, np.zeros((0, 0)), np.zeros(0))
    v = products(rows, vector, centre) / n - np.outer(offset, offset)
    v = (v + v.T) / 2
    values, found = eigenpairs(v, components)
    used = values > FLAT * values[:1].max(initial=0.0)
    used &= values > 0
    values, found = values[used], found[:, used]
    return Whitening(n, sums, centre, offset, found / np.sqrt(values), values / np.trace(v) if used.any() else values)


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest entry of the projected rows' covariance less the identity, measured over all rows."""
    k, size = model.scaled.shape[1], len(model.centre)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        total, used = np.zeros((k + 1, k + 1)), False
        for batch in batches:
            for length, _, c in vectors(batch.column(0)):
                if length == size:
                    z = np.pad(shared.value.project(fixed(c)), ((0, 0), (0, 1)), constant_values=1.0)
                    total, used = total + z.T @ z, True
        if used:
            yield sent(total)

    sums = summed(rows.select(vector).mapInArrow(add, LINES), k + 1) / model.n
    return float(np.abs(sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k]) - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    ship_package(rows.sparkSession)
    named = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    out = StructType([StructField(key, rows.schema[key].dataType), *StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    model = fit(named, "vector", components)
    k, size = model.scaled.shape[1], len(model.centre)
    if not k:
        return rows.sparkSession.createDataFrame([], out)
    error = identity_error(named, model, "vector")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches):
        for batch in batches:
            for length, at, c in vectors(batch.column(1)):
                if length != size:
                    continue
                x, model = fixed(c), shared.value
                many = len(at) * k
                yield pa.record_batch([
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(many, model.n), pa.int64()),
                    pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, len(at))),
                    pa.array(np.full(many, error))], out.names)

    return named.mapInArrow(project, out)
