"""Principal components and whitening of vectors by FEAST contour integration.

Entries c become whole numbers x = floor(SCALE c) + OFFSET, and each distinct x vector counts
once. Spark sums them, then their products about the rounded mean: products of small whole
numbers, so sums up to 2^53 are exact and do not depend on how rows are dealt. What is left is one
matrix, as wide as a vector, however many rows there are.

Its largest eigenvalues are cut into intervals by inertia: the signs of an LDL' factoring of
V - sI count the eigenvalues on each side of s. Edges lie in the middle of gaps. Every interval is a row
of a DataFrame and is solved in a task of its own: Gauss-Legendre points on a half circle through
the interval's ends give complex shifted systems (zI - V) Y = Q, their weighted sum projects Q
onto the eigenvectors of the interval, Rayleigh-Ritz extracts them, and the result is the next
Q until residuals are at rounding. An interval must give as many eigenvectors as inertia
counted; with fewer the subspace is widened, and if that does not help an error is raised.

Vectors that are null, empty or hold a null or non-finite entry take no part, nor do entries of
LARGEST or more in size. The dimension is that of most distinct vectors (the larger, if equally
many); others take no part either. Repeated rows and rows without an id each get their own
result rows. Directions without variance are no components: a table with one distinct vector, or none, gives no
rows. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from .arrays import lists

SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 40)
#: Points of the contour's upper half; the lower half mirrors them.
POINTS = 8
#: Eigenvalues that an interval should hold at most.
INTERVAL = 4
ROUNDS = 30
#: Eigenvalues closer than this part of the trace are not cut apart.
TOGETHER = 1e-10
#: An eigenvalue below this part of the trace has no four digits above rounding and is no component.
NEGLIGIBLE = 1e-11
_ROWS = 4096


def whole_numbers(vector: str) -> Column:
    """x of every entry, as longs; null where the vector takes no part."""
    entries = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    fits = F.size(entries).between(1, 1 << 30) & F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.when(fits, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def _matrices(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            part = batch.column(at).slice(low, _ROWS)
            if len(part):
                yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


class Moments(NamedTuple):
    """What the fit list says: its size, its sums and its covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def _added(parts: DataFrame) -> dict[str, list]:
    """Sums of the tasks' arrays, entry by entry; as many numbers as one task's."""
    cells = parts.select("kind", F.posexplode("numbers").alias("i", "x")).groupBy("kind", "i").agg(F.sum("x").alias("x"))
    out: dict[str, list] = {}
    for kind, i, x in sorted(cells.collect()):
        out.setdefault(kind, []).append(x)
    return out


def _numbers(kind: str, values, type_: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind]), pa.array([list(values)], pa.list_(type_))], names=["kind", "numbers"])


def moments(fit: DataFrame) -> Moments:
    """``fit`` holds distinct vectors ``x`` of one length; it is read twice."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for x in _matrices(batches):
            n, sums = n + len(x), sums + x.astype(object).sum(axis=0) if np.abs(x).max() >= 1 << 49 else sums + x.sum(axis=0)
        if n:
            yield _numbers("sums", [n, *map(int, sums)], pa.decimal128(38, 0))

    found = _added(fit.mapInArrow(total, "kind string, numbers array<decimal(38,0)>"))
    if not found:
        return Moments(0, [], np.zeros((0, 0)))
    n, *sums = map(int, found["sums"])
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for x in _matrices(batches):
            y = (x - centre).astype(float)
            gram = y.T @ y if gram is None else gram + y.T @ y
        if gram is not None:
            yield _numbers("gram", gram[np.triu_indices(len(centre))], pa.float64())

    upper = _added(fit.mapInArrow(products, "kind string, numbers array<double>"))["gram"]
    gram = np.zeros((len(centre), len(centre)))
    gram[np.triu_indices(len(centre))] = upper
    gram = np.triu(gram) + np.triu(gram, 1).T
    rest = np.array([(s - int(c) * n) / n for s, c in zip(sums, centre)])
    return Moments(n, sums, gram / n - np.outer(rest, rest))


# --- the spectrum --------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of LDL' with Bunch and Kaufman's choice."""
    a = matrix - shift * np.eye(len(matrix))
    positive, k, bound = 0, 0, (1 + np.sqrt(17)) / 8
    n = len(a)
    while k < n:
        column = np.abs(a[k + 1 :, k])
        largest = column.max(initial=0.0)
        two, other = False, k
        if largest > 0 and abs(a[k, k]) < bound * largest:
            r = k + 1 + int(column.argmax())
            beside = max(np.abs(a[r, k:r]).max(), np.abs(a[r + 1 :, r]).max(initial=0.0))
            if abs(a[k, k]) * beside < bound * largest**2:
                other, two = r, abs(a[r, r]) < bound * beside
        to = k + two
        a[[to, other]] = a[[other, to]]
        a[:, [to, other]] = a[:, [other, to]]
        end = k + 1 + two
        pivot = a[k:end, k:end]
        positive += 1 if two else int(a[k, k] > 0)  # a 2 x 2 pivot has one of each sign
        if two or a[k, k] != 0:
            left = a[end:, k:end]
            a[end:, end:] -= left @ np.linalg.solve(pivot, left.T)
        k = end
    return positive


def _bisect(matrix: np.ndarray, low: float, high: float, count: int, near: float) -> tuple[float, float]:
    """A bracket of the ``count``-th largest eigenvalue: ``count`` lie above its low end, fewer above its high end."""
    while high - low > near:
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if above(matrix, middle) >= count else (low, middle)
    return low, high


def above_all(matrix: np.ndarray, trace: float) -> float:
    """A shift a little above the largest eigenvalue: a wide empty end would blur the other."""
    _, high = _bisect(matrix, 0.0, trace * (1 + 1e-9), 1, 1e-6 * trace)
    return high + 1e-3 * high


def edge(matrix: np.ndarray, count: int, low: float, high: float) -> tuple[float, int]:
    """A shift in the middle of the gap below the ``count`` largest eigenvalues, and how many lie above it.

    Where eigenvalues coincide there, to TOGETHER of the trace, more lie above: they share an interval.
    """
    near = TOGETHER * float(np.trace(matrix))
    top, over = _bisect(matrix, low, high, count, near)
    top -= near
    found = above(matrix, top)
    bottom, under = _bisect(matrix, low, top, found + 1, 1e-3 * abs(over)) if found < len(matrix) else (low, low)
    while top - under < under - bottom:  # the next eigenvalue lies in [bottom, under]
        middle = (bottom + under) / 2
        if not bottom < middle < under:
            break
        bottom, under = (middle, under) if above(matrix, middle) > found else (bottom, middle)
    return (under + top) / 2, found


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high) with unit eigenvectors as columns, the largest first."""
    n, scale = len(matrix), np.abs(matrix).sum(axis=1).max()
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (1 - nodes)
    middle, radius = (low + high) / 2, (high - low) / 2
    width = min(n, count + max(4, count // 2))
    random = np.random.default_rng(n)
    space = random.standard_normal((n, width))
    for turn in range(ROUNDS):
        projected = np.zeros_like(space)
        for theta, weight in zip(angle, weights):
            point = radius * np.exp(1j * theta)
            solved = np.linalg.solve((middle + point) * np.eye(n) - matrix, space.astype(complex))
            projected += weight / 2 * (point * solved).real
        base, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(base.T @ matrix @ base)
        vectors = base @ inner
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        settled = inside & (residual <= 64 * np.finfo(float).eps * scale)
        if inside.sum() == count and settled.sum() == count:
            order = np.flatnonzero(inside)[::-1]
            return values[order], vectors[:, order]
        space = vectors
        if turn % 10 == 9 and width < n:
            width = min(n, 2 * width)
            space = np.hstack([vectors, random.standard_normal((n, width - vectors.shape[1]))])
    raise ArithmeticError(f"{int(settled.sum())} of {count} eigenvectors found in ({low}, {high})")


def leading(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above rounding and their eigenvectors, one task for each interval."""
    n = len(matrix)
    trace = float(np.trace(matrix)) if n else 0.0
    if trace <= 0:
        return np.zeros(0), np.zeros((n, 0))
    least = NEGLIGIBLE * trace
    wanted = min(most, above(matrix, least))
    cuts, found, high = [], 0, above_all(matrix, trace)
    while found < wanted:
        low, upto = edge(matrix, min(wanted, found + INTERVAL), -trace, high)
        high = max(high, low + 4 * TOGETHER * trace)
        cuts.append((float(low), float(high), upto - found))
        found, high = upto, low

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = feast(matrix, row["low"], row["high"], row["count"])
                columns = [pa.array(values), lists(vectors.T.ravel(), np.full(len(values), n), pa.float64())]
                yield pa.record_batch(columns, names=["value", "vector"])

    intervals = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts), "low")
    rows = sorted(intervals.mapInArrow(solve, "value double, vector array<double>").collect(), key=lambda r: -r.value)[:wanted]
    return np.array([r.value for r in rows]), np.array([r.vector for r in rows]).T


# --- whitening -------------------------------------------------------------


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of whole numbers."""
        centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)
        rest = np.array([(s - int(c) * self.n) / self.n for s, c in zip(self.sums, centre)])
        return ((x - centre).astype(float) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions, exact; null beyond a long."""
        sums = np.array(self.sums, dtype=object)
        if max(abs(int(x.max())), abs(int(x.min()))) * self.n < 1 << 62 and max(map(abs, self.sums)) < 1 << 62:
            apart = self.n * x - sums.astype(np.int64)
            if np.square(apart.astype(float)).sum(axis=1).max() < float(1 << 62):
                return np.square(apart).sum(axis=1).tolist()
        exact = [int(v) for v in np.square(self.n * x.astype(object) - sums).sum(axis=1)]
        return [v if v < 1 << 63 else None for v in exact]


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("x", whole_numbers(vector)).filter("x is not null")


def fit(rows: DataFrame, vector: str = "embedding", most: int = 16) -> Whitening:
    """Components of the distinct vectors of ``rows`` (up to ``most``, the largest first)."""
    distinct = stage_table(_usable(rows.select(F.col(f"`{vector}`").alias("vector")), "vector").select("x").distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).take(1)
    if not lengths:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), 0.0)
    distinct = distinct.filter(F.size("x") == lengths[0].size)
    found = moments(distinct)
    values, vectors = leading(rows.sparkSession, found.covariance, most)
    model = Whitening(found.n, found.sums, float(np.trace(found.covariance)), values, vectors, 0.0)
    return model._replace(identity_error=_identity_error(distinct, model)) if len(values) else model


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list, less the identity."""
    wide = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(wide), np.zeros((wide, wide))
        for x in _matrices(batches):
            white = model.project(x)
            total, gram = total + white.sum(axis=0), gram + white.T @ white
        yield _numbers("gram", gram.ravel(), pa.float64())
        yield _numbers("total", total, pa.float64())

    found = _added(distinct.mapInArrow(products, "kind string, numbers array<double>"))
    mean = np.array(found["total"]) / model.n
    gram = np.array(found["gram"]).reshape(wide, wide) / model.n
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(wide)).max())


def whiten(rows: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened) of every row that takes part; ``whitened`` is an array of its components."""
    wide, size = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, x in enumerate(_matrices([batch], 1)):
                white = model.project(x)
                columns = [ids.slice(k * _ROWS, len(x)), pa.array(model.deviations(x), pa.int64()), lists(white.ravel(), np.full(len(x), wide), pa.float64())]
                yield pa.record_batch(columns, names=["vec_id", "deviation", "whitened"])

    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    usable = _usable(rows, "vector").filter(F.size("x") == size if wide else F.lit(False)).select("vec_id", "x")
    return usable.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")
