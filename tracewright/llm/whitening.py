"""Whitening of embeddings by the leading components of their covariance, found by FEAST.

Fit. Entries become integers, so sums are exact; tasks add the products of centred
vectors, and the covariance of all vectors, a matrix of the dimension squared, is all
that reaches the driver. There the eigenvalues wanted are fenced in intervals by
inertia: by Sylvester's law the signs in a symmetric factorisation of V - s count the
eigenvalues above s. For each interval the resolvent (z - V)^-1 applied to random
vectors is summed over Gauss-Legendre points of a circle through its ends, which
projects on the eigenvectors inside; Rayleigh-Ritz takes them out, and the step repeats
until residuals reach rounding. As many must be found as inertia says, else the subspace
grows; what still misses one is an error.

Apply. A vector's coordinates are one matrix product a batch; nothing is shuffled. The
only shuffles are of sums, one row a dimension a task.

Defined cases: vectors that are null, or hold null, non-finite or entries beyond
LARGEST in size, are left out; so are those of another dimension than most have (ties:
the larger dimension); a vector without entries has dimension none. Rows with a null
vec_id, repeated rows and repeated ids all count and come out. Components whose
eigenvalue is zero to rounding do not exist, so there may be fewer than asked for: none
for vectors that are all equal, and none from an empty table. Equal eigenvalues give
some orthonormal basis of their space. A deviation that no long holds is null. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import n_partitions, written

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0**40
#: Dimensions that the driver takes: a covariance of 128 MB.
MAX_DIMENSIONS = 4096
#: Eigenvalues an interval should hold, and quadrature points of a half circle.
PER_INTERVAL = 4
POINTS = 8
#: Rows added up in 64-bit integers at a time: entries stay below 2**51.
_STEP = 4096


# spectral part: dense symmetric matrices of bounded size


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix a exceed shift: positive pivots of its Bunch-Kaufman factorisation."""
    m = a - shift * np.eye(len(a))
    n, k, positive, alpha = len(m), 0, 0, (1 + math.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < n:
        below = np.abs(m[k + 1 :, k])
        most = below.max() if len(below) else 0.0
        two = False
        if most > 0 and abs(m[k, k]) < alpha * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            if abs(m[k, k]) * row.max() < alpha * most * most:
                if abs(m[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            # such a block has a negative determinant: one eigenvalue of each sign
            positive += 1
            c = m[k + 2 :, k : k + 2].copy()
            m[k + 2 :, k + 2 :] -= c @ np.linalg.solve(m[k : k + 2, k : k + 2], c.T)
            k += 2
        else:
            positive += bool(m[k, k] > 0)
            if most > 0:
                c = m[k + 1 :, k].copy()
                m[k + 1 :, k + 1 :] -= np.outer(c, c / m[k, k])
            k += 1
    return positive


def fence(a: np.ndarray, low: float, high: float, count: int, finest: float) -> tuple[float, int]:
    """(s, eigenvalues above s) with count of them if a cut between low and high has so many, else the next more."""
    found = above(a, low)
    while found != count and high - low > finest:
        middle = (low + high) / 2
        c = above(a, middle)
        if c < count:
            high = middle
        else:
            low, found = middle, c
    last = low
    for _ in range(8):
        middle = (last + high) / 2
        last, high = (middle, high) if above(a, middle) == found else (last, middle)
    # the middle of the gap, where the filter parts both sides best
    return (low + last) / 2, found


def intervals(a: np.ndarray, count: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), together the count largest eigenvalues, and more where they are too close to part."""
    top = float(np.abs(a).sum(axis=1).max())
    if not top:
        return []
    least, finest = len(a) * 4 * np.finfo(float).eps * top, 1e-9 * top
    count = min(count, above(a, least))
    if not count:
        return []
    low, inside = fence(a, least, top * 1.01, count, finest)
    out, todo = [], [(low, top * 1.01, inside)]
    while todo:
        a_low, a_high, m = todo.pop()
        beyond = inside - sum(x[2] for x in out) - sum(x[2] for x in todo) - m
        cut, n = fence(a, a_low, a_high, beyond + (m + 1) // 2, finest) if m > PER_INTERVAL else (a_low, beyond + m)
        if n - beyond in (0, m):
            out.append((a_low, a_high, m))
        else:
            # the upper part stays on top, so that parts are taken from below and `beyond` counts those above
            todo += [(cut, a_high, n - beyond), (a_low, cut, m - (n - beyond))]
    return out


def project(a: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues of a in (low, high) and their eigenvectors, by contour integration and Rayleigh-Ritz."""
    n, rng = len(a), np.random.default_rng(seed)
    size = np.abs(a).sum(axis=1).max()
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(0.5j * np.pi * (nodes + 1))
    width = min(n, count + max(count, 6))
    while True:
        y, best = rng.standard_normal((n, width)), np.inf
        for _ in range(60):
            q = sum(0.5 * w * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - a, y)).real for t, w in zip(turn, weights, strict=True))
            q, _ = np.linalg.qr(q)
            values, inner = np.linalg.eigh(q.T @ a @ q)
            y = q @ inner
            inside = (values > low) & (values < high)
            rest = np.linalg.norm(a @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == count and (rest <= 1e-15 * size or best <= 1e-11 * size and rest > best / 2):
                return values[inside], y[:, inside]
            best = min(best, rest) if inside.sum() == count else np.inf
        if width == n:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but {int(inside.sum())} were found")
        width = min(n, 2 * width)


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count largest positive eigenvalues of the symmetric matrix a, falling, and their unit eigenvectors as columns."""
    # eigenvalues of a matrix in the range of floating point, whatever the scale of the data
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    a = a / scale
    parts = [project(a, *part, seed=k) for k, part in enumerate(intervals(a, count))]
    if not parts:
        return np.zeros(0), np.zeros((len(a), 0))
    q, _ = np.linalg.qr(np.hstack([v for _, v in parts]))
    values, inner = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-values)[:count]
    return values[order] * scale, (q @ inner)[:, order]


# Spark part


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors as integers."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.size("embedding") > 0).where(F.forall("embedding", good))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")).alias("x"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


@dataclass
class Fit:
    """Count and exact sums of the vectors, their components (columns) and eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def near(self) -> np.ndarray:
        """The integers next to the means, and what is left of the means."""
        return np.array([round(Fraction(s, self.n)) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n) - round(Fraction(s, self.n))) for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n * x - S) ** 2; None where a long does not hold it."""
        y, left = x - self.near, [s - self.n * int(c) for s, c in zip(self.sums, self.near, strict=True)]
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * len(left) < 1 << 62:
            z = self.n * y - np.array(left, dtype=np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, left, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors of the dimension that most have, and their exact sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            column = batch.column("x")
            size = pc.list_value_length(column)
            for d in pc.unique(size).to_pylist():
                of = column if len(column) == pc.sum(pc.equal(size, d)).as_py() else column.filter(pc.equal(size, d))
                m = _matrix(of, d)
                n, s = total.get(d, (0, [0] * d))
                for k in range(0, len(m), _STEP):
                    s = [a + b for a, b in zip(s, m[k : k + _STEP].sum(axis=0).tolist(), strict=True)]
                total[d] = (n + len(m), s)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict(
                {"size": pa.array([d] * d, pa.int32()), "at": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))}
            )

    parts = x.select("x").mapInArrow(add, "size int, at int, n long, s decimal(38,0)")
    whole = written(parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")), "sums", narrow=True)
    most = whole.where("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    if most["size"] > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {most['size']} dimensions; {MAX_DIMENSIONS} at most")
    return most["n"], [int(r["s"]) for r in whole.where(F.col("size") == most["size"]).orderBy("at").select("s").collect()]


def _products(x: DataFrame, d: int, rows: int, of) -> np.ndarray:
    """The sum over all vectors of y y^T, y = of(x) with so many rows: tasks add batches, then each row of the matrix is added up."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, rows))
        for batch in batches:
            y = of(_matrix(batch.column("x"), d))
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(rows), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("row").to_pylist(), _matrix(batch.column("sums"), rows), strict=True):
                total[i] = total[i] + v if i in total else v.copy()
        yield pa.RecordBatch.from_pydict({"row": pa.array(list(total), pa.int32()), "sums": pa.array(list(total.values()), pa.list_(pa.float64()))})

    schema = "row int, sums array<double>"
    n = min(rows, n_partitions(x.sparkSession))
    found = x.select("x").mapInArrow(multiply, schema).repartition(n, "row").mapInArrow(add, schema).orderBy("row").collect()
    return np.array([r["sums"] for r in found])


def fit(x: DataFrame, count: int = 8) -> Fit | None:
    """The count leading components of vectors(embeddings); None without vectors."""
    n, s = sums(x)
    if not n:
        return None
    out = Fit(n, s, np.zeros((len(s), 0)), np.zeros(0), 0.0)
    v = _products(x.where(F.size("x") == len(s)), len(s), len(s), out.centred) / n
    v = (v + v.T) / 2
    out.trace = float(v.trace())
    out.eigenvalues, out.components = leading(v, count)
    return out


def identity_error(x: DataFrame, fitted: Fit) -> float:
    """The largest entry in size of the whitened vectors' covariance less the identity, over all of them."""
    d, k = fitted.components.shape
    scaled = fitted.components / np.sqrt(fitted.eigenvalues)

    def coordinates(m: np.ndarray) -> np.ndarray:
        return np.hstack([fitted.centred(m) @ scaled, np.ones((len(m), 1))])

    found = _products(x.where(F.size("x") == d), d, k + 1, coordinates)
    mean = found[k, :k] / fitted.n
    return float(np.abs(found[:k, :k] / fitted.n - np.outer(mean, mean) - np.eye(k)).max())


def transform(x: DataFrame, fitted: Fit) -> DataFrame:
    """(vec_id, deviation, whitened): each vector's exact deviation and its coordinates, in the order of the components."""
    d = len(fitted.sums)
    scaled = fitted.components / np.sqrt(fitted.eigenvalues)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("x"), d)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id"), "deviation": pa.array(fitted.deviations(m), pa.int64()), "whitened": pa.array(list(fitted.centred(m) @ scaled), pa.list_(pa.float64()))}
            )

    return x.where(F.size("x") == d).mapInArrow(apply, "vec_id long, deviation long, whitened array<double>")


def digest(embeddings: DataFrame, count: int = 8) -> DataFrame:
    """One row a vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    x = vectors(embeddings)
    fitted = fit(x, count)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], schema)
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues])
    rows = transform(x, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(identity_error(x, fitted)).alias("identity_error"),
    )
