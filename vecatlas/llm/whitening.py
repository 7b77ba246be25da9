"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries c become whole numbers x = floor(1024 c) + 100000, so that sums and the scatter are exact: every task
subtracts a whole number near the mean before it multiplies, the rest of the mean (under one half) is taken away in
exact arithmetic, and each entry of the covariance is rounded once. The scatter of d dimensions is a d x d matrix, which
the driver factors; rows never leave their tasks.

The factor L of the pivoted Cholesky decomposition has the covariance L L^T. Plane rotations from the right make its
columns orthogonal (one-sided Jacobi, in rounds of disjoint pairs): then the squared norms of the columns are the
eigenvalues and the normalised columns the components, to high relative precision.

Rows whose vector is null, empty, or holds a null, NaN, infinite or huge entry (2^51 or more: x and its sums would not be
whole numbers of 64 bits) take no part, nor do vectors of another length than the common one. Equal rows are fitted and
returned as often as they come, rows without an id too. Constant dimensions and linearly dependent ones lower the rank;
there are only as many components as the rank. An empty table gives no rows.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.tables import free_name, small_batches
from vecatlas.llm.vectors import common_length, complete, matrix, summed

SCALE, OFFSET, LARGEST = 1024, 100_000, float(1 << 51)
COMPONENTS = 8
# Products of two limbs of 21 bits over 2^12 rows are exact in float64.
_LIMB, _ROWS, _HALF = 21, 1 << 12, 31


@dataclass(frozen=True)
class Whitening:
    """``components`` are rows; ``centre`` and ``rest`` / ``n`` together are the mean of x, exactly."""

    n: int
    dim: int
    centre: np.ndarray
    rest: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def whole(self, vectors: np.ndarray) -> np.ndarray:
        """x less the centre, as whole numbers."""
        return _whole(vectors) - self.centre

    def project(self, moved: np.ndarray) -> np.ndarray:
        centred = moved - np.array([r / self.n for r in self.rest])
        return centred @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, moved: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exactly."""
        n, largest = self.n, max(1, int(np.abs(moved).max(initial=0)))
        room = (1 << 62) // self.dim
        kind = lambda other: np.int64 if largest * other < room else object
        rest = max(map(abs, self.rest), default=0)
        square = (moved.astype(kind(largest)) ** 2).sum(axis=1)
        cross = (moved.astype(kind(rest)) * np.array(self.rest, kind(rest))).sum(axis=1)
        constant = sum(r * r for r in self.rest)
        return [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip(square, cross)]


def _whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + OFFSET


def _halves(values: np.ndarray) -> np.ndarray:
    """High and low parts of whole numbers, whose sums over many rows or tasks do not overflow."""
    return np.stack([values >> _HALF, values & ((1 << _HALF) - 1)])


def _joined(halves: np.ndarray) -> np.ndarray:
    return halves[0].astype(object) * (1 << _HALF) + halves[1].astype(object)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Three signed limbs, lowest first."""
    out = []
    for _ in range(2):
        upper = (values + (1 << (_LIMB - 1))) >> _LIMB
        out.append((values - (upper << _LIMB)).astype(np.float64))
        values = upper
    return [*out, values.astype(np.float64)]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows that take part (see the module), whatever their other columns."""
    known = rows.where(complete(F.col(vector), LARGEST))
    return known.where(F.size(vector) == common_length(known, vector))


def covariance(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, list[int], np.ndarray]:
    """Count, whole centre, what is left of the sums, and the covariance (divisor n) of x."""
    vectors = rows.select(F.col(vector).cast("array<double>").alias("v"))
    dim = common_length(vectors, "v")

    def sums(batches):
        for batch in batches:
            x = _whole(matrix(batch.column(0), dim))
            yield 0, np.concatenate([np.full((2, 1), len(x)), _halves(x).sum(axis=1)], axis=1)

    total = summed(vectors, (2, dim + 1), np.int64, sums).get(0)
    if total is None:
        return 0, np.zeros(dim, np.int64), [0] * dim, np.zeros((dim, dim))
    n, x_sums = int(total[0, 0]), _joined(total[:, 1:])
    centre = [(2 * s + n) // (2 * n) for s in x_sums]
    rest = [s - n * c for s, c in zip(x_sums, centre)]
    middle, pairs = np.array(centre, np.int64), list(combinations_with_replacement(range(3), 2))

    def scatter(batches):
        held = {}
        for batch in batches:
            moved = _whole(matrix(batch.column(0), dim)) - middle
            for lo in range(0, len(moved), _ROWS):
                limbs = _limbs(moved[lo : lo + _ROWS])
                there = [limb.any() for limb in limbs]
                for k, (a, b) in enumerate(pairs):
                    if there[a] and there[b]:
                        held[k] = held.get(k, 0) + _halves((limbs[a].T @ limbs[b]).astype(np.int64))
        yield from held.items()

    exact = np.zeros((dim, dim), object)
    for k, part in summed(vectors, (2, dim, dim), np.int64, scatter).items():
        (a, b), whole = pairs[k], _joined(part)
        exact = exact + (whole if a == b else whole + whole.T) * (1 << (_LIMB * (a + b)))
    left = np.array(rest, object)
    exact = exact * n - np.outer(left, left)
    return n, middle, rest, np.array([[value / (n * n) for value in line] for line in exact], np.float64).reshape(dim, dim)


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with L L^T = scatter and as many columns as the rank; triangular but for the order of its rows."""
    left, factor = scatter.astype(np.float64), []
    # What is left of a dimension's own variance when it depends on the others; a smaller scale is no reason to drop it.
    floor = 8 * np.finfo(float).eps * len(scatter) * scatter.diagonal()
    for _ in range(len(scatter)):
        open_ = np.where(left.diagonal() > floor, left.diagonal(), 0.0)
        pivot = int(np.argmax(open_))
        if not open_[pivot]:
            break
        column = left[:, pivot] / np.sqrt(left[pivot, pivot])
        factor.append(column)
        left = left - np.outer(column, column)
        left[pivot], left[:, pivot] = 0.0, 0.0
    return np.array(factor, np.float64).reshape(len(factor), len(scatter)).T


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of factor factor^T, largest entry positive."""
    g = factor.copy()
    rank = g.shape[1]
    n = rank + rank % 2
    ring = list(range(n))
    tolerance = np.finfo(float).eps * 4
    for _ in range(sweeps):
        rotated = False
        for _ in range(n - 1):  # each round pairs every column with another one, a sweep all with all
            p, q = np.array([(a, b) for a, b in zip(ring[: n // 2], ring[: n // 2 - 1 : -1]) if max(a, b) < rank], np.int64).reshape(-1, 2).T
            ring = [ring[0], ring[-1], *ring[1:-1]]
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            off = np.abs(ab) > tolerance * np.sqrt(aa * bb)
            if not off.any():
                continue
            rotated = True
            p, q, a, b, aa, bb, ab = p[off], q[off], a[:, off], b[:, off], aa[off], bb[off], ab[off]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, p], g[:, q] = c * a - s * b, s * a + c * b
        if not rotated:
            break
    norms = np.sqrt((g * g).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    vectors = (g[:, order] / norms[order]).T
    signs = np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)) if rank else 1.0
    return norms[order] ** 2, vectors * signs


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening:
    """The model of all rows of a table that ``usable`` has passed."""
    n, centre, rest, scatter = covariance(rows, vector)
    values, vectors = one_sided_jacobi(pivoted_cholesky(scatter))
    values, vectors = values[:components], vectors[:components]
    trace = float(np.trace(scatter))
    return Whitening(n, len(centre), centre, rest, vectors, values, values / trace if trace else values)


def with_whitened(rows: DataFrame, model: Whitening, vector: str) -> tuple[DataFrame, str, str]:
    """The rows with their whitened entries (array<double>) and exact deviation (decimal, null beyond 38 digits).

    Also returns the names of the two columns, which give way to columns of the same name.
    """
    white = free_name("whitened", rows.columns)
    deviation = free_name("deviation", [*rows.columns, white])
    at, names = rows.columns.index(vector), [*rows.columns, white, deviation]
    digits, kind = 10**38, pa.decimal128(38, 0)

    def run(batches):
        for batch in batches:
            moved = model.whole(matrix(batch.column(at), model.dim))
            flat = pa.array(model.project(moved).ravel())
            width = len(model.components)
            exact = [decimal.Decimal(v) if v < digits else None for v in model.deviations(moved)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(moved) + 1) * width, pa.int32()), flat), pa.array(exact, kind)],
                names=names)

    small_batches(rows.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{white}` array<double>", f"`{deviation}` decimal(38,0)"])
    return rows.mapInArrow(run, schema), white, deviation


def identity_error(rows: DataFrame, model: Whitening, vector: str) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; 0 without components."""
    width = len(model.components)
    vectors = rows.select(F.col(vector).cast("array<double>").alias("v"))

    def moments(batches):
        total, seen = np.zeros((width + 1, width)), False
        for batch in batches:
            made = model.project(model.whole(matrix(batch.column(0), model.dim)))
            total += np.concatenate([made.T @ made, made.sum(axis=0)[None]])
            seen = True
        if seen:
            yield 0, total

    if not width:
        return 0.0
    total = summed(vectors, (width + 1, width), np.float64, moments)[0] / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(width)).max())


def whitened_rows(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    known = usable(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")), "v")
    model = fit(known, "v")
    error = identity_error(known, model, "v")
    made, white, deviation = with_whitened(known, model, "v")
    shares = F.array(*(F.lit(float(x)) for x in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    return made.select("vec_id", deviation, F.posexplode(white).alias("pos", "whitened")).select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col(deviation).alias("deviation"),
        "whitened", F.element_at(shares, F.col("pos") + 1).alias("explained"), F.lit(error).alias("identity_error"))
