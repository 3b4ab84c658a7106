"""Whitening of embeddings by contour integration (FEAST).

Entries become whole numbers, so that sums, centred products and deviations are exact whatever the order of rows. Eigenpairs of
the covariance V are computed interval by interval. The number of eigenvalues above a shift is the number of positive pivots
of V - shift I (its inertia); shifts are tried until the wanted eigenvalues lie in intervals of a few each. For an interval, the
projection on its eigenvectors is the integral of (z - V)^-1 over a circle through its ends: a quadrature over points of the
circle, each a solve with a complex shifted covariance in a task of its own. A Rayleigh-Ritz step extracts eigenpairs from the
projected block, which goes into the next round. A round is the last one when every interval has as many exact pairs as its inertia
says. What the driver and every task hold is the covariance, whose size is the square of the vectors' length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from widesift.session import cut_lineage

SCALE = 1024
BASE = 100_000
#: points of the half circle, eigenvalues of an interval aimed at, parts into which an interval is cut, rounds at most
POINTS = 8
FEW = 4
PARTS = 16
ROUNDS = 40
#: eigenvalues below this part of the trace count as zero, intervals below it as single points
ZERO = 1e-12
#: largest residual of an exact pair, as a part of the trace
EXACT = 4e-15
#: in double precision, whole numbers up to here add up exactly
WHOLE = 1 << 53


@dataclass(frozen=True)
class Fit:
    """What the vectors of the fit list say: their number, sums by dimension, eigenpairs by falling eigenvalue."""

    n: int
    sums: list[int]  # of x - BASE
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a column for each eigenvalue

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def usable(vector: Column) -> Column:
    """Not null, and every entry a finite number that a long can hold 1024 times."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(2 ** 52), F.lit(False))), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 c) of every entry, a row for each vector; a shorter vector is filled up with zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = np.floor(SCALE * np.asarray(column.flatten(), np.float64)).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    found = np.zeros((len(column), dims), np.int64)
    found[np.arange(dims) < lengths[:, None]] = flat
    return found


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and sums of x - BASE by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            sums += (x if _largest(x) * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(n), *map(str, sums)], pa.string())], ["at", "total"])

    cells = rows.select("vector").mapInArrow(run, "at int, total string")
    found = {r.at: int(r.total) for r in cells.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def _covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """With divisor n: exact sums of products around the rounded means, set right by what the rounding left over."""
    dims = len(sums)
    means = [(2 * s + n) // (2 * n) for s in sums]
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros(len(i), object), np.array(means, np.int64)
        for batch in batches:
            y = _matrix(batch.column(0), dims) - middle
            whole = _largest(y) ** 2 * len(y) < WHOLE
            y = y.astype(np.float64 if whole else object)
            products = (y.T @ y)[i, j]
            total += products.astype(np.int64).astype(object) if whole else products
        yield pa.RecordBatch.from_arrays([pa.array(range(len(i)), pa.int64()), pa.array(map(str, total), pa.string())], ["at", "total"])

    cells = rows.select("vector").mapInArrow(run, "at bigint, total string")
    left = [s - n * m for s, m in zip(sums, means)]
    found = np.zeros((dims, dims))
    for r in cells.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        a, b = i[r.at], j[r.at]
        found[a, b] = found[b, a] = (n * int(r.total) - left[a] * left[b]) / (n * n)
    return found


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above `shift`: positive pivots of an L D L' factorisation with pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[p] >= 0.6404 * off[r, s]:  # (1 + sqrt(17)) / 8 bounds the growth of entries
            if diagonal[p] == 0:
                return count
            rest = np.delete(np.arange(len(a)), p)
            count += bool(a[p, p] > 0)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:  # two rows at once: one positive and one negative eigenvalue
            pair, rest = [r, s], np.delete(np.arange(len(a)), [r, s])
            count += 1
            column = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - column @ np.linalg.solve(a[np.ix_(pair, pair)], column.T)
    return count


def _in_tasks(spark: SparkSession, rows: list[tuple], schema: str, function: Callable, result: str) -> DataFrame:
    """A task for each row."""
    frame = spark.createDataFrame(rows, schema).repartition(len(rows))
    return frame.mapInPandas(lambda frames: (function(f) for f in frames), result)


def intervals(spark: SparkSession, shared, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint (low, high, eigenvalues in it), falling, that hold the `wanted` largest eigenvalues of a matrix of trace one."""
    def counts(shifts: list[float]) -> dict[float, int]:
        count = lambda f: f.assign(n=[above(shared.value, s) for s in f["shift"]])
        return {r["shift"]: r.n for r in _in_tasks(spark, [(s,) for s in shifts], "shift double", count, "shift double, n int").collect()}

    top = 1 + 1e-9
    known = {ZERO: counts([ZERO])[ZERO], top: 0}
    wanted = min(wanted, known[ZERO])
    while True:
        ends = sorted(known, reverse=True)
        found = [(low, high, known[low] - known[high]) for high, low in zip(ends, ends[1:]) if known[low] > known[high] and known[high] < wanted]
        wide = [(low, high) for low, high, n in found if n > FEW and high - low > 1e3 * ZERO * (1 + high)]
        if not wide:
            return found
        # the parts grow by a constant factor, as eigenvalues may lie orders of magnitude apart
        known |= counts([s for low, high in wide for s in np.geomspace(low, high, PARTS + 1)[1:-1].tolist()])


def eigenpairs(spark: SparkSession, matrix: np.ndarray, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric, not negative matrix of trace one and unit eigenvectors in columns.

    There are fewer than `wanted` where the others are below `ZERO`. The largest entry of a vector is positive. Raises
    an error if some pair inside an interval is not found, which the intervals' inertia tells.
    """
    dims = len(matrix)
    shared = spark.sparkContext.broadcast(matrix)
    slices = intervals(spark, shared, wanted)
    places, weights = np.polynomial.legendre.leggauss(POINTS)
    rng = np.random.default_rng(seed)
    blocks = {k: rng.standard_normal((dims, min(dims, 2 * n + FEW))) for k, (_, _, n) in enumerate(slices)}
    pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        """One point of a circle: its part of the integral."""
        found = []
        for low, high, place, weight, block in zip(frame.low, frame.high, frame.place, frame.weight, frame.block):
            turn = (high - low) / 2 * np.exp(1j * np.pi / 2 * (1 + place))
            y = np.frombuffer(block).reshape(dims, -1)
            part = np.linalg.solve(((high + low) / 2 + turn) * np.eye(dims) - shared.value, turn * y)
            found.append((weight / 2 * part.real).tobytes())
        return frame[["k", "low", "high", "point"]].assign(part=found)

    def extracted(frame: pd.DataFrame) -> pd.DataFrame:
        """Rayleigh-Ritz on the projected block of an interval."""
        frame = frame.sort_values("point")
        q = np.linalg.qr(sum(np.frombuffer(b).reshape(dims, -1) for b in frame.part))[0]
        values, inner = np.linalg.eigh(q.T @ shared.value @ q)
        x = q @ inner
        misses = np.linalg.norm(shared.value @ x - x * values, axis=0)
        inside = (values > frame.low[0]) & (values <= frame.high[0])
        return pd.DataFrame({"k": frame.k[:1], "block": [x.tobytes()], "vals": [values.tolist()], "inside": [inside.tolist()], "misses": [misses.tolist()]})

    for _ in range(ROUNDS):
        rows = [(k, float(slices[k][0]), float(slices[k][1]), p, float(places[p]), float(weights[p]), blocks[k].tobytes())
                for k in blocks if k not in pairs for p in range(POINTS)]
        if not rows:
            break
        parts = _in_tasks(spark, rows, "k int, low double, high double, point int, place double, weight double, block binary", solved,
                          "k int, low double, high double, point int, part binary")
        for r in parts.groupBy("k").applyInPandas(extracted, "k int, block binary, vals array<double>, inside array<boolean>, misses array<double>").collect():
            blocks[r.k] = np.frombuffer(r.block).reshape(dims, -1).copy()
            exact = np.array(r.inside) & (np.array(r.misses) <= EXACT)
            if exact.sum() == slices[r.k][2]:
                pairs[r.k] = np.array(r.vals)[exact], blocks[r.k][:, exact]
    shared.destroy()
    if len(pairs) < len(blocks):
        raise ArithmeticError("an interval holds eigenvalues that were not found")
    if not pairs:
        return np.zeros(0), np.zeros((dims, 0))
    values = np.concatenate([pairs[k][0] for k in sorted(pairs)])
    vectors = np.concatenate([pairs[k][1] for k in sorted(pairs)], axis=1)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * signs / np.linalg.norm(vectors, axis=0)


def fit(vectors: DataFrame, wanted: int = 8, vector_col: str = "embedding") -> Fit | None:
    """Sums, covariance and eigenpairs of all usable vectors; None where there is no vector or no variance."""
    rows = vectors.select(F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if not dims:
        return None
    n, sums = _sums(rows, dims)
    covariance = _covariance(rows, n, sums)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return None
    values, components = eigenpairs(vectors.sparkSession, covariance / trace, wanted)
    return Fit(n, sums, trace, values * trace, components)


def whiten(vectors: DataFrame, fitted: Fit, vector_col: str = "embedding", key_col: str = "vec_id") -> DataFrame:
    """(key_col, deviation, whitened) for every usable vector.

    An entry c stands for x = floor(1024 c) + 100000. `deviation` is the exact sum over dimensions of (n x - sum of x)^2, null where a
    long cannot hold it; `whitened` has the centred vector's projection on every component over the root of its eigenvalue.
    """
    n, sums, values, components = fitted.n, fitted.sums, fitted.values, fitted.vectors
    dims, kind = len(sums), vectors.schema[key_col].dataType.simpleString()
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    left = [s - n * int(m) for s, m in zip(sums, middle)]
    weights = components / np.sqrt(values)
    shift = np.array([v / n for v in left])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), dims) - middle
            whole = ((_largest(y) + 1) * n) ** 2 * dims < 1 << 63
            away = y * n - np.array(left, np.int64) if whole else y.astype(object) * n - np.array(left, object)
            deviation = [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]
            projected = (y - shift) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(projected), pa.list_(pa.float64()))],
                                             ["key", "deviation", "whitened"])

    rows = vectors.select(F.col(key_col).alias("key"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    found = rows.mapInArrow(run, f"key {kind}, deviation bigint, whitened array<double>")
    return found.withColumnRenamed("key", key_col)


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity."""
    cell = lambda i, j: F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j))
    cells = [cell(i, j) for i in range(components) for j in range(i + 1)]
    return whitened.agg(reduce(lambda x, y: F.greatest(x, y), cells)).first()[0] if len(cells) > 1 else whitened.agg(cells[0]).first()[0]


def whitened_components(vectors: DataFrame, wanted: int = 8, vector_col: str = "embedding", key_col: str = "vec_id") -> DataFrame:
    """(key_col, component, n, deviation, whitened, explained, identity_error): a row for every usable vector and component.

    Vectors that are null or hold null or non-finite entries, or numbers beyond the longs, are left out. A vector shorter than
    the longest one counts as filled up with zeros. Components are numbered from 1 by falling eigenvalue; those without
    variance are left out, so that equal vectors, a single one or an empty table give no row. Rows with equal keys or vectors
    are rows of their own; extra columns are ignored, whatever their names.
    """
    kind = vectors.schema[key_col].dataType.simpleString()
    fitted = fit(vectors, wanted, vector_col)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], f"{key_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    rows = cut_lineage(whiten(vectors, fitted, vector_col, key_col))
    error = identity_error(rows, len(fitted.values))
    explained = F.array(*map(F.lit, fitted.explained))
    flat = rows.select(key_col, "deviation", F.posexplode("whitened").alias("at", "value"))
    return flat.select(key_col, (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", F.col("value").alias("whitened"),
                       explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
