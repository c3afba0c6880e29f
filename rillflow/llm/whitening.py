"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are never gathered. A pass over them sums the Gram matrix of their current basis, its Cholesky factor
is the next triangular factor, and later passes see the rows through triangular solves with all factors so far: the
first pass shifts the matrix, so that ill-conditioned rows have a factor at all, and two more make the basis orthogonal
to rounding. The product R of the factors has the singular values and right singular vectors of A, so the SVD of this
small matrix gives the components. The driver holds d x d numbers and sums of d numbers, for d dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.plans.workspace import materialize

#: Entries become the whole numbers floor(GRID * c) + SHIFT.
GRID, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: One shifted pass, and two that restore orthogonality.
PASSES = 3
#: Entries beyond this do not fit a whole number of the grid exactly; their rows count as not finite.
LIMIT = float(1 << 53) / GRID
#: Singular values below this share of the largest are rounding: their directions do not vary.
RANK = 1e-12


def grid_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the vectors as whole numbers.

    Rows go whose vector is null, empty, or holds null, non-finite entries or such beyond 2 ** 47. Vectors of another
    length than the most frequent one (the longer of equals) have no place in the matrix and go too.
    """
    entries = F.col("v")
    good = F.forall(entries, lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)) & ~F.isnan(c))
    rows = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(good)
    x = F.transform(entries, lambda c: F.floor(c * GRID).cast("long") + SHIFT)
    return rows.select("key", x.alias("x"))


def of_one_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the most frequent length, and that length; 0 if there are none."""
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = lengths.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    return (vectors.where(F.lit(False)), 0) if best is None else (vectors.where(F.size("x") == best["d"]), best["d"])


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: n, the sums of the fit list, components as columns, their eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are taken off exactly before anything is rounded."""
        quotients, rests = self.split()
        return (x - quotients).astype(np.float64) - rests.astype(np.float64) / self.n

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """S as n * quotients + rests."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2 in whole numbers; None where it does not fit a long."""
        quotients, rests = self.split()
        y = x - quotients
        reach = max(int(np.abs(y).max(initial=0)), 1)
        if reach * reach * y.shape[1] >= 1 << 62 or reach * self.n * y.shape[1] >= 1 << 62:
            y, rests = y.astype(object), rests.astype(object)
        squares, products = (y * y).sum(axis=1), (y * rests).sum(axis=1)
        fixed = sum(int(r) ** 2 for r in rests)
        sums = (self.n * self.n * int(s) - 2 * self.n * int(p) + fixed for s, p in zip(squares, products, strict=True))
        return [s if s < 1 << 63 else None for s in sums]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The lists of a batch as rows; lists have d entries and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def gram(fit: DataFrame, d: int, seen: Callable[[np.ndarray], np.ndarray], size: int | None = None) -> np.ndarray:
    """The sum of v v' over the fit list, ``seen`` through a function from rows x to rows v; tasks send sums only.

    Partial matrices are added up by Spark, cell by cell, so the driver gets one.
    """
    size = size or d

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                v = seen(_matrix(batch.column(0), d))
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total))], ["i", "row"])

    rows = fit.select("x").mapInArrow(partial, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in cells.collect():  # size * size numbers
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def cholesky_qr(fit: DataFrame, n: int, d: int, centred: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, float]:
    """R of the centred rows A = Q R, d x d and upper triangular, and the trace of A'A.

    Each factor is that of the rows seen through the earlier ones. Where a direction does not vary, the later Gram
    matrices are singular too and take a shift of their own; the direction's singular value in R stays near zero.
    """
    factors: list[np.ndarray] = []
    trace = 0.0
    for turn in range(PASSES):

        def seen(x: np.ndarray, before: tuple[np.ndarray, ...] = tuple(factors)) -> np.ndarray:
            v = centred(x)
            for r in before:
                v = np.linalg.solve(r.T, v.T).T
            return v

        g = gram(fit, d, seen)
        if turn == 0:
            trace = float(np.trace(g))
            if trace == 0:
                return np.zeros((d, d)), 0.0
        shift = 11 * (float(n) * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.linalg.norm(g, 2))
        shift = min(shift, 1e-6 * float(np.linalg.norm(g, 2)))
        try:
            lower = np.linalg.cholesky(g if turn else g + shift * np.eye(d))
        except np.linalg.LinAlgError:
            lower = np.linalg.cholesky(g + shift * np.eye(d))
        factors.append(lower.T)
    r = factors[0]
    for factor in factors[1:]:
        r = factor @ r
    return r, trace


def column_sums(fit: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension; tasks send the sums of the upper and the lower bits."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), d)
                high += (x >> 26).sum(axis=0)
                low += (x & ((1 << 26) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], ["j", "high", "low"])

    parts = fit.select("x").mapInArrow(partial, "j int, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = parts.groupBy("j").agg(total("high"), total("low"))
    return [(int(r["high"]) << 26) + int(r["low"]) for r in sorted(sums.collect(), key=lambda r: r["j"])]


def fit_whitening(vectors: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors x (with all of them in a written table), None if they do not vary.

    At most ``components`` directions, and only those that vary: a direction without variance cannot be scaled to one.
    """
    fit = materialize(vectors.select("x").distinct(), "fit-vectors")
    n = fit.count()
    if n == 0:
        return None, fit
    empty = np.zeros((d, 0))
    still = Whitening(n, tuple(column_sums(fit, d)), empty, np.zeros(0), 0.0)
    r, trace = cholesky_qr(fit, n, d, still.centred)
    _, singular, right = np.linalg.svd(r)
    kept = min(components, int((singular > RANK * singular[0]).sum())) if trace else 0
    if kept == 0:
        return None, fit
    return Whitening(n, still.sums, right[:kept].T, singular[:kept] ** 2 / n, trace / n), fit


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity, measured in one pass."""
    k = len(model.eigenvalues)
    return float(np.abs(gram(fit, len(model.sums), model.whitened, k) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation, whitened): each vector's exact squared distance from the mean times n ** 2, and its coordinates.

    ``deviation`` is null where it does not fit a long. Keys pass as they are, null ones too.
    """
    d = len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d x components numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), d)
                columns = [batch.column(0), pa.array(shared.value.deviations(x), pa.int64()), pa.array(list(shared.value.whitened(x)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "deviation", "whitened"])

    key = vectors.schema["key"].dataType.simpleString()
    return vectors.select("key", "x").mapInArrow(each, f"key {key}, deviation long, whitened array<double>")


def whitened_components(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Vectors that :func:`grid_vectors` and :func:`of_one_length` leave out have no rows; repeated vectors and keys keep
    all of theirs, and each distinct vector weighs once in the fit. Components are numbered from 1 by falling variance;
    those without variance have no rows, so equal vectors, a single one or an empty table give an empty result. Other
    columns are not read.
    """
    vectors, d = of_one_length(grid_vectors(rows, vector, key))
    model, fit = fit_whitening(vectors, d, components)
    schema = f"key {vectors.schema['key'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    error = identity_error(fit, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    out = whiten(vectors, model).select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("key").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
