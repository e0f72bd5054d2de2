"""Whitening of embeddings by eigenvectors refined in higher precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.llm.common import free_name, partitions, query, schema_with, table, written

#: The grid of the entries: x = floor(SCALE * c) + SHIFT. Fixed values.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this are no long on the grid.
LARGEST = float(1 << 56)
#: Variances below this share of the largest are rounding, not variance.
FLAT = 1e-13
#: Vectors taken at once inside a task.
ROWS = 4096


# ---------------------------------------------------------------- eigenvectors

def refine(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of Ogita and Aishima: (vectors, values, largest correction) for a symmetric matrix and nearly orthogonal vectors.

    Pairs of values closer than what the residuals can tell apart only have their orthogonality mended; ``split_clusters`` turns
    their vectors.
    """
    lack, form, values = residuals(matrix, vectors)
    limit = resolution(matrix, lack, form, values)
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > limit
    step = np.where(far, (form + values[None, :] * lack) / np.where(far, apart, 1), lack / 2)
    return vectors + vectors @ step, values, np.abs(step).max()


def residuals(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the vectors lack to be orthonormal, their quadratic form (both exactly symmetric), and their Rayleigh values."""
    lack = np.eye(len(matrix), dtype=matrix.dtype) - vectors.T @ vectors
    form = vectors.T @ (matrix @ vectors)
    lack, form = (lack + lack.T) / 2, (form + form.T) / 2
    return lack, form, np.diagonal(form) / (1 - np.diagonal(lack))


def orthonormal(vectors: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so to second order."""
    return vectors @ (1.5 * np.eye(vectors.shape[1], dtype=vectors.dtype) - 0.5 * (vectors.T @ vectors))


def resolution(matrix: np.ndarray, lack: np.ndarray, form: np.ndarray, values: np.ndarray):
    """Gaps of values up to this cannot be told apart by the residuals at hand (Frobenius norms bound the spectral ones)."""
    norm = lambda m: np.sqrt((m * m).sum())
    return 2 * (norm(form - np.diag(values)) + norm(matrix) * norm(lack))


def split_clusters(matrix: np.ndarray, vectors: np.ndarray, limit) -> np.ndarray:
    """Turn the vectors of each cluster of values within its space, by the eigenvectors of the shifted small matrix."""
    form = vectors.T @ (matrix @ vectors)
    values = np.diagonal(form) / (vectors * vectors).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > limit) + 1
    out = vectors.copy()
    for cluster in np.split(order, cuts):
        if len(cluster) < 2:
            continue
        own = orthonormal(vectors[:, cluster])
        middle = values[cluster].mean()
        small = own.T @ (matrix @ own) - middle * (own.T @ own)  # shifted, so small gaps are not lost beside large values
        scale = np.abs(small).max()
        if scale > 0:
            turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))[1][:, ::-1]
            out[:, cluster] = own @ turn.astype(matrix.dtype)
    return out


def eigenvectors(matrix: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors in columns) of a symmetric matrix by falling value, to double precision.

    float32 gives the start; refinement by matrix products runs in long double (where the machine has one, else double) until the
    correction is below double precision. A cluster of values that a step cannot tell apart is solved for itself, and refined again.
    """
    size = np.abs(matrix).max()
    if not size > 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    high = (matrix / size).astype(np.longdouble)
    high = (high + high.T) / 2
    vectors = np.linalg.eigh(high.astype(np.float32))[1].astype(np.longdouble)
    vectors = orthonormal(orthonormal(vectors))
    last = np.inf
    for _ in range(steps):
        vectors = split_clusters(high, vectors, resolution(high, *residuals(high, vectors)))
        vectors, values, change = refine(high, vectors)
        if change < 1e-17 or (change < 1e-15 and change >= last / 2):
            break
        last = change
    vectors = orthonormal(orthonormal(vectors))
    values = residuals(high, vectors)[2]
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    return (values[order] * size).astype(np.float64), vectors.astype(np.float64)


# ---------------------------------------------------------------- tables

def gridded(rows: DataFrame, vector: str, x: str, dims: str) -> DataFrame:
    """``rows`` whose vector holds only finite numbers, with its grid vector ``x`` (array of long) and its length ``dims``."""
    value = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    grid = F.transform(value, lambda c: F.floor(F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE).cast("bigint") + SHIFT)
    return rows.where(F.coalesce(whole, F.lit(False))).withColumn(x, grid).withColumn(dims, F.size(x))


def _blocks(batch: pa.RecordBatch, dims: int, column: str = "x") -> Iterator[np.ndarray]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.column(column).slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(vectors: DataFrame, partial: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """The sum over all vectors of a small matrix, made per block in tasks and added row by row in a few tasks; the driver gets the sum."""
    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            for block in _blocks(batch, dims):
                own = partial(block)
                total = own if total is None else total + own
        if total is not None:
            yield _rows(range(len(total)), total)

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in it:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                own = np.frombuffer(row, kind)
                totals[i] = totals[i] + own if i in totals else own
        if totals:
            yield _rows(totals, totals.values())

    def _rows(numbers, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["i", "row"])

    kind = partial(np.zeros((1, dims), np.int64)).dtype
    schema = "i int, row binary"
    found = (vectors.select("x").mapInArrow(parts, schema).repartition(min(partitions(vectors.sparkSession), dims), "i").mapInArrow(add, schema).collect())
    return np.array([np.frombuffer(r["row"], kind) for r in sorted(found)])


@dataclass
class Whitener:
    """What is fitted on distinct vectors of one length: their number, sums, components by falling variance, and how white they are."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as long where that is exact, else as Python integers."""
        middle = self.sums // self.n  # n * x - S is the same for x and S moved by a whole number
        moved, rest = x - middle.astype(np.int64), (self.sums - self.n * middle).astype(np.int64)
        if float(np.abs(moved).max(initial=0)) * self.n < float(1 << 62):
            return moved * np.int64(self.n) - rest
        return moved.astype(object) * self.n - rest.astype(object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        spread = np.sqrt(np.where(self.values > 0, self.values, 1.0))
        return np.where(self.values > 0, (self.centred(x) / self.n).astype(np.float64) @ self.vectors / spread, 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares; None where one is no long."""
        centred = self.centred(x)
        if centred.dtype != object and (centred.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < float(1 << 62):
            return (centred * centred).sum(axis=1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in centred.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitener:
    """Whitening of distinct vectors ``x`` of one length, in three passes: sums, centred covariance, covariance of the result.

    Tasks make one matrix each, and only their sum reaches the driver: bounded by the square of the length.
    """
    def count(block: np.ndarray) -> np.ndarray:  # in two parts, so that no sum leaves the longs
        return np.vstack([(block >> 32).sum(axis=0), (block & 0xFFFFFFFF).sum(axis=0), np.full(dims, len(block), np.int64)])

    upper, lower, numbers = _summed(vectors, count, dims)
    n, sums = int(numbers[0]), upper.astype(object) * (1 << 32) + lower.astype(object)
    whitener = Whitener(n, sums, np.zeros(0), np.zeros((dims, 0)), np.zeros(0), 0.0)

    def gram(block: np.ndarray) -> np.ndarray:
        centred = (whitener.centred(block) / n).astype(np.float64)
        return centred.T @ centred

    covariance = _summed(vectors, gram, dims) / n
    values, own = eigenvectors(covariance)
    kept = min(components, dims)
    trace = float(np.trace(covariance))
    # A direction without variance has nothing to be scaled: its component is 0 in every row.
    values = np.where(values > FLAT * max(values[0], 0.0), values, 0.0)[:kept]
    whitener.values, whitener.vectors = values, own[:, :kept]
    whitener.explained = values / trace if trace > 0 else np.zeros(kept)
    white = (values > 0).astype(np.float64)

    def result(block: np.ndarray) -> np.ndarray:
        out = whitener.whitened(block)
        return out.T @ out

    whitener.identity_error = float(np.abs(_summed(vectors, result, dims) / n - np.diag(white)).max(initial=0.0))
    return whitener


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out. Entries become longs on a grid; the fit counts each
    distinct grid vector once. The covariance is summed from centred products in tasks; its eigenvectors start in float32 and are
    refined by matrix products in higher precision, clusters of values by sub-solves. Vectors of each length are whitened for
    themselves, those of length 0 give no rows. A component without variance is 0 and explains 0, and identity_error is taken over the
    others; a deviation that is no long is null. Entries beyond 2**56 count as that. Repeated rows come out each; columns of ``rows``
    with the names of the result are replaced; an empty table gives no rows.
    """
    added = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
             ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    names = [name for name, _ in added]
    rows = rows.drop(*[n for n in names if n != vector])
    grid = free_name(rows, "_grid")
    dims_ = free_name(rows, "_dims")
    base = gridded(rows, vector, grid, dims_).where(F.col(dims_) > 0)
    distinct = written(base.select(F.col(dims_).alias("dims"), F.col(grid).alias("x")).distinct(), "distinct-vectors")
    lengths = sorted(r["dims"] for r in distinct.select("dims").distinct().collect())
    fits = {dims: fit(distinct.where(F.col("dims") == dims), dims, components) for dims in lengths}
    carried = [c for c in rows.columns if c not in names]
    schema = schema_with(rows.select(*carried), *added)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                some = whole.slice(at, ROWS)
                of = some.column(dims_).to_numpy()
                for dims in np.unique(of):
                    own, batch = fits[int(dims)], some.take(pa.array(np.flatnonzero(of == dims)))
                    x = batch.column(grid).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    out = own.whitened(x)
                    m, k = out.shape
                    again = pa.array(np.repeat(np.arange(m), k))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(again) for c in carried), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                         pa.array(np.full(m * k, own.n)), pa.array(own.deviations(x), pa.int64()).take(again), pa.array(out.ravel()),
                         pa.array(np.tile(own.explained, m)), pa.array(np.full(m * k, own.identity_error))], names=[*carried, *names])

    return base.select(*carried, grid, dims_).mapInArrow(run, schema)


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")
