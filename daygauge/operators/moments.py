"""Means and cross-products of many columns by group, as one small matrix per task and group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.operators.daily import keys

#: Numbers a task holds over all groups before it sends its matrices on.
HELD = 1 << 22

Moments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # count, mean, sum of squares and of products about the means


def block_moments(x: np.ndarray, pairwise: bool) -> Moments:
    """Moments of the rows of a matrix, NaN for what is missing.

    Complete rows: shapes (1, 1), (k, 1), (k, 1), (k, k). Pairwise: all (k, k), those of column i over the rows that have column j.
    Columns are moved by a value of their own first, so a constant one has moments of exactly zero.
    """
    have = ~np.isnan(x)
    first = x[have.argmax(axis=0), np.arange(x.shape[1])]
    first = np.where(np.isnan(first), 0.0, first)
    z = np.where(have, x - first, 0.0)
    some = have.sum(axis=0)
    middle = z.sum(axis=0) / np.maximum(some, 1)
    z = np.where(have, z - middle, 0.0)
    if not pairwise:
        return np.array([[float(len(x))]]), (first + middle)[:, None], (z * z).sum(axis=0)[:, None], z.T @ z
    w = have.astype(np.float64)
    n = w.T @ w
    s = z.T @ w
    share = s / np.maximum(n, 1)
    return n, np.where(n > 0, (first + middle)[:, None] + share, 0.0), np.maximum((z * z).T @ w - s * share, 0.0), z.T @ z - s * share.T


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of two sets of rows from those of each."""
    n = a[0] + b[0]
    part = b[0] / np.maximum(n, 1)
    step = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + step * part, b[1])
    both = a[0] * part
    return n, mean, a[2] + b[2] + step * step * both, a[3] + b[3] + step * step.T * both


def _packed(m: Moments) -> bytes:
    return np.concatenate([part.ravel() for part in m]).tobytes()


def _unpacked(data: bytes, k: int, pairwise: bool) -> Moments:
    shapes = [(k, k)] * 4 if pairwise else [(1, 1), (k, 1), (k, 1), (k, k)]
    parts = np.split(np.frombuffer(data), np.cumsum([a * b for a, b in shapes])[:-1])
    return tuple(p.reshape(s) for p, s in zip(parts, shapes, strict=True))


def group_rows(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(values of the key columns, rows) for each group of a batch; null is a value."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in by:
        own = batch.column(c).dictionary_encode(null_encoding="encode")
        code = np.unique(code, return_inverse=True)[1] * (len(own.dictionary) + 1) + own.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(rows):
            yield tuple(batch.column(c)[int(rows[0])].as_py() for c in by), rows


def moments(df: DataFrame, columns: Sequence[str], finish: Callable[[Moments], list[pa.Array]], added: str, *, series=None,
            pairwise: bool = False) -> DataFrame:
    """The series with the columns ``added``, which ``finish`` makes from the moments of each group: one row or several.

    Without ``pairwise`` only rows count that lack none of the columns. A task makes one matrix for each of its groups, by matrix
    products over Arrow batches. Only these are shuffled, so a group that holds most rows costs a matrix a task, and they are merged
    by count and mean. A group without rows has none in the result.
    """
    by, columns = keys(series), list(columns)
    rows = (df if pairwise else df.dropna(subset=columns)).select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    k = len(columns)
    fields = [f for f in rows.schema.fields if f.name in by]
    parts = T.StructType([*fields, T.StructField("data", T.BinaryType())])
    result = T.StructType([*fields, *T.StructType.fromDDL(added).fields])

    def gather(it: Iterator[pa.RecordBatch], of, out) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        types: list[pa.DataType] = []
        for batch in it:
            types = [batch.schema.field(c).type for c in by]
            for key, own in of(batch):
                held[key] = merged(held[key], own) if key in held else own
            if out is packed and len(held) * k * k > HELD:
                yield from out(held, types)
                held.clear()
        if held:
            yield from out(held, types)

    def packed(held: dict[tuple, Moments], types: list[pa.DataType]):
        values = zip(*held, strict=True) if by else []
        arrays = [pa.array(list(v), t) for v, t in zip(values, types, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([_packed(m) for m in held.values()], pa.binary())], names=[*by, "data"])

    def finished(held: dict[tuple, Moments], types: list[pa.DataType]):
        for key, own in held.items():
            out = finish(own)
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(out[0]), t) for v, t in zip(key, types, strict=True)), *out], names=result.names)

    def of_rows(batch: pa.RecordBatch):
        if batch.num_rows:
            x = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(k)])
            for key, own in group_rows(batch, by):
                yield key, block_moments(x[own], pairwise)

    def of_parts(batch: pa.RecordBatch):
        stored = batch.column("data").to_pylist()
        for key, own in group_rows(batch, by):
            for r in own:
                yield key, _unpacked(stored[r], k, pairwise)

    partial = rows.mapInArrow(lambda it: gather(it, of_rows, packed), parts)
    dealt = partial.repartition(*by) if by else partial.repartition(1)
    return dealt.mapInArrow(lambda it: gather(it, of_parts, finished), result)


def complete_moments(df: DataFrame, columns: Sequence[str], *, series=None) -> DataFrame:
    """One row per series over its complete rows: n, means, and the upper triangle of the centred cross-products / n."""
    upper = np.triu_indices(len(columns))

    def finish(m: Moments) -> list[pa.Array]:
        n = m[0][0, 0]
        return [pa.array([int(n)], pa.int64()), pa.array([m[1].ravel()], pa.list_(pa.float64())), pa.array([m[3][upper] / n], pa.list_(pa.float64()))]

    return moments(df, columns, finish, "n long, means array<double>, cross array<double>", series=series)


def pair_correlations(df: DataFrame, columns: Sequence[str], *, series=None) -> DataFrame:
    """(series..., col_a, col_b, r, n) for each pair of columns over the rows that have both; r is NULL if one is constant there."""
    left, right = np.triu_indices(len(columns), 1)
    names = np.array(list(columns))

    def finish(m: Moments) -> list[pa.Array]:
        n, _, squares, products = m
        width = np.sqrt(squares[left, right]) * np.sqrt(squares[right, left])
        r = np.where(width > 0, products[left, right] / np.where(width > 0, width, 1.0), np.nan)
        return [pa.array(names[left]), pa.array(names[right]), pa.array(r, mask=np.isnan(r)), pa.array(n[left, right].astype(np.int64))]

    return moments(df, columns, finish, "col_a string, col_b string, r double, n long", series=series, pairwise=True)
