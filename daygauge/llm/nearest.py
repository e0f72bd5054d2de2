"""Nearest neighbours by vantage-point trees, one per shard."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygauge.llm.common import query, table, written

#: Vectors of a shard on average, queries of a block, vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 1024, 128
#: Share of the triangle inequality's slack that is believed; 1 never leaves out a neighbour.
FACTOR = 0.5


class VantageTree:
    """A balanced tree by Euclidean distance over row vectors of one length, whose last component makes it so; ``search`` walks it for
    many queries at once. ``ids`` decide between points of equal inner product.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, square: float):
        self.order = np.arange(len(points))
        self.points, self.square = points, square
        self.nodes: list[tuple] = []
        self._build(0, len(points))
        self.plain, self.ids = np.ascontiguousarray(points[self.order, :-1]), ids[self.order]

    def _build(self, low: int, high: int) -> int:
        number = len(self.nodes)
        self.nodes.append((low, high))
        if high - low <= LEAF:
            return number
        own = self.order[low:high]
        middle = self.points[own].mean(axis=0)
        vantage = self.points[own[np.argmax(((self.points[own] - middle) ** 2).sum(axis=1))]]
        distance = np.sqrt(np.maximum(((self.points[own] - vantage) ** 2).sum(axis=1), 0.0))
        half = len(own) // 2
        rank = np.argpartition(distance, half)
        self.order[low:high] = own[rank]
        near, far = distance[rank[:half]], distance[rank[half:]]
        left = self._build(low, low + half)
        right = self._build(low + half, high)
        self.nodes[number] = (low, high, vantage, near.max(), far.min(), far.max(), left, right)
        return number

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Positions (in the order given to the tree, -1 for none) of the k points of largest inner product with each query; of equal
        products those of smallest id.

        A query, scaled to the length of the points, and the points lie on one sphere, so products are distances. A side of a node is
        left out if its distance from the query, by the triangle inequality, is over ``factor`` times the k-th best distance so far:
        with 1 the search is exact, below 1 more is left out.
        """
        best = np.full((len(queries), k), np.inf)  # products with their sign turned
        at = np.full((len(queries), k), -1)
        scale = np.sqrt(self.square) / np.linalg.norm(queries, axis=1)
        scaled = np.column_stack((queries * scale[:, None], np.zeros(len(queries))))
        unknown = np.iinfo(np.int64).max

        def leaf(low: int, high: int, rows: np.ndarray) -> None:
            products = -(queries[rows] @ self.plain[low:high].T)
            everything = np.concatenate((best[rows], products), axis=1)
            where = np.concatenate((at[rows], np.broadcast_to(np.arange(low, high), products.shape)), axis=1)
            chosen = np.argpartition(everything, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(everything, chosen, 1).max(axis=1)
            tied = np.flatnonzero(np.isfinite(last) & ((everything <= last[:, None]).sum(axis=1) > k))
            if len(tied):
                ids = np.where(where[tied] >= 0, self.ids[where[tied]], unknown)
                chosen[tied] = np.lexsort((ids, everything[tied]), axis=1)[:, :k]
            best[rows], at[rows] = np.take_along_axis(everything, chosen, 1), np.take_along_axis(where, chosen, 1)

        def visit(number: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            node = self.nodes[number]
            if len(node) == 2:
                leaf(*node, rows)
                return
            _, _, vantage, near_most, far_least, far_most, left, right = node
            d = np.sqrt(np.maximum(((scaled[rows] - vantage) ** 2).sum(axis=1), 0.0))
            inside = d <= (near_most + far_least) / 2
            visit(left, rows[inside])
            visit(right, rows[~inside])
            to_left, to_right = np.maximum(d - near_most, 0.0), np.maximum(np.maximum(far_least - d, d - far_most), 0.0)
            reach = factor * np.sqrt(np.maximum(2 * (self.square + scale[rows] * best[rows].max(axis=1)), 0.0)) + 1e-7 * np.sqrt(self.square)
            visit(left, rows[~inside & (to_left <= reach)])
            visit(right, rows[inside & (to_right <= reach)])

        visit(0, np.arange(len(queries)))
        return np.where(at >= 0, self.order[at], -1)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct ``(vec_id, v, d)`` of the vectors that take part: a key, finite components, not all zero; d is their number."""
    clean = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0))
    return written(clean.dropDuplicates(["vec_id", "v"]).withColumn("d", F.size("v")), "vectors")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for each row with a key divisible by ``every``.

    Inner products become distances by one more component, the root of what a vector's square lacks to the largest; the query has
    none there. Equal vectors are one point with their smallest keys (k + 1 of them, more can never be asked for), so thousands of
    copies cost one. Points are dealt to shards by hash; each shard gets a tree of all its points, queries visit every shard in
    blocks, and per query the best of all shards remain; of equal products the smaller key goes first. ``factor`` 1 gives the exact
    result, less leaves out subtrees sooner.

    Null, zero or non-finite vectors and null keys take no part; vectors of each length are searched among themselves; repeated rows
    count once; an empty table gives no rows.
    """
    points = usable(vectors, key, vector)
    found = None
    for r in sorted(points.groupBy("d").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).collect()):
        part = _nearest(points.where(F.col("d") == r["d"]), r["n"], r["square"], k, every, factor)
        found = part if found is None else found.unionAll(part)
    return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if found is None else found


def _nearest(points: DataFrame, count: int, square: float, k: int, every: int, factor: float) -> DataFrame:
    """``nearest`` for vectors of one length."""
    spark, top, keep = points.sparkSession, float(square), k + 1
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = (points.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep).groupBy("v")
                .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards, blocks = -(-count // SHARD_ROWS), -(-count // (every * BLOCK_ROWS))
    placed = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    asked = points.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def index(rows: pa.Table) -> pa.Table:
        v = _rows(rows["v"])
        longer = np.column_stack((v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))))
        ids = rows["ids"].combine_chunks()
        sizes = np.asarray(ids.value_lengths())
        return pa.table({"shard": rows["shard"][:1], "points": pa.array([_packed(v=longer, ids=np.asarray(ids.flatten()), sizes=sizes)], pa.binary())})

    def block(rows: pa.Table) -> pa.Table:
        return pa.table({"block": rows["block"][:1], "queries": pa.array([_packed(v=_rows(rows["v"]), ids=rows["vec_id"].to_numpy())], pa.binary())})

    trees = written(placed.groupBy("shard").applyInArrow(index, "shard int, points binary"), "vector-shards")
    queries = written(asked.groupBy("block").applyInArrow(block, "block int, queries binary"), "query-blocks")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, last = None, None
        for batch in it:
            for shard, stored, asked_ in zip(*(batch.column(i) for i in range(3)), strict=True):
                if shard.as_py() != last:
                    data = np.load(io.BytesIO(stored.as_py()))
                    last, ids, sizes, raw = shard.as_py(), data["ids"], data["sizes"], data["v"]
                    starts = np.cumsum(sizes) - sizes
                    tree = VantageTree(raw, ids[starts], top)
                q = np.load(io.BytesIO(asked_.as_py()))
                at = tree.search(q["v"], min(keep, len(raw)), factor)
                row, column = np.nonzero(at >= 0)
                point = at[row, column]
                score = (raw[point, :-1] * q["v"][row]).sum(axis=1)
                n = sizes[point]
                vec = ids[np.repeat(starts[point], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                who, score = np.repeat(q["ids"][row], n), np.repeat(score, n)
                other = who != vec
                who, vec, score = who[other], vec[other], score[other]
                order = np.lexsort((vec, -score, who))
                who = who[order]
                begins = np.flatnonzero(np.append(True, who[1:] != who[:-1])[:len(who)])
                place = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
                order = order[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(who[place < k]), pa.array(vec[order]), pa.array(score[order])],
                                                 names=["query_id", "vec_id", "score"])

    # A row holds a whole shard and a whole block, so few rows make a batch.
    pairs = (queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, "shard")
             .select("shard", "points", "queries"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "4")
    try:
        found = written(pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double"), "shard-neighbours")
    finally:
        spark.conf.set(setting, usual)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op4_nearest")
def op4_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
