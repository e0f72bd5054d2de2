"""What several operators of this package share: tables, written intermediate results, row numbers, bounded training rows."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.session import scratch_path, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor cannot change its rows."""
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: Sequence[str], column: str = "row") -> DataFrame:
    """``df`` with ``column``, the position from 0 in the order of ``keys`` (equal rows in any order; nulls first).

    Rows are placed by range with a tie-breaker, so rows that share a key spread over tasks. The window sees one row per
    partition. Both passes read written tables, so a number once given stays.
    """
    tie, part, at, n, start = (free_name(df, name) for name in ("_tie", "_part", "_at", "_n", "_start"))
    base = written(df.withColumn(tie, F.monotonically_increasing_id()), "tied")
    place = [*keys, tie]
    placed = written(
        base.repartitionByRange(partitions(df.sparkSession), *place).sortWithinPartitions(*place)
        .withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()})
        .withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias(n)).select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    return placed.join(starts, part).withColumn(column, F.col(start) + F.col(at)).drop(part, at, start, tie)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows no label is learned from; a null id counts as held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Texts with their label: for each class at most ``per_class`` rows that are not held out, chosen by a hash of the id.

    The chosen ids are bounded by the parameter and broadcast. An id that stands in several rows gives one, the text of the smallest
    hash, so it weighs as much as any other; tasks reduce their rows of an id to one before the shuffle.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    order = F.md5(F.col("doc_id").cast("string")), F.col("doc_id")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_y") == value).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return (rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_row"), F.max("_y").alias("_y"))
            .select("doc_id", F.col("_row.text").alias("text"), "_y"))


def schema_with(df: DataFrame, *added: tuple[str, T.DataType], without: Sequence[str] = ()) -> T.StructType:
    """The schema of ``df`` without some columns and with others at its end."""
    return T.StructType([f for f in df.schema if f.name not in without] + [T.StructField(name, kind) for name, kind in added])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as the table has such a column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A mapInArrow function from one on single batches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return run


def constants(seed: int, n: int) -> list[int]:
    """n odd multipliers or keys below 2**30, the same for the same seed."""
    rng = random.Random(seed)
    return [rng.randrange(1 << 28, 1 << 30) | 1 for _ in range(n)]


def sql_bytes(text: str) -> str:
    """DuckDB: the UTF-8 bytes of a text as a list of integers."""
    return f"(SELECT list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) FROM (SELECT hex(encode({text})) AS h))"


def sql_crc32(data: str) -> str:
    """DuckDB: CRC-32 of a list of bytes."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    rest = f"list_reduce({data}, lambda c, b: xor(c >> 8, (([{', '.join(map(str, entries))}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    return f"xor({rest}, 4294967295::BIGINT)"


def doubtful_keys(docs: DataFrame, key: str) -> bool:
    """Whether a key is null or stands in several rows."""
    counts = docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counts.where("n > 1 OR key IS NULL").limit(1).count() > 0


def identified(docs: DataFrame, key: str, text: str, column: str = "_rid", doubtful: bool | None = None) -> DataFrame:
    """``docs`` with a long that orders documents: the key where it is whole and unique, else a dense number by (key, hash of text).

    Rows that agree in key and text are one document and share the number. A null key comes first. ``doubtful`` is what
    ``doubtful_keys`` has said, if it was asked before.
    """
    if not (doubtful_keys(docs, key) if doubtful is None else doubtful):
        return docs.withColumn(column, F.col(key).cast("bigint"))
    hashed, k, h = (free_name(docs, name) for name in ("_id_hash", "_id_key", "_id_of"))
    tied = docs.withColumn(hashed, F.xxhash64(text))
    numbers = numbered(tied.select(F.col(key).alias(k), F.col(hashed).alias(h)).distinct(), [k, h], column)
    return tied.join(numbers, F.col(key).eqNullSafe(F.col(k)) & (F.col(hashed) == F.col(h))).drop(k, h, hashed)
