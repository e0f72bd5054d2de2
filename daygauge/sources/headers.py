"""An index of the headers of delimited files, made by tasks that stop after the first record, and scans that follow it."""

from __future__ import annotations

import codecs
import csv
import io
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygauge.session import durable

GLOB = "*.{csv,csv.gz}"
CHUNK = 1 << 16
#: A header ends within so many bytes, else the file has none (a quote that is never closed).
HEADER_BYTES = 1 << 22
#: Files opened by a task, and kinds of headers up to which each gets a scan of its own.
FILES_A_TASK, SCANS = 256, 64


def _list_by_few_tasks(spark: SparkSession) -> None:
    """A task lists many folders; by default each folder below a path is a task of its own."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))


def csv_reader(spark: SparkSession, encoding: str = "UTF-8", recursive: bool = True, multiline: bool = False):
    _list_by_few_tasks(spark)
    return (spark.read.option("encoding", encoding).option("recursiveFileLookup", recursive).option("escape", '"')
            .option("pathGlobFilter", GLOB).option("multiLine", multiline).option("ignoreCorruptFiles", True))


def text_files(spark: SparkSession, path, recursive: bool = True) -> list[str]:
    """The files below the path, from the file index that Spark's driver holds for any read; none if the path does not exist."""
    _list_by_few_tasks(spark)
    try:
        return spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", GLOB).text(path).inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def plain_name(column):
    """File names as both the index and a scan write them."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def _open(uri: str, compressed: bool = True):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression="detect" if compressed else None)


def _opens(uri: str) -> bool:
    """Whether Python can open files of this store; else only Spark's readers can."""
    try:
        _open(uri, False).close()
    except (OSError, ValueError, NotImplementedError, ImportError):
        return False
    return True


def leading_records(pieces: Iterable[str], stop: str | None = None, after: int = 0) -> list[list[str]] | None:
    """The first record that is not blank or, with ``stop``, all up to ``after`` records behind the one that begins with that cell.

    A record goes on over line breaks in quotes. None if the text, or its first HEADER_BYTES characters, has no such record.
    """
    held, last = "", False
    pieces = iter(pieces)
    while True:
        piece = next(pieces, None)
        last = piece is None
        held += piece or ""
        lines = io.StringIO(held.lstrip("﻿"), newline="")
        size, out, found = len(lines.getvalue()), [], None
        try:
            for record in csv.reader(lines):
                if not last and lines.tell() >= size:
                    break  # it may go on in the next piece
                if any(c.strip() for c in record) or len(record) > 1:
                    out.append(record)
                    if found is None and (stop is None or record[0].strip() == stop):
                        found = len(out)
                    if found is not None and len(out) >= found + after:
                        return out
        except csv.Error:
            return None
        if last or len(held) > HEADER_BYTES:
            return None


def _pieces(stream, encoding: str) -> Iterator[str]:
    decode = codecs.getincrementaldecoder(encoding)(errors="replace").decode
    while True:
        try:
            data = stream.read(CHUNK)
        except OSError:  # damaged: what came before it counts
            data = b""
        if not data:
            yield decode(b"", True)
            return
        yield decode(data)


def _header_task(encoding: str, stop: str | None, after: int):
    def run(it):
        import pyarrow as pa

        for batch in it:
            found = []
            for uri in batch.column(0).to_pylist():
                try:
                    with _open(uri) as stream:
                        found.append(leading_records(_pieces(stream, encoding), stop, after))
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.string())))], names=["file", "records"])

    return run


def _lines_task(stop: str | None, after: int):
    """The same from (file, value), the lines of the first blocks one file after the other: for stores that only Spark reads."""
    def run(it):
        import pyarrow as pa

        def result(name, lines):
            found = leading_records((line + "\n" for line in lines), stop, after)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([found], pa.list_(pa.list_(pa.string())))], names=["file", "records"])

        file, lines, size = None, [], 0
        for batch in it:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    if file is not None:
                        yield result(file, lines)
                    file, lines, size = name, [], 0
                if size <= HEADER_BYTES:
                    lines.append(line)
                    size += len(line)
        if file is not None:
            yield result(file, lines)

    return run


def header_index(spark: SparkSession, path, *, encoding: str = "UTF-8", recursive: bool = True, stop: str | None = None, after: int = 0) -> DataFrame:
    """(file, records, header) for every file below the path: its first records, null where it has none; no path, no row.

    Tasks open the files of the driver's file index and read no more than the first records take. Where only Spark can read the
    store, one scan of the lines of first blocks gives the same.
    """
    schema = "file string, records array<array<string>>"
    names = text_files(spark, path, recursive)
    files = spark.createDataFrame([(f,) for f in names], "file string")
    if not names or _opens(names[0]):
        tasks = max(1, -(-len(names) // FILES_A_TASK))
        heads = files.repartition(min(len(names), max(tasks, spark.sparkContext.defaultParallelism)) or 1).mapInArrow(_header_task(encoding, stop, after), schema)
    else:
        lines = (spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", GLOB).option("ignoreCorruptFiles", True).text(path)
                 .select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("_block")).where("_block = 0"))
        seen = lines.select("file", "value").mapInArrow(_lines_task(stop, after), schema).select(plain_name("file").alias("_f"), "records")
        heads = files.join(seen, plain_name(F.col("file")) == F.col("_f"), "left").select("file", "records")
    return durable(heads.withColumn("header", F.get("records", F.lit(0))))


def _readable(uri: str) -> str:
    """A name of the file index as a path for a reader: decoded, with the signs of patterns masked."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def scan_by_header(spark: SparkSession, heads: DataFrame, positions: dict[str, object], *, encoding: str = "UTF-8", multiline: bool = False,
                   needed: Sequence[str] = (), width=None, fallback: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Data lines with the wanted columns as (_file, _at, name..., has_name...), one scan for each kind of header.

    ``positions`` gives each name's position as a column over ``heads``, NULL where a file lacks it. Files alike in all positions and
    in their number of columns are read together by position, the wanted columns only, and nothing is joined or shuffled by file.
    Files without one of the ``needed`` names are not read. Beyond SCANS kinds of headers the ``fallback`` reads them all at once.
    """
    width = F.size("header") if width is None else width
    placed = heads.where(F.col("header").isNotNull()).select("file", width.alias("_width"), *[c.cast("int").alias(f"_i_{n}") for n, c in positions.items()])
    for name in needed:
        placed = placed.where(F.col(f"_i_{name}").isNotNull())
    kinds = placed.groupBy("_width", *[f"_i_{n}" for n in positions])
    if fallback is not None and kinds.count().limit(SCANS + 1).count() > SCANS:
        return fallback()
    out = None
    for kind in kinds.agg(F.sort_array(F.collect_list("file")).alias("files")).collect():
        have = {n: kind[f"_i_{n}"] for n in positions}
        schema = ", ".join(f"_c{i} string" for i in range(max([kind["_width"], *(i + 1 for i in have.values() if i is not None)])))
        reader = csv_reader(spark, encoding, True, multiline).schema(schema).option("header", True)
        rows = reader.csv([_readable(f) for f in kind["files"]]).select(
            F.col("_metadata.file_path").alias("_file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_at"),
            *[(F.lit(None).cast("string") if i is None else F.col(f"_c{i}")).alias(n) for n, i in have.items()],
            *[F.lit(i is not None).alias(f"has_{n}") for n, i in have.items()])
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        flags = "".join(f", has_{n} boolean" for n in positions)
        out = spark.createDataFrame([], "_file string, _at struct<block: bigint, line: bigint>" + "".join(f", `{n}` string" for n in positions) + flags)
    return out


# ---------------------------------------------------------------- damage

def _bytes(uri: str) -> Iterator[bytes]:
    """The content of a file piece by piece; an OSError where a compressed stream ends early, after all that could be read."""
    if not uri.endswith(".gz"):
        with _open(uri) as stream:
            while data := stream.read(1 << 20):
                yield data
        return
    with _open(uri, False) as stream:
        unpack, rest = zlib.decompressobj(31), b""
        while data := rest or stream.read(1 << 20):
            try:
                yield unpack.decompress(data)
            except zlib.error as error:
                raise OSError("damaged stream") from error
            rest = unpack.unused_data
            if unpack.eof and rest:  # another member
                unpack = zlib.decompressobj(31)
        if not unpack.eof:
            raise OSError("truncated stream")


def _damage_task():
    def count(uri: str) -> tuple[int, int, str | None]:
        """Bytes on disk, records, and what is wrong."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        lines = outside = quotes = 0
        last, damage = b"", None
        try:
            for data in _bytes(uri):
                lines += data.count(b"\n")
                parts = data.split(b'"')
                outside += sum(p.count(b"\n") for p in parts[quotes % 2::2])
                quotes += len(parts) - 1
                last = data[-1:] or last
        except OSError:
            damage = "truncated"
        if damage is None and quotes % 2:
            damage, outside = "open quote", lines
        return store.get_file_info(path).size, outside + (damage != "truncated" and last not in (b"", b"\n")), damage

    def run(it):
        import pyarrow as pa

        for batch in it:
            sizes, records, damage = zip(*(count(uri) for uri in batch.column(0).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(records, pa.int64()), pa.array(damage, pa.string())],
                                             names=["file", "n_bytes", "n_records", "damage"])

    return run


def file_damage(spark: SparkSession, path, *, recursive: bool = True, multiline: bool = False, encoding: str = "UTF-8",
                names: Sequence[str] | None = None) -> DataFrame:
    """(file, n_bytes, n_records, n_read, n_lost, damage): what a file holds against what the reader gives, header included.

    Tasks stream each file once and count records (line breaks outside quotes). A compressed stream that ends early is ``truncated``: its
    records up to there are counted, what came behind nobody knows. An ``open quote`` is one that is never closed: all lines count as
    records. ``n_read`` are the records that the CSV reader returns, so ``n_lost`` of a damaged file are missing from any query over it.
    ``names`` are the files if they have been listed before (those of a ``header_index`` of the path).
    """
    names = text_files(spark, path, recursive) if names is None else names
    files = spark.createDataFrame([(f,) for f in names], "file string")
    held = files.repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))).mapInArrow(
        _damage_task(), "file string, n_bytes bigint, n_records bigint, damage string")
    if not names:
        return held.select("file", "n_bytes", "n_records", F.lit(0).cast("bigint").alias("n_read"), F.lit(0).cast("bigint").alias("n_lost"), "damage")
    read = (csv_reader(spark, encoding, recursive, multiline).schema("_c0 string").option("header", False).csv(path)
            .groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count("*").alias("n_read"))
            .groupBy(plain_name("_path").alias("_f")).agg(F.sum("n_read").alias("n_read")))  # a name is rewritten once, not for every record
    both = held.join(read, plain_name(F.col("file")) == F.col("_f"), "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
    lost = F.when(F.col("damage").isNotNull(), F.greatest(F.col("n_records") - F.col("n_read"), F.lit(0))).otherwise(0)
    return both.select("file", "n_bytes", "n_records", "n_read", lost.cast("bigint").alias("n_lost"), "damage")
