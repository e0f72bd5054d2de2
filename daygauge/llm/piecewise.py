"""Context-triggered piecewise hashing: document fingerprints that survive edits."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.llm.common import doubtful_keys, identified, partitions, query, table

#: Smallest block size; block sizes are this times powers of two.
LEAST_BLOCK = 4
#: A signature has this many letters at least, where the text allows, and never more than MOST.
WANTED, MOST = 32, 96
#: Letters two signatures must share in a row before their distance counts.
COMMON = 5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Result rows of documents alike in key and text that one task writes in a row.
ALIKE = 1 << 16
_STEP = 0x01000193
_M32 = (1 << 32) - 1


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a mixed hash of it and the six before it."""
    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[by:] = x[:-by]
        return out

    one = data.astype(np.uint32) + np.uint32(1)
    two = one + shifted(one, 1) * np.uint32(_STEP) if len(one) > 1 else one.copy()
    if len(one) > 6:
        all_ = two + shifted(two, 2) * np.uint32(_STEP**2 & _M32)
        all_ += shifted(two, 4) * np.uint32(_STEP**4 & _M32)
        all_ += shifted(one, 6) * np.uint32(_STEP**6 & _M32)
    else:
        all_ = two
    all_ ^= all_ >> np.uint32(15)
    all_ *= np.uint32(0x2C1B3C6D)
    return all_ ^ (all_ >> np.uint32(13))


def _signature(data: bytes, ends: np.ndarray) -> str:
    view, low, out = memoryview(data), 0, []
    for high in [*ends.tolist(), len(data)]:
        if high > low:
            out.append(ALPHABET[(zlib.crc32(view[low:high]) * 0x9E3779B1 & _M32) >> 26])
            low = high
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``; each letter stands for one piece of the whole text.

    A piece ends where the rolling hash of seven bytes ends in enough ones, so an edit changes the pieces it touches only. The
    block size starts from the length and falls while the signature is short, and rises while it is long, which also bounds
    texts that repeat one phrase.
    """
    rolled = _rolling(np.frombuffer(data, np.uint8)) if data else np.zeros(0, np.uint32)
    bits = np.bitwise_count(rolled & ~(rolled + np.uint32(1)))  # ones at the low end
    least = LEAST_BLOCK.bit_length() - 1
    ends = np.flatnonzero(bits >= least) + 1
    levels = bits[ends - 1]
    pieces = np.cumsum(np.bincount(levels, minlength=40)[::-1])[::-1] + 1
    level = least
    while (1 << level) * 2 * WANTED < len(data) and level < 32:
        level += 1
    while level > least and pieces[level] < WANTED:
        level -= 1
    while pieces[level] > MOST and level < 33:
        level += 1
    at = ends[levels >= level]
    return f"{1 << level}:{_signature(data, at)}:{_signature(data, at[bits[at - 1] >= level + 1])}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table as the bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for ch in b:
        same = where.get(ch, 0)
        zero = (((same & up) + up) ^ up) | same | down
        rise = down | ~(zero | up) & full
        fall = up & zero
        if rise & top:
            distance += 1
        if fall & top:
            distance -= 1
        rise = rise << 1 & full | 1
        up = (fall << 1 & full) | ~(zero | rise) & full
        down = rise & zero
    return distance


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if min(len(a), len(b)) >= COMMON:
        runs = {a[i:i + COMMON] for i in range(len(a) - COMMON + 1)}
        if not any(b[i:i + COMMON] in runs for i in range(len(b) - COMMON + 1)):
            return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def compare(one: str, two: str) -> float:
    """0 to 1: the likeness of the signatures at a block size both fingerprints have; 0 where there is none, 1 if equal."""
    if one == two:
        return 1.0
    (a, a1, a2), (b, b1, b2) = one.split(":"), two.split(":")
    if a == b:
        return max(_likeness(a1, b1), _likeness(a2, b2) if min(len(a2), len(b2)) >= COMMON else 0.0)
    if int(a) == 2 * int(b):
        return _likeness(a1, b2)
    if int(b) == 2 * int(a):
        return _likeness(a2, b1)
    return 0.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every whole text (null: empty), without a shuffle."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints = [fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, fingerprint string")


def _edges(ids: DataFrame, n: int) -> list[int]:
    """Up to n - 1 places that cut the ids into ranges of about equal size, from a sketch."""
    return sorted(set(int(x) for x in ids.approxQuantile("_rid", [i / n for i in range(1, n)], 0.002))) if n > 1 else []


def with_next(rows: DataFrame, doubtful: bool) -> DataFrame:
    """From ``(doc_id, text)`` rows ``(range, tail, rid, doc_id, text, alike)`` sorted so that the next document of each follows it in its task.

    Documents are dealt out by ranges of their order; the first document of each range goes to the range before it as well, the
    first of all to the last. Texts are shuffled once; per range two numbers reach the driver. Where keys repeat (``doubtful``), rows alike
    in key and text are first made one row, as an aggregation, and ``alike`` counts them: no range takes more than one of their texts.
    """
    n = partitions(rows.sparkSession)
    if doubtful:
        rows = rows.groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), F.count("*").alias("alike")).drop("hash")
    else:
        rows = rows.withColumn("alike", F.lit(1).cast("bigint"))
    rows = identified(rows, "doc_id", "text", doubtful=doubtful)
    edges = _edges(rows.select("_rid"), n)

    def lows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_numpy()
            of = np.searchsorted(edges, ids, "right")
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids)], names=["range", "rid"])

    firsts = dict(rows.select("_rid").mapInArrow(lows, "range bigint, rid bigint").groupBy("range").agg(F.min("rid")).collect())
    filled = sorted(firsts)
    before = {firsts[r]: filled[i - 1] for i, r in enumerate(filled)}

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rid = batch.column("_rid").to_numpy()
            own = pa.table([pa.array(np.searchsorted(edges, rid, "right")), pa.array(np.zeros(len(rid), np.int32)), batch.column("_rid"),
                            batch.column("doc_id"), batch.column("text"), batch.column("alike")], names=["range", "tail", "rid", "doc_id", "text", "alike"])
            yield from own.to_batches()
            twice = [i for i, r in enumerate(rid.tolist()) if r in before]
            if twice:
                tails = own.take(pa.array(twice))
                yield from pa.table([pa.array([before[r] for r in tails["rid"].to_pylist()], pa.int64()), pa.array(np.ones(len(twice), np.int32)),
                                     tails["rid"], tails["doc_id"], tails["text"], tails["alike"]], names=own.schema.names).to_batches()

    dealt = rows.select("_rid", "doc_id", "text", "alike").mapInArrow(
        deal, "range bigint, tail int, rid bigint, doc_id bigint, text string, alike bigint")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "tail", "rid")


def _compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []  # range, doc_id, number of rows that agree in all, text, fingerprint

    def result(text: str, own: str, after: str, next_print: str):
        n = len(text)
        edited = (text[:n - n // 4] + after[:n // 4]).encode("utf-8", "surrogatepass")
        other = fingerprint(edited)
        return n, hashlib.sha256(edited).hexdigest(), own, other, compare(own, other), compare(own, next_print)

    for batch in it:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for range_, tail, _, doc_id, text, alike in zip(*columns, strict=True):
            own = fingerprint(text.encode("utf-8", "surrogatepass"))
            if held and held[0] == range_:
                out.append((held[1], *result(held[3], held[4], text, own), held[2]))
                held = []
            if not tail:
                held = [range_, doc_id, alike, text, own]
        if out:
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "alike"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text and their likeness, and its likeness to the next document.

    The edited text has its last quarter of code points replaced by the first as many of the next document; the last document is
    followed by the first, a single one by itself. A null text is empty. A null key comes first; rows with one key are ordered by
    a hash of their text, rows alike in both are one document; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    doubtful = doubtful_keys(rows, "doc_id")
    found = with_next(rows, doubtful).mapInArrow(
        _compared, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
                   "near_next double, alike bigint")
    if not doubtful:
        return found.drop("alike")
    # A result of many rows goes to many tasks, by parts of ALIKE rows.
    zero, parts = F.lit(0).cast("bigint"), F.floor((F.col("alike") - 1) / ALIKE)
    spread = found.withColumn("part", F.explode(F.sequence(zero, parts))).repartition(partitions(docs.sparkSession))
    copies = F.sequence(zero, F.least(F.col("alike") - F.col("part") * ALIKE, F.lit(ALIKE)) - 1)
    return spread.withColumn("copy", F.explode(copies)).drop("alike", "part", "copy")


@query("op3_piecewise")
def op3_piecewise(spark, sf_dir):
    return compare_edited(table(spark, sf_dir, "documents"))
