"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.llm.common import batches, query, table, written
from daygauge.llm.components import components

BITS = 64
#: Lowest bit and width of the three segments; each fits a word of the code, the last one with leading zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the perfect binary Golay code of length 23.
GENERATOR = 0b110001110101
#: A bucket of more fingerprints than this is linked by midpoints instead of by pairs.
PAIRED_BUCKET = 24
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _syndromes(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


@cache
def _decoding() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the differences to all code words within four bits (the nearest first, padded with it), and their number."""
    patterns = [sum(1 << b for b in chosen) for n in range(5) for chosen in combinations(range(23), n)]
    by: dict[int, list[int]] = {}
    for pattern, syndrome in zip(patterns, _syndromes(np.array(patterns)).tolist(), strict=True):
        by.setdefault(syndrome, []).append(pattern)
    most = max(map(len, by.values()))
    table_ = np.zeros((1 << 11, most), np.int64)
    count = np.zeros(1 << 11, np.int64)
    for syndrome, own in by.items():
        table_[syndrome], count[syndrome] = own + own[:1] * (most - len(own)), len(own)
    return table_, count


def code_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of all code words within four bits of each 23-bit segment, padded, and how many count.

    Every segment has a code word within three bits, so two segments that differ in one bit share an index.
    """
    differences, count = _decoding()
    syndrome = _syndromes(segment)
    return (segment[:, None] ^ differences[syndrome]) >> 11, count[syndrome]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(position, key)``: two fingerprints that differ in two bits at most share a key.

    Two errors leave one of three segments without any, and its follower or its leader with one at most. A key is an exact
    segment with a code-word index of the next segment in turn; over the three turns every split of two errors is met.
    """
    words = prints.astype(np.uint64)
    segments = [(words >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    where, keys = [], []
    for turn in range(3):
        indices, count = code_indices(segments[(turn + 1) % 3])
        live = np.arange(indices.shape[1])[None, :] < count[:, None]
        row, column = np.nonzero(live)
        where.append(row)
        keys.append(turn << 40 | segments[turn][row] << 12 | indices[row, column])
    return np.concatenate(where), np.concatenate(keys)


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of the word shingles, repeats included: a bit is 1 if set in over half of the hashes; no word, no bit."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, simhash)``: the 64 bits as a signed long. A null text is empty; one row per row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "simhash"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).mapInArrow(batches(run), "doc_id bigint, simhash bigint")


def _key_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        prints = batch.column(0).to_numpy()
        row, keys = fuzzy_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[row])], names=["key", "simhash"])


def _variants(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate(([0], np.uint64(1) << np.arange(BITS, dtype=np.uint64))).astype(np.uint64)
    for batch in it:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 4096):
            part = prints[at:at + 4096]
            middle = (part.view(np.uint64)[:, None] ^ flips[None, :]).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(middle), pa.array(np.repeat(part, BITS + 1))], names=["middle", "simhash"])


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``simhash``) whose components are those of all links.

    A bucket of up to ``PAIRED_BUCKET`` fingerprints gives its pairs, each verified on all 64 bits. The fingerprints of larger
    buckets emit all words within one bit; two are linked exactly if they share such a word, so each word links its members to
    the smallest: 65 rows per fingerprint whatever the bucket's size, and nothing is left out.
    """
    if distance != 2:
        raise ValueError("keys and midpoints are those of two differing bits")
    keyed = written(prints.select("simhash").mapInArrow(_key_rows, "key bigint, simhash bigint"), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    small = keyed.join(sizes.where(F.col("n") <= PAIRED_BUCKET).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("simhash")).alias("all"))
    pairs = (small.select("all", F.posexplode("all").alias("at", "a"))
             .select("a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"))
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    large = keyed.join(sizes.where(F.col("n") > PAIRED_BUCKET).select("key"), "key").select("simhash").distinct()
    middles = written(large.mapInArrow(_variants, "middle bigint, simhash bigint"), "golay-middles")
    first = middles.groupBy("middle").agg(F.min("simhash").alias("a"), F.max("simhash").alias("z")).where("a <> z").select("middle", "a")
    stars = middles.join(first, "middle").select("a", F.col("simhash").alias("b")).where("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, simhash, component_id)``: near-duplicate groups of the documents, one row per row.

    ``component_id`` is the smallest key reachable over links of at most ``distance`` bits. Equal fingerprints are one node, so
    thousands of copies cost one. A null text is empty; empty texts have fingerprint zero and link like any other; rows with a
    null key take part and are named by the others of their group (null if none has a key); an empty table gives no rows.
    Other columns are ignored.
    """
    rows = written(fingerprints(docs, shingle, key, text), "fingerprints")
    prints = written(rows.groupBy("simhash").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    grouped = written(components(links(prints, distance)), "fingerprint-components")
    named = prints.join(grouped.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(least, "component").select("simhash", "component_id")
    return rows.join(final, "simhash").select("doc_id", "simhash", "component_id")


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
