"""Substring deduplication by relative Lempel-Ziv factors over content-defined reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.llm.common import doubtful_keys, identified, partitions, query, schema_with, table, written

WINDOW = 20
#: Words of an anchor; a window holds WINDOW - ANCHOR + 1 of them and belongs to the one of the smallest hash.
ANCHOR = 8
#: Words hashed and deduplicated at once within a task.
CHUNK_WORDS = 1 << 19
#: An anchor with more different blocks than this in one chunk sends them straight to the check of single windows.
COMMON_ANCHOR = 8
STEP, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
DUPLICATE, BLOCK, BOUNDARY, MARK = range(4)
#: Columns that the last step reads and does not return.
OWN = ("_dup_text", "_dup_lo", "_dup_n")


class _Words(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _runs(words: np.ndarray, length: int, step: int) -> np.ndarray:
    """At each position the hash of the next ``length`` words (meaningless where there are fewer), by doubling."""
    out, done, power, size = None, 0, words, 1
    while True:
        if length >> (size.bit_length() - 1) & 1:
            part = power if not done else np.concatenate((power[done:], np.zeros(min(done, len(power)), np.uint64)))
            out = part if out is None else out + part * np.uint64(pow(step, done, 1 << 64))
            done += size
        if done >= length:
            return out
        power = power + np.concatenate((power[size:], np.zeros(min(size, len(power)), np.uint64))) * np.uint64(pow(step, size, 1 << 64))
        size *= 2


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


class _Chunk:
    """Documents of a task until there are CHUNK_WORDS words; then their arrays."""

    def __init__(self):
        self.known = _Words()
        self.clear()

    def clear(self) -> None:
        self.docs, self.hashes, self.extra, self.size = [], [], [], 0

    def add(self, doc: int, text: str, extra=None) -> None:
        words = text.encode("utf-8", "surrogatepass").split()
        if len(words) >= WINDOW:
            self.docs.append(doc)
            self.hashes.append(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
            self.extra.append(extra)
            self.size += len(words)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words' hashes; the document, the first word and the end of the document of each word."""
        lengths = np.array([len(h) for h in self.hashes])
        ends = np.cumsum(lengths)
        return (np.concatenate(self.hashes), np.repeat(np.array(self.docs, np.int64), lengths), np.repeat(ends - lengths, lengths),
                np.repeat(ends, lengths))


def _merged(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining runs of windows of a document as one factor."""
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.add.reduceat(n, at) if len(at) else n[:0]


def _sent(place: list, second: list, doc: list, info: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(np.concatenate(place)), _signed(np.concatenate(second)), pa.array(np.concatenate(doc)),
                                       pa.array(np.concatenate(info))], names=["place", "second", "doc", "info"])


def _firsts(one: np.ndarray, two: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (one, two, doc, lo), and in it which entries open a new (one, two)."""
    order = np.lexsort((lo, doc, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    return order, new


def _repeats(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    doc, lo, n = _merged(doc, lo, n)
    spread = _mixed(doc.view(np.uint64) * np.uint64(STEP) + lo.astype(np.uint64))
    return spread, n.astype(np.uint64), doc, lo << 8 | DUPLICATE


def _blocks(chunk: _Chunk) -> pa.RecordBatch:
    """One row per block: a run of windows with the same anchor.

    A block seen before in the chunk is a factor already and travels as such; of the others one row per anchor and content is
    placed by its anchor.
    """
    words, doc_of, first_of, end_of = chunk.arrays()
    grams = _mixed(_runs(words, ANCHOR, STEP))
    windows = _runs(words, WINDOW, OTHER)
    starts = np.flatnonzero(end_of - np.arange(len(words)) >= WINDOW)
    span = WINDOW - ANCHOR + 1
    anchor = starts + np.lib.stride_tricks.sliding_window_view(grams, span)[starts].argmin(axis=1)
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    lo, hi, pos = starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]
    key = grams[pos]
    content = _mixed(windows[lo] + _mixed(windows[hi] + ((hi - lo) * 64 + (pos - lo)).astype(np.uint64) * np.uint64(STEP)))
    doc, first = doc_of[lo], lo - first_of[lo]
    n = hi - lo + 1
    order, opens = _firsts(key, content, doc, first)
    later = order[~opens]
    place, second, docs, info = map(list, zip(_repeats(doc[later], first[later], n[later]), strict=True))
    kept = order[opens]
    group = np.cumsum(np.append(True, key[kept[1:]] != key[kept[:-1]])) - 1
    common = np.bincount(group)[group] > COMMON_ANCHOR
    one, many = kept[~common], kept[common]
    marked = many[np.append(True, key[many[1:]] != key[many[:-1]])[:len(many)]]
    for rows, where, what, kind in ((one, key[one], content[one], BLOCK), (many, _mixed(key[many] + content[many]), content[many], BOUNDARY),
                                    (marked, key[marked], np.full(len(marked), 1 << 63, np.uint64), MARK)):
        place.append(where)
        second.append(what)
        docs.append(doc[rows])
        info.append(first[rows] << 8 | n[rows] << 2 | kind)
    return _sent(place, second, docs, info)


def _windows(chunk: _Chunk) -> pa.RecordBatch:
    """One row per window of the boundary blocks; a window seen before in the chunk travels as a factor."""
    words, doc_of, first_of, end_of = chunk.arrays()
    one, two = _mixed(_runs(words, WINDOW, STEP)), _mixed(_runs(_mixed(words), WINDOW, OTHER))
    base = np.cumsum([0] + [len(h) for h in chunk.hashes])
    lo = np.concatenate([base[k] + np.repeat(a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) for k, (a, n) in enumerate(chunk.extra)])
    one, two, doc, first = one[lo], two[lo], doc_of[lo], lo - first_of[lo]
    order, opens = _firsts(one, two, doc, first)
    later, kept = order[~opens], order[opens]
    place, second, docs, info = map(list, zip(_repeats(doc[later], first[later], np.ones(len(later), np.int64)), strict=True))
    place.append(one[kept])
    second.append(two[kept])
    docs.append(doc[kept])
    info.append(first[kept] << 8 | 1 << 2 | BLOCK)
    return _sent(place, second, docs, info)


def _emit(make):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in it:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            docs = columns[0].to_numpy()
            for i, doc in enumerate(docs.tolist()):
                extra = [np.asarray(c[i].values, np.int64) for c in columns[2:]] or None
                chunk.add(doc, columns[1][i].as_py() or "", extra)
                if chunk.size >= CHUNK_WORDS:
                    yield make(chunk)
                    chunk.clear()
        if chunk.size:
            yield make(chunk)

    return run


def _resolve(boundaries: bool):
    """Reads rows sorted by (place, second, doc, info) and says which blocks repeat an earlier one.

    Holds one row and two flags between batches, however many rows a place has. With ``boundaries``, blocks whose anchor has
    other contents too come out as BOUNDARY.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # place, second, whether the place has several contents
        pending = None  # the only block so far of the last place
        for batch in it:
            place, second, doc, info = (batch.column(i).to_numpy() for i in range(4))
            kind = info & 3
            out = [(doc[m], info[m] >> 8, second[m] if k == DUPLICATE else info[m] >> 2 & 63, k) for k in (DUPLICATE, BOUNDARY)
                   for m in (kind == k,) if m.any()]
            live = (kind == BLOCK) | (kind == MARK)
            place, second, doc, info, kind = place[live], second[live], doc[live], info[live], kind[live]
            if len(place):
                opens_place = np.ones(len(place), bool)
                opens_place[1:] = place[1:] != place[:-1]
                opens = opens_place.copy()
                opens[1:] |= second[1:] != second[:-1]
                goes_on = last is not None and place[0] == last[0]
                if goes_on:
                    opens_place[0] = False
                    opens[0] = second[0] != last[1]
                repeat = ~opens & (kind == BLOCK)
                out.append((doc[repeat], info[repeat] >> 8, info[repeat] >> 2 & 63, DUPLICATE))
                group = np.cumsum(opens_place)
                contents = np.bincount(group, weights=opens & (kind == BLOCK), minlength=group[-1] + 1)
                contents += 2 * np.bincount(group, weights=kind == MARK, minlength=group[-1] + 1)
                if goes_on:
                    contents[0] += 2 if last[2] else pending is not None
                    if pending is not None and contents[0] > 1:
                        out.append((*pending, BOUNDARY))
                        pending = None
                else:
                    pending = pending if goes_on else None
                several = contents > 1
                chosen = opens & (kind == BLOCK) & several[group]
                out.append((doc[chosen], info[chosen] >> 8, info[chosen] >> 2 & 63, BOUNDARY))
                end = group[-1]
                if opens_place.any():
                    pending = None
                if not several[end]:
                    own = np.flatnonzero((group == end) & opens & (kind == BLOCK))
                    if len(own):
                        pending = doc[own[:1]], info[own[:1]] >> 8, info[own[:1]] >> 2 & 63
                last = place[-1], second[-1], bool(several[end])
            out = [x for x in out if len(x[0]) and (boundaries or x[3] == DUPLICATE)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out])),
                     pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([np.full(len(x[0]), x[3]) for x in out]))],
                    names=["doc", "lo", "n", "kind"])

    return run


SENT = "place bigint, second bigint, doc bigint, info bigint"
FOUND = "doc bigint, lo bigint, n bigint, kind bigint"


def _found(rows: DataFrame, boundaries: bool, spark: SparkSession) -> DataFrame:
    order = "place", "second", "doc", "info"
    return (rows.repartition(partitions(spark), "place").sortWithinPartitions(*order)
            .mapInArrow(_resolve(boundaries), FOUND))


def factors(docs: DataFrame, text: str = "text", rid: str = "_rid") -> DataFrame:
    """``(doc, lo, n)``: every window start ``lo`` to ``lo + n - 1`` of a document that repeats an earlier window of WINDOW words.

    ``rid`` must be unique: a document given twice would repeat itself.

    Each document is cut into blocks that its own words define: the windows that share an anchor (their smallest hash of ANCHOR
    words), so equal text is cut alike wherever it stands. The blocks of all documents are the reference, indexed by anchor. A
    document is factored against it block by block: a block whose content stands earlier continues the factor; at the boundary,
    where the anchor is known but the content differs, each window is looked up on its own. Windows without a known anchor repeat
    nothing. 128 bits of hash stand for a block or window.
    """
    spark = docs.sparkSession
    bare = docs.select(rid, text)
    blocks = written(_found(bare.mapInArrow(_emit(_blocks), SENT), True, spark), "blocks")
    open_ = blocks.where(F.col("kind") == BOUNDARY).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("_b"))
    again = (bare.join(open_, F.col(rid) == F.col("doc"))
             .select(rid, text, F.col("_b.lo").alias("lo"), F.col("_b.n").alias("n")))
    windows = written(_found(again.mapInArrow(_emit(_windows), SENT), False, spark), "windows")
    return blocks.where(F.col("kind") == DUPLICATE).unionAll(windows).select("doc", "lo", "n")


def _keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rest = [i for i, name in enumerate(batch.schema.names) if name not in OWN]
        texts, los, ns = (batch.column(name) for name in OWN)
        words_, removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()
            gone = 0
            if los[i].is_valid and len(los[i]):
                edge = np.zeros(len(words) + 1, np.int64)
                lo = np.asarray(los[i].values, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + np.asarray(ns[i].values, np.int64) + WINDOW - 1, -1)
                cover = (np.cumsum(edge)[:-1] > 0)
                gone = int(cover.sum())
                words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
            words_.append(len(words) + gone)
            removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(words_, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(kept, pa.string())], names=[*(batch.schema.names[i] for i in rest), "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by one space).

    A word goes if a window of WINDOW words over it stands earlier: in a document with a smaller key, or earlier in its own. All
    windows are judged on the input. Words are runs of anything but ASCII white space. A null text has no words. Rows with a null
    key come first, rows with one key are ordered by a hash of the text, rows alike in both are one document. Columns of ``docs``
    named like a result are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    doubtful = doubtful_keys(docs, key)
    docs = identified(docs, key, text, "_dup_rid", doubtful)
    once = docs.select("_dup_rid", text)
    if doubtful:  # else rows alike would repeat themselves
        once = written(once.dropDuplicates(["_dup_rid"]), "documents-once")
    spans = factors(once, text, "_dup_rid").groupBy(F.col("doc").alias("_dup_doc")).agg(F.collect_list(F.struct("lo", "n")).alias("_dup_spans"))
    joined = (docs.join(spans, F.col("_dup_rid") == F.col("_dup_doc"), "left")
              .withColumns({"_dup_text": F.col(text), "_dup_lo": F.col("_dup_spans.lo"), "_dup_n": F.col("_dup_spans.n")})
              .drop("_dup_doc", "_dup_spans", "_dup_rid"))
    return joined.mapInArrow(_keep, schema_with(joined, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), without=OWN))


@query("op5_substrings")
def op5_substrings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
