"""Mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Mapping
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygauge.llm.common import partitions, query, table, written

SEQUENCE = 2048
END = 1
#: Sources with a queue of their own, the largest by tokens, besides those with a given proportion; all others share the queues after
#: them by hash.
OWN_QUEUES = 4096
SHARED_QUEUES = 64
#: Words whose ids a worker keeps, or those of one chunk if they are more.
KEPT_WORDS = 300_000
#: Bytes of text whose words are looked up at once; longer texts are cut at white space.
CHUNK_BYTES = 1 << 21
#: Quotas (sequences times queues) that are worked out at once.
BLOCK = 1 << 17
#: Rows of the table of queue starts, one for each task and source, up to which it goes to the token ids, and not they to it.
BROADCAST_STARTS = 200_000


#: Characters whose words can be found here as the tokenizer finds them: ASCII and Latin letters with their usual signs. Fixed values.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ\u0100-\u012f\u0131-\u017f"
_SIGNS = "!-/:-@[-`{-~¡¿«»§°·‐-―‘-„†-…€"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_SPACES = b"\t\n\x0b\f\r "
#: Kinds of characters: the tokenizer's pattern has a border wherever the kind changes, and on both sides of a digit.
_SPACE, _LETTER, _DIGIT, _SIGN, _STRANGE = range(5)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character of at most three bytes."""
    kinds, lower = np.full(1 << 16, _STRANGE, np.uint8), np.arange(1 << 16)
    for pattern, kind in ((f"[{_LETTERS}]", _LETTER), ("[0-9]", _DIGIT), (f"[{_SIGNS}]", _SIGN)):
        found = [m.start() for m in re.finditer(pattern, "".join(map(chr, range(1 << 16))))]
        kinds[found] = kind
        if kind == _LETTER:
            lower[found] = [ord(chr(c).lower()) for c in found]
    kinds[list(_SPACES)] = _SPACE
    return kinds, lower


_KIND, _LOWER = _kinds()
#: Kind and lower case of a byte; bytes of longer characters count as strange until they are put together.
_BYTE_KIND, _BYTE_LOWER = np.append(_KIND[:128], np.full(128, _STRANGE, np.uint8)), np.append(_LOWER[:128], np.arange(128, 256)).astype(np.uint8)
#: Letters that may belong to an apostrophe before them: 's 't 're 've 'm 'll 'd.
_SHORT = np.isin(np.arange(256), list(b"strvmldSTRVMLD"))


def _cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut UTF-8 texts, one after the other, into parts whose ids, one after the other, are those of the texts.

    What stands between white space is cut into the words of the tokenizer's pattern, in lower case; if it has a character that is not
    listed above, or might hold a special token, it stays whole and the tokenizer finds the words. Returns the bytes without white
    space, the place of each part in them, and the number of parts before each text.
    """
    kind, low = _BYTE_KIND[data], _BYTE_LOWER[data]
    high = np.flatnonzero(data >= 0xC0)
    for first, last, size in ((0xC0, 0xDF, 2), (0xE0, 0xEF, 3)):
        at = high[(data[high] >= first) & (data[high] <= last)]
        code = data[at].astype(np.int64) & (0x1F if size == 2 else 0x0F)
        for i in range(1, size):
            code = code << 6 | data[at + i] & 0x3F
        for i in range(size):
            kind[at + i] = _KIND[code]
        if size == 2:
            low[at], low[at + 1] = 0xC0 | _LOWER[code] >> 6, 0x80 | _LOWER[code] & 0x3F
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    begins = begins[:-1]
    strange = np.concatenate((np.flatnonzero(kind == _STRANGE), np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))))
    if len(strange):
        space = kind == _SPACE
        edges = np.append(np.flatnonzero(begins | np.append(True, space[1:] != space[:-1])), len(data))
        own = np.unique(np.searchsorted(edges, strange, "right") - 1)
        whole = np.zeros(len(data) + 1, np.int8)
        whole[edges[own]] += 1
        whole[edges[own + 1]] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
        kind[whole] = _STRANGE
        low[whole] = data[whole]
    cuts = kind == _DIGIT
    cuts[0] = True
    cuts[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(data[:-1] == ord("'")) + 1
    cuts[after[_SHORT[data[after]]]] = False
    cuts |= begins
    kept = kind != _SPACE
    cuts &= kept
    return low[kept], np.flatnonzero(cuts[kept]), np.searchsorted(np.flatnonzero(cuts), starts)


class WordIds:
    """Token ids of whole texts, gathered word by word: no token of this vocabulary crosses a word of its pattern.

    Ids of a distinct word are computed once, by the tokenizer.
    """

    _shared: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.used = 0
        self.pool, self.starts, self.lengths = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        larger = np.zeros(max(size, len(array) * 3 // 2), array.dtype)
        larger[:len(array)] = array
        return larger

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        low, high = len(self.number), len(self.number) + len(words)
        self.pool = self._room(self.pool, self.used + len(ids))
        self.starts, self.lengths = self._room(self.starts, high), self._room(self.lengths, high)
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[low:high] = self.used + np.cumsum(lengths) - lengths
        self.lengths[low:high] = lengths
        self.used += len(ids)
        self.number.update(zip(words, range(low, high), strict=True))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their number, one after the other, and how many each word has."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(int(lengths.sum()))], lengths

    def learn(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words, whose ids are kept from now on. If they get too many, what is not among these words is forgotten."""
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(numbers < 0).tolist()
        if not unknown:
            return numbers
        new = [words[i] for i in unknown]
        if len(self.number) + len(new) > KEPT_WORDS:
            known = np.flatnonzero(numbers >= 0)
            ids, lengths = self._gather(numbers[known])
            self.forget()
            self._keep([words[i] for i in known.tolist()], ids, lengths)
            numbers[known] = np.arange(len(known))
        plain = [w for w in new if w.isalpha() and (w.isascii() or _PLAIN.fullmatch(w))]
        for at in range(0, len(plain), 512):  # one word each between spaces, told apart by their last tokens
            some = plain[at:at + 512]
            joined = " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                lengths = np.diff(ends, prepend=0)
            else:  # a vocabulary without a sign for the end of a word: told apart by their number
                own = self.tokenizer.encode(joined, add_special_tokens=False)
                ids, lengths = np.array(own.ids, np.int64), np.bincount(np.array(own.word_ids, np.int64), minlength=len(some))
            self._keep(some, ids, lengths)
        other = list(set(new).difference(plain))
        for at in range(0, len(other), 512):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(other[at:at + 512], add_special_tokens=False)]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            self._keep(other[at:at + 512], np.fromiter(chain.from_iterable(each), np.int64, int(lengths.sum())), lengths)
        numbers[unknown] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        return numbers

    def _chunk(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of adjoining bytes of texts and their number before each text that starts there."""
        signs, words, before = _cut(data, starts)
        offsets = np.append(words, len(signs)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(signs)).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, lengths = self._gather(self.learn(distinct)[parts.indices.to_numpy()])
        return ids, np.append(0, np.cumsum(lengths))[before]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with the end id last, and where each begins and the last ends."""
        texts = texts.cast(pa.large_string()).fill_null("")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[edges[0]:edges[-1]] if buffer else np.zeros(0, np.uint8)
        starts = edges[:-1] - edges[0]
        found, places, low, total = [], [np.zeros(0, np.int64)], 0, 0
        while low < len(data):
            high = low + CHUNK_BYTES
            if high < len(data):  # behind the last space of the chunk, or else behind the next one
                spaces = np.flatnonzero(_BYTE_KIND[data[low:high]] == _SPACE)
                while not len(spaces) and high < len(data):
                    spaces = np.flatnonzero(_BYTE_KIND[data[high:high + CHUNK_BYTES]] == _SPACE)[:1] + high - low
                    high += CHUNK_BYTES
                high = low + int(spaces[-1]) + 1 if len(spaces) else len(data)
            high = min(high, len(data))
            own = starts[np.searchsorted(starts, low):np.searchsorted(starts, high)] - low
            ids, before = self._chunk(data[low:high], own)
            found.append(ids)
            places.append(before + total)
            total += len(ids)
            low = high
        places.append(np.full(len(starts) - sum(map(len, places)), total))  # empty texts behind the last byte
        begins = np.append(np.concatenate(places), total) + np.arange(len(starts) + 1)
        out = np.empty(int(begins[-1]), self.kind)
        end = np.zeros(len(out), bool)
        end[begins[1:] - 1] = True
        out[end] = END
        out[~end] = np.concatenate([*found, np.zeros(0, self.kind)])
        return out, begins


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Written rows ``(part, doc_id, source, n, at, ids)``: a document's ids, the end id last, and its place in its source's queue.

    ``part`` is the task that wrote the row and ``at`` the tokens of the source before it there; both are data from here on, so
    neither ids nor texts are shuffled for the running totals.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, before = TaskContext.get().partitionId(), WordIds.of(tokenizer), {}
        for batch in it:
            sources, low = batch.column(1).to_pylist(), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while low < batch.num_rows:  # so many rows as have the bytes of a chunk, one at least
                high = max(int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + CHUNK_BYTES, "right")), low + 1)
                own = sources[low:high]
                ids, begins = words.ids(batch.column(2).slice(low, high - low))
                n, at = np.diff(begins), []
                for name, count in zip(own, n.tolist(), strict=True):
                    at.append(before.get(name, 0))
                    before[name] = at[-1] + count
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(begins * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), part, np.int32)), batch.column(0).slice(low, high - low), pa.array(own, pa.string()),
                     pa.array(n), pa.array(at, pa.int64()), data.cast(pa.binary())], names=["part", "doc_id", "source", "n", "at", "ids"])
                low = high

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), text)
    return written(rows.mapInArrow(run, "part int, doc_id bigint, source string, n bigint, at bigint, ids binary"), "token-ids")


class Quotas:
    """How many tokens of each queue stand before any rank of the packed stream.

    Queue q is owed ``rate`` tokens a unit of virtual time; its next token is due when half of it is owed. Serving tokens by due
    time, ties in the order of the queues, is deficit round-robin with a quantum of one token: every window gets each queue's
    share, and what a queue is still owed (below one token) goes on to the next window. As counts are a function of the rank, any
    task finds the deficits at its first window without the windows before.
    """

    def __init__(self, totals: np.ndarray, rates: np.ndarray):
        self.totals, self.rates = totals.astype(np.int64), rates.astype(np.float64)
        self.all = int(self.totals.sum())
        self.late = float((self.totals / self.rates).max()) if len(totals) else 0.0
        self.windows, rest = divmod(self.all, SEQUENCE)
        tail = np.cumsum([0] + [1 << b for b in range(SEQUENCE.bit_length() - 1, -1, -1) if rest >> b & 1])
        self.tail = self.windows * SEQUENCE + tail
        self.sequences = self.windows + len(tail) - 1

    def ranks(self, sequence: np.ndarray) -> np.ndarray:
        """First rank of each sequence: whole windows, then the rest by powers of two, which need no padding."""
        over = np.clip(sequence - self.windows, 0, len(self.tail) - 1)
        return np.where(sequence <= self.windows, sequence * SEQUENCE, self.tail[over])

    def _due(self, time: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(time[:, None] * self.rates[None, :] + 0.5), self.totals[None, :]).astype(np.int64)

    def served(self, rank: np.ndarray) -> np.ndarray:
        """Row by row the tokens of each queue among the first ``rank``; rows sum to it and never fall as it grows."""
        speed, width = self.rates.sum(), len(self.rates) + 1
        low = np.maximum((rank - width) / speed, 0.0)
        low = np.where(self._due(low).sum(axis=1) <= rank, low, 0.0)
        high = np.minimum((rank + width) / speed, self.late)
        high = np.where(self._due(high).sum(axis=1) > rank, high, np.nextafter(self.late, np.inf))
        for _ in range(200):
            middle = low + (high - low) / 2
            open_ = (middle > low) & (middle < high)
            if not open_.any():
                break
            fits = self._due(middle).sum(axis=1) <= rank
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle, high)
        now = self._due(low)
        step = self._due(high) - now
        gap = rank - now.sum(axis=1)
        return now + np.clip(gap[:, None] - (np.cumsum(step, axis=1) - step), 0, step)

    def near(self, queue: int, position: np.ndarray, margin: int) -> np.ndarray:
        """A sequence at or before (margin -1) or after (1) the one that holds these positions of a queue."""
        rank = self._due((position + 0.5) / self.rates[queue]).sum(axis=1) + margin * (len(self.rates) + 2)
        return np.clip(rank // SEQUENCE + margin, 0, self.sequences)


def _pieces(quotas: Quotas, queue: int, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Document number, start in it, length, sequence and offset of the pieces of adjoining documents of a queue."""
    low, end = int(starts[0]), int(starts[-1] + lengths[-1])
    sequence, last = (int(quotas.near(queue, np.array([at]), margin)[0]) for at, margin in ((low, -1), (end, 1)))
    most = max(BLOCK // len(quotas.rates), 16)
    while low < end:
        run = np.arange(sequence, min(max(min(sequence + most, last), sequence + 1), quotas.sequences) + 1)
        served = quotas.served(quotas.ranks(run))
        edge = served[:, queue]
        high = min(end, int(edge[-1]))
        if high > low:
            cuts = np.unique(np.concatenate((edge, starts, [low, high])))
            cuts = cuts[(cuts >= low) & (cuts <= high)]
            first, length = cuts[:-1], np.diff(cuts)
            doc = np.searchsorted(starts, first, "right") - 1
            at = np.searchsorted(edge, first, "right") - 1
            taken = np.diff(served, axis=0)[:, :queue].sum(axis=1)
            yield doc, first - starts[doc], length, run[at], taken[at] + first - edge[at]
            low = high
        sequence = int(run[-1])


def pack(docs: DataFrame, tokenizer: str, proportions: Mapping[str | None, float] | None = None, key: str = "doc_id", text: str = "text",
         source: str = "source") -> DataFrame:
    """All documents as pieces of sequences of SEQUENCE tokens, each filled to the target proportions of the sources.

    Without ``proportions`` the target is the corpus itself, so every sequence has the mixture of the whole and all queues end
    together; with them (positive numbers; a source not listed has the smallest), a queue that ends leaves its share to the rest.
    Every listed source has its own queue, however small it is. Sources that share a queue follow one another there, so windows hold
    the share of the queue and not that of each of them.
    The last tokens fill sequences of falling powers of two, so there is no padding.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``. A null text is empty and
    has the end id alone; a null source is a source; repeated rows are packed each; an empty table gives no rows; other columns are
    ignored.
    """
    rows = tokenized(docs, tokenizer, key, text, source)
    few = partitions(rows.sparkSession) // 16 + 1  # a row for each task and source needs no file for each shuffle partition
    parts = written(rows.groupBy("part", "source").agg(F.max(F.col("at") + F.col("n")).alias("tokens")).coalesce(few), "part-sources")
    sizes = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    largest = sizes.orderBy(F.desc("tokens"), F.asc_nulls_first("source")).limit(OWN_QUEUES).collect()
    own = {name: i for i, name in enumerate(dict.fromkeys([*(r["source"] for r in largest), *(proportions or ())]))}
    names = parts.sparkSession.createDataFrame([(k, i) for k, i in own.items()], "_name string, _queue int")
    shared = F.pmod(F.xxhash64("source"), F.lit(SHARED_QUEUES)).cast("int") + max(OWN_QUEUES, len(own))
    queued = (parts.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name")), "left")
              .withColumn("queue", F.coalesce("_queue", shared)).drop("_name", "_queue"))
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(queued.withColumn("_start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(few), "queue-starts")
    sums = starts.groupBy("queue").agg(F.sum("tokens"), F.count("*")).collect()
    totals, n_starts = {queue: tokens for queue, tokens, _ in sums}, sum(n for _, _, n in sums)
    queues = sorted(totals)
    counts = np.array([totals[q] for q in queues], np.int64)
    if proportions is None:
        rates = counts.astype(np.float64)
    else:
        by_queue = {own[name]: share for name, share in proportions.items()}
        held = dict(starts.groupBy("queue").agg(F.count_distinct(F.struct("source"))).collect())  # a struct, so a null source counts
        rates = np.array([by_queue.get(q, min(proportions.values()) * held[q]) for q in queues], np.float64)
    position = {q: i for i, q in enumerate(queues)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotas = Quotas(counts, rates)
        for batch in it:
            doc_id, n, at, start, part, queue = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("doc_id", "n", "at", "_start", "part", "queue"))
            known = batch.column("doc_id")
            place = start + at
            order = np.lexsort((place, queue))
            split = np.flatnonzero((np.diff(queue[order]) != 0) | (place[order][1:] != (place + n)[order][:-1])) + 1
            for rows_ in np.split(order, split):
                if not len(rows_):
                    continue
                ids = [np.frombuffer(batch.column("ids")[int(r)].as_buffer(), "<u2" if len(batch.column("ids")[int(r)].as_buffer()) == 2 * n[r] else "<u4")
                       .astype("<u4").tobytes() for r in rows_]
                for doc, first, length, sequence, offset in _pieces(quotas, position[int(queue[rows_[0]])], place[rows_], n[rows_]):
                    crc = [zlib.crc32(memoryview(ids[d])[4 * a:4 * (a + k)]) for d, a, k in zip(doc.tolist(), first.tolist(), length.tolist(), strict=True)]
                    rows = rows_[doc]
                    yield pa.RecordBatch.from_arrays(
                        [known.take(pa.array(rows)), pa.array(first), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[rows]),
                         pa.array(sequence), pa.array(offset), batch.column("source").take(pa.array(rows))],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    to_ids = starts.select(F.col("part").alias("_p"), F.col("source").alias("_s"), "queue", "_start")
    joined = rows.join(F.broadcast(to_ids) if n_starts <= BROADCAST_STARTS else to_ids, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_p", "_s")
    return joined.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
