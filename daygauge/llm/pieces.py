"""SentencePiece encoding and decoding by a table of the last token of each prefix."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.llm.common import query, schema_with, table

#: The sign that stands for a space in pieces. Fixed value.
SPACE = "▁"
#: Segments whose ids, and pairs of tokens whose test, a worker keeps.
KEPT_SEGMENTS, KEPT_PAIRS = 600_000, 2_000_000
#: Characters by which neighbours in the order of segments are compared; they share the table of a longer common start only in part.
COMPARED = 24
#: Texts encoded at once.
TEXTS = 1024
OWN = ("ids", "n_tokens", "decoded")


class State(dict):
    """A state of the matching automaton: the next state by character, filled as characters come, and the pieces that end here, longest first.

    A piece is its length, its number and what is known of it after other tokens.
    """

    __slots__ = ("longer", "rest", "root", "ends")

    def __init__(self, root: State | None = None):
        super().__init__()
        self.longer: dict[str, State] = {}
        self.root = self if root is None else root
        self.rest = self.root
        self.ends: tuple[tuple[int, int, dict[int, bool]], ...] = ()

    def __missing__(self, char: str) -> State:
        found = self.longer.get(char)
        if found is None:
            found = self.root if self is self.root else self.rest[char]
        self[char] = found
        return found


def automaton(words: dict[str, tuple[int, int, dict[int, bool]]]) -> State:
    """A trie of the words in which each state knows the state of its longest proper ending."""
    root = State()
    for word, end in words.items():
        state = root
        for char in word:
            if char not in state.longer:
                state.longer[char] = State(root)
            state = state.longer[char]
        state.ends = (end,)
    level = [(root, char, state) for char, state in root.longer.items()]
    while level:
        below = []
        for parent, char, state in level:
            if parent is not root:
                state.rest = parent.rest[char]
                state.ends += state.rest.ends
            below += [(state, c, s) for c, s in state.longer.items()]
        level = below
    return root


class PieceEncoder:
    """Token ids of a SentencePiece BPE model, without its agenda of merges.

    The library merges, again and again, the adjoining symbols whose piece has the best score, the leftmost of equals. Merges do not
    cross the border of two final tokens, so the start of an encoding is the encoding of the start, and a sequence is an encoding if
    and only if each adjoining pair of its tokens is one. So each prefix of a text has one last token, the only match ending there that
    is compatible with the last token of what stands before it; a table of them is filled from left to right, and read backwards it
    gives the ids.
    """

    _shared: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with unused or user-defined pieces are not supported")
        plain = model.normalizer_spec
        self.simple = (not plain.precompiled_charsmap and plain.add_dummy_prefix and not plain.remove_extra_whitespaces
                       and plain.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix)
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.numbers = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = [next(i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE and int(p.piece[1:-1], 16) == b) for b in range(256)]
        self.size = len(model.pieces)
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        self.lengths: dict[int, int] = {}
        self.tested: dict[int, dict[int, bool]] = {number: {} for number in self.numbers.values()}
        self.matcher = automaton({piece: (len(piece), number, self.tested[number]) for piece, number in self.numbers.items()
                                  if self._known(number, piece)})
        # No merge crosses a place whose two characters adjoin in no piece: before a space sign after another sign, and around
        # characters that stand in no longer piece.
        longer = [p for p in self.numbers if len(p) > 1]
        joined = {c for p in longer for c in p} - {SPACE}
        letters = "".join(re.escape(c) for c in sorted(joined))
        spaces_lead = all(SPACE not in p.lstrip(SPACE) for p in longer)
        self.segments = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|[^{SPACE}{letters}]" if spaces_lead and letters else f"[{SPACE}{letters}]+|[^{SPACE}{letters}]")
        self.forget()

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def forget(self) -> None:
        self.kept: dict[str, bytes] = {}
        self.pairs = 0
        for known in self.tested.values():
            known.clear()

    def _known(self, number: int, piece: str) -> bool:
        """Keep how a token grows at its two ends; False if its text is not encoded as this one token."""
        symbols, steps = list(piece), []
        while len(symbols) > 1:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.scores]
            if not found:
                return False
            cost, i = min(found)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            steps.append((-cost, symbols[0], symbols[-1]))
        self.lengths[number] = len(piece)
        self.right[number] = ((0.0, piece[-1]), *((score, last) for score, _, last in steps))
        self.left[number] = ((0.0, piece[0]), *((score, first) for score, first, _ in steps))
        return True

    def compatible(self, one: int, two: int) -> bool:
        """Whether the text of two tokens is encoded as these two.

        Both grow by their own merges, the better score first; they are compatible if the symbols at the border never have a better
        one. Of equal scores the leftmost goes first: in the first token, across the border, in the second.
        """
        first, second = self.right[one], self.left[two]
        i = j = 0
        while True:
            across = self.scores.get(first[i][1] + second[j][1])
            a = first[i + 1][0] if i + 1 < len(first) else None
            b = second[j + 1][0] if j + 1 < len(second) else None
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def _single(self, char: str) -> int:
        """The token of one character; one that is no piece has a number of its own behind the pieces."""
        number = self.numbers.get(char, self.size + ord(char))
        if number not in self.right:
            self._known(number, char)
        return number

    def learn(self, segments: list[str]) -> None:
        """Keep the ids of segments. In their order a segment shares the table of the start it has in common with the one before."""
        lengths = np.array([len(p) for p in segments])
        signs = np.array(segments, f"U{COMPARED}").view(np.uint32).reshape(-1, COMPARED)
        same = np.minimum.accumulate(signs[1:] == signs[:-1], axis=1).sum(axis=1)
        shared = [0, *np.minimum(same, np.minimum(lengths[1:], lengths[:-1])).tolist()]
        tokens: list[int] = []
        begins: list[int] = []
        states = [self.matcher]
        size = self.size
        for segment, common in zip(segments, shared, strict=True):
            del tokens[common:], begins[common:], states[common + 1:]
            state = states[-1]
            for end in range(common, len(segment)):
                state = state[segment[end]]
                states.append(state)
                for length, number, known in state.ends:
                    begin = end + 1 - length
                    if not begin:
                        break
                    before = tokens[begin - 1]
                    fits = known.get(before)
                    if fits is None:
                        fits = known[before] = self.compatible(before, number)
                        self.pairs += 1
                    if fits:
                        break
                else:
                    begin, number = end, self._single(segment[end])
                tokens.append(number)
                begins.append(begin)
            out, end = [], len(segment)
            while end:
                number, end = tokens[end - 1], begins[end - 1]
                if number < size:
                    out.append(number)
                else:
                    out.extend(self.bytes[b] for b in reversed(segment[end].encode("utf-8")))
            out.reverse()
            self.kept[segment] = array("i", out).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.kept) > KEPT_SEGMENTS or self.pairs > KEPT_PAIRS:
            self.forget()
        if self.simple:
            texts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        else:
            texts = [self.library.normalize(t) for t in texts]
        parts = list(map(self.segments.findall, texts))
        new = set().union(*parts).difference(self.kept)
        if new:
            self.learn(sorted(new))
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, p)), np.int32) for p in parts]


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with the ids of a SentencePiece model, their number, and the text that the model decodes from them.

    ``model`` is the path of a BPE model with byte fallback, the same on every machine. Returns the columns of ``docs`` with ``ids``
    (array of int), ``n_tokens`` and ``decoded``; columns with these names are replaced. A null text is empty and has no id; repeated
    rows are encoded each; an empty table gives no rows. Nothing is shuffled.
    """
    base = docs.drop(*OWN)
    schema = schema_with(base, ("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("decoded", T.StringType()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(model)
        for whole in it:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                found = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
                lengths = np.array([len(ids) for ids in found], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                flat = np.concatenate(found)
                decoded = [encoder.library.decode(ids.tolist()) if len(ids) else "" for ids in found]
                added = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(lengths), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *OWN])

    return base.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_pieces")
def op13_pieces(spark, sf_dir):
    found = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model())
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
