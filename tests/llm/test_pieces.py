"""SentencePiece ids against the library."""

import hashlib
import random

import pytest

from daygauge.llm import pieces

SIGNS = ["a", "b", "th", "er", "  ", " ", "\n", "▁", "é", "漢", "字", "😀", "\x00", "\t", "1", "2", "***", "#", "ing", "tion", "A", "T", "́",
         "ञ", "…", "", "Ж", "де", "</s>", "<0x0A>", "<s>", "▁▁", "."]


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder.of(pieces.default_model())


def plain_ids(encoder, segment):
    """The merges themselves: the best score, the leftmost of equals."""
    symbols = list(segment)
    while True:
        found = [(-encoder.scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in encoder.scores]
        if not found:
            return symbols
        i = min(found)[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


def test_ids_are_those_of_the_library(encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += [" " * n for n in range(70)] + [" " * n + "the" for n in range(70)] + ["ab" * 5000, "tion" * 3000, "x" * 9999, " " * 4001]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.library.encode(text), text


def test_compatible_pairs_are_those_that_no_merge_joins(encoder):
    rng = random.Random(5)
    names = [p for p, n in encoder.numbers.items() if n in encoder.lengths]
    for _ in range(3000):
        one, two = rng.choice(names[:3000]), rng.choice(names[:3000])
        assert encoder.compatible(encoder.numbers[one], encoder.numbers[two]) == (plain_ids(encoder, one + two) == [one, two]), (one, two)


def test_kept_segments_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_SEGMENTS", 10)
    texts = [f"word{i} and {i * i}" for i in range(50)]
    for text in texts:
        assert [i.tolist() for i in encoder.encode([text])] == [encoder.library.encode(text)]
    assert len(encoder.kept) < 40


def test_odd_rows(documents, odd, encoder):
    docs = documents([*odd, (50, "a  b\t\n ▁c")]).withColumnRenamed("doc", "ids").withColumnRenamed("kept", "decoded")
    got = pieces.encode_pieces(docs, pieces.default_model()).collect()
    assert len(got) == len(odd) + 1
    for r in got:
        want = encoder.library.encode(r["text"] or "")
        assert (list(r["ids"]), r["n_tokens"], r["decoded"]) == (want, len(want), encoder.library.decode(want) if want else "")
        assert r["score"] == 9.0
    assert pieces.encode_pieces(documents([]), pieces.default_model()).count() == 0


def test_query(spark, sf_dir, encoder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = pieces.op13_pieces(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = encoder.library.encode(texts[r["doc_id"]] or "")
        decoded = encoder.library.decode(ids) if ids else ""
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
