"""Pieces against the tokenizer and the targets."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from daygauge.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return packing.default_tokenizer()


def checked(pieces, rows, path):
    own = Tokenizer.from_file(path)
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        x = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(x)
        assert p["ids_crc32"] == zlib.crc32(x[p["start"]:p["start"] + p["length"]].tobytes())
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"], p["source"]))
    for i, x in ids.items():
        assert [s for s, _ in sorted(by_doc[i])] == [0, *np.cumsum([n for _, n in sorted(by_doc[i])])[:-1]] and sum(n for _, n in by_doc[i]) == len(x)
    for k, own in by_sequence.items():
        own.sort()
        assert [a for a, *_ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]]
    sizes = [sum(n for _, n, _ in by_sequence[k]) for k in sorted(by_sequence)]
    assert sorted(by_sequence) == list(range(len(sizes)))
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    return by_sequence, sizes


def test_pieces(documents, tokenizer):
    rows = [(i, f"Some words of document {i}, naïve é 漢字 <|endoftext|> it's " * (1 + i * 7 % 40), f"s{i % 3}" if i % 11 else None) for i in range(120)]
    rows += [(1000, None, "s1"), (1001, "", "s9"), (1002, "word " * 30_000, "s0"), (1003, "a b c\x85d\x1ce", "s2")]
    by_sequence, sizes = checked(packing.pack(documents(rows).repartition(3), tokenizer).collect(), rows, tokenizer)
    total = defaultdict(int)
    for own in by_sequence.values():
        for _, n, s in own:
            total[s] += n
    whole = sum(total.values())
    for k, n in enumerate(sizes):
        if n == 2048:
            for s, all_ in total.items():
                got = sum(m for _, m, of in by_sequence[k] if of == s)
                assert abs(got - 2048 * all_ / whole) < 2


def test_each_of_many_sources_has_its_share_of_every_window(documents, tokenizer):
    rows = [(i, f"text of {i} " * (20 + i % 7), f"s{i % 300}") for i in range(900)]
    by_sequence, sizes = checked(packing.pack(documents(rows).repartition(2), tokenizer).collect(), rows, tokenizer)
    total = defaultdict(int)
    for own in by_sequence.values():
        for _, n, s in own:
            total[s] += n
    whole = sum(total.values())
    assert len(total) == 300 and sizes.count(2048) > 10
    for k, n in enumerate(sizes):
        if n == 2048:
            got = defaultdict(int)
            for _, m, s in by_sequence[k]:
                got[s] += m
            assert all(abs(got[s] - 2048 * all_ / whole) <= 2 for s, all_ in total.items())


def test_given_proportions(documents, tokenizer):
    rows = [(i, "plain words here " * 200, "ab"[i % 2]) for i in range(40)]
    by_sequence, _ = checked(packing.pack(documents(rows), tokenizer, proportions={"a": 3.0, "b": 1.0}).collect(), rows, tokenizer)
    first = defaultdict(int)
    for _, n, s in by_sequence[0]:
        first[s] += n
    assert first["a"] == 1536 and first["b"] == 512


def test_many_sources_share_queues(documents, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "OWN_QUEUES", 2)
    rows = [(i, f"text of {i} " * 30, f"s{i % 17}") for i in range(100)]
    checked(packing.pack(documents(rows), tokenizer).collect(), rows, tokenizer)


def test_listed_sources_keep_their_proportions(documents, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "OWN_QUEUES", 1)
    monkeypatch.setattr(packing, "SHARED_QUEUES", 1)
    rows = [(i, "plain words here " * 200, "a") for i in range(30)] + [(100 + i, "plain words here " * 200, "bcde"[i % 4]) for i in range(40)]
    by_sequence, _ = checked(packing.pack(documents(rows), tokenizer, proportions={"a": 2.0, "b": 4.0, "c": 1.0}).collect(), rows, tokenizer)
    first = defaultdict(int)
    for _, n, s in by_sequence[0]:
        first[s if s in "abc" else "other"] += n
    assert all(abs(first[s] - 2048 * share / 9) < 2 for s, share in (("a", 2), ("b", 4), ("c", 1), ("other", 2)))


def test_quotas_are_consistent():
    rng = np.random.default_rng(3)
    totals = np.append(rng.integers(1, 10_000, 20), [1, 1, 2])
    quotas = packing.Quotas(totals, totals.astype(float))
    served = quotas.served(np.arange(quotas.all + 1))
    assert (served.sum(axis=1) == np.arange(quotas.all + 1)).all() and (np.diff(served, axis=0) >= 0).all()
    assert (served[-1] == totals).all()


def test_odd_rows(documents, odd, tokenizer):
    got = packing.pack(documents(odd), tokenizer).collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert packing.pack(documents([]), tokenizer).count() == 0


def each_text(words, texts):
    ids, begins = words.ids(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 22])
def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    words, rng = packing.WordIds(tokenizer), np.random.default_rng(5)
    some = [*"abSTzZé\u00c8\u0178\u0131\u0130\u03a3\u03c3漢😀\u0301\u00a0\u0085\x1c\x00\x7f0123'’.,<|>…€-– \t\n\x0b\f\r", " ", " ", "'s", "'RE", "'ll", "don't", "<|endoftext|>", "<|EndOfText|>",
            " word ", "l'\u00c9tat", "\u039f\u03a3 "]
    texts = ["".join(rng.choice(some, rng.integers(0, 40))) for _ in range(400)] + [None, "", " ", "'", "s", "<", "|endoftext|>", "'", "s'", "S", "", None, "x" * 300, "é" * 300]
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    own = words.tokenizer
    expected = [[*own.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for low in range(0, len(texts), 37):
        assert each_text(words, texts[low:low + 37]) == expected[low:low + 37]
    assert each_text(words, [None, ""]) == [[1], [1]] and each_text(words, []) == []
    ids, begins = words.ids(pa.array(texts, pa.string()).slice(5, 90))
    assert ids.tolist() == [i for x in expected[5:95] for i in x] and begins[-1] == len(ids)


def test_words_in_use_are_not_encoded_again_when_others_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 60)
    words, given = packing.WordIds(tokenizer), []
    own = words.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **more):
            given.extend(w for t in texts for w in t.split())
            return own.encode_batch_fast(texts, **more)

        def encode(self, text, **more):
            given.extend(text.split())
            return own.encode(text, **more)

    words.tokenizer = Counted()
    common = "alpha beta gamma delta 7 ."
    for i in range(20):
        rare = " ".join(f"{chr(97 + i)}{chr(97 + k)}q" for k in range(20))
        text = f"{common} {rare}"
        assert each_text(words, [text]) == [[*own.encode(text, add_special_tokens=False).ids, 1]]
        assert len(words.number) <= 60
    assert len(given) == len(set(given)) == 20 * 20 + 6


def test_counts_land_in_few_files_and_ids_stay_where_they_are(documents, tokenizer, spark, monkeypatch):
    files, own = {}, packing.written

    def counted(df, label):
        out = own(df, label)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(packing, "written", counted)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in held}
    rows = [(i, f"text of {i} " * 30, f"s{i % 40}") for i in range(200)]
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        found = packing.pack(documents(rows), tokenizer)
        checked(found.collect(), rows, tokenizer)
        assert files["part-sources"] <= 4 and files["queue-starts"] <= 4
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().toString()
        monkeypatch.setattr(packing, "BROADCAST_STARTS", 3)
        checked(packing.pack(documents(rows), tokenizer).collect(), rows, tokenizer)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
