"""SimHash groups and repeated passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from daygauge.llm import simhash, substrings
from daygauge.llm.components import components


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fuzzy_keys_meet_at_two_bits():
    rng = random.Random(1)
    for _ in range(300):
        one = rng.getrandbits(64)
        two = one
        for b in rng.sample(range(64), rng.randrange(3)):
            two ^= 1 << b
        where, keys = simhash.fuzzy_keys(np.array([one, two], np.uint64))
        assert set(keys[where == 0].tolist()) & set(keys[where == 1].tolist())


def test_links_with_large_buckets(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(300)} | {centre ^ 1 << b for b in range(0, 64, 3)}
    for p in list(prints)[:60]:
        prints.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    want = Union(signed)
    for i, a in enumerate(signed):
        for b in signed[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                want.join(a, b)
    found = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "simhash bigint"))).collect()
    got = {r["node"]: r["component"] for r in found}
    assert {p: got.get(p, p) for p in signed} == {p: want.find(p) for p in signed}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5), (7, 6), (7, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 1000: 1000, **{2000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(documents, odd):
    base = " ".join(f"word{i}" for i in range(400))
    rows = odd + [(20, base), (21, base.replace("word7 ", "other ")), (22, base.upper()), (23, "A"), (24, "one  two\tthree FOUR")]
    got = simhash.near_duplicates(documents(rows)).collect()
    prints = [plain_print(t) for _, t in rows]
    union = Union(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                union.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[union.find(i)] = min(least.get(union.find(i), doc), doc)
    want = Counter((doc, int(np.uint64(p).astype(np.int64)), least.get(union.find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(documents([])).count() == 0


def plain_removed(rows):
    """By (id, text): words, removed, kept; ids unique."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        cover = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s:s + 20])
            if window in seen:
                cover[s:s + 20] = [True] * 20
            seen.add(window)
        out[doc] = len(words), sum(cover), " ".join(w for w, c in zip(words, cover, strict=True) if not c)
    return out


def test_removed_words(documents):
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    rows = [(0, "x " * 500), (1, "x y " * 40), (2, "x " * 19), (3, None)]
    for i in range(10, 130):
        words = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            words += [rng.choice("pqr") + str(rng.randrange(50)) for _ in range(rng.randrange(0, 12))] + p[a:len(p) - rng.randrange(0, 8)]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(200 + i, rows[20][1]) for i in range(40)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup_substrings(documents(rows).repartition(5)).collect()}
    assert got == plain_removed(rows)
    assert sum(n for _, n, _ in got.values()) > 1000


def test_removed_words_with_odd_rows(documents, odd):
    got = substrings.dedup_substrings(documents(odd)).collect()
    assert len(got) == len(odd) and {"doc", "_n", "score"} <= set(got[0].asDict())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10]["n_removed"] == by_id[10]["n_words"] == 30_000 and by_id[5]["n_removed"] > 0
    assert by_id[1]["n_words"] == by_id[4]["n_words"] == 0 and by_id[4]["kept"] == ""
    assert sorted(r["kept"] for r in got if r["doc_id"] == 8) == ["other text of the id", "same id"]
    assert substrings.dedup_substrings(documents([])).count() == 0


def test_rows_of_one_id_are_ordered_and_alike_rows_are_one(documents):
    passage = " ".join(f"p{i}" for i in range(30))
    got = substrings.dedup_substrings(documents([(1, passage), (1, passage), (1, "before " + passage), (2, passage)])).collect()
    removed = sorted((r["doc_id"], r["text"] == passage, r["n_removed"]) for r in got)
    assert removed[-1] == (2, True, 30)
    alike = {n for i, same, n in removed if i == 1 and same}
    assert len(alike) == 1 and sorted(alike | {n for i, same, n in removed if i == 1 and not same}) == [0, 30]


@pytest.mark.parametrize("n", [30, substrings.CHUNK_WORDS + 30])  # one chunk for both rows, and one for each
def test_alike_rows_do_not_repeat_themselves(documents, n):
    passage = " ".join(f"p{i}" for i in range(n))
    rows = documents([(1, passage)]).union(documents([(1, passage)])).union(documents([(2, "q " + " ".join(f"p{i}" for i in range(25)))]))
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(rows).collect()]
    assert sorted(got) == [(1, n, 0), (1, n, 0), (2, 26, 25)]
