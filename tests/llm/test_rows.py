"""Sharding and mixing against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from daygauge.llm import mixing, sharding


def plain_place(row, rows, seed):
    a, b = sharding.sides(rows)
    keys = sharding.round_keys(seed)
    while True:
        u, v = divmod(row, b)
        for i, (p, q, r, s) in enumerate(keys):
            u, v = v, (u + ((v + p) * q % sharding.PRIMES[0] * r + s) % sharding.PRIMES[1]) % (a, b)[i % 2]
        row = u * b + v
        if row < rows:
            return row


def test_permutation_is_one_for_any_number_of_rows():
    for rows in (1, 2, 3, 5, 17, 100, 999):
        assert sorted(plain_place(i, rows, 5) for i in range(rows)) == list(range(rows))


def test_shards_follow_the_permutation(documents, odd):
    rows = odd + [(100 + i, f"t {i}") for i in range(61)]
    got = sharding.shard_rows(documents(rows), shards=7, seed=5).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8)
    want = Counter()
    for i, r in enumerate(sorted(rows, key=key)):
        place = plain_place(i, len(rows), 5)
        want[(r[0], key(r)[3], key(r)[2], "rows", place % 7, place // 7, None)] += 1
    assert Counter(tuple(r) for r in got) == want
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_empty_tables(documents):
    assert sharding.shard_rows(documents([])).count() == 0
    assert mixing.mix(documents([])).count() == 0


def bits(*of):
    return int(hashlib.md5(":".join(of).encode()).hexdigest()[:13], 16)


def plain_copies(doc_id, text, rate, seed):
    parts = max(math.ceil(rate / mixing.PART_RATE), 1)
    total = 0
    for j in range(1, parts + 1):
        u = bits(str(seed), "draw", "" if doc_id is None else str(doc_id), hashlib.md5((text or "").encode()).hexdigest(), str(j)) / (1 << 52)
        term = c = math.exp(-rate / parts)
        k = 0
        while c <= u:
            k += 1
            term *= rate / parts / k
            c += term
            total += 1
    return total


def test_copies_are_the_inverse_of_the_distribution(documents, odd):
    rows = [(i, t, s) for (i, t), s in zip(odd, "abcabcabcabcab", strict=True)] + [(500 + i, "word " * (i + 1), "rare" if i < 2 else None) for i in range(40)]
    weights = {"a": 1.0, "b": 0.0, "rare": 5.0}
    got = mixing.mix(documents(rows), weights=weights, default_weight=2.0, epoch=3.0, seed=3).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t or "")
    weigh = {s: (weights.get(s, 2.0) if n else 0.0) for s, n in sizes.items()}
    whole, chars = sum(weigh.values()), sum(sizes.values())
    rate = {s: weigh[s] / whole * 3 * chars / n if n else 0.0 for s, n in sizes.items()}
    assert max(rate.values()) > mixing.PART_RATE  # a rate in parts is among them
    want = Counter()
    for i, t, s in rows:
        copies = plain_copies(i, t, rate[s], 3)
        want.update((i, t, s, copies, c) for c in range(1, copies + 1))
    assert Counter((r["doc_id"], r["text"], r["source"], r["copies"], r["copy"]) for r in got) == want
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys)
    assert all(r["doc"] == "x" and r["score"] == 9.0 for r in got)


def test_many_sources_join_by_salt(documents, monkeypatch):
    rows = [(i, "word " * 9, f"s{i % 5}") for i in range(60)]
    small = mixing.mix(documents(rows)).select("doc_id", "copy").collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(mixing.mix(documents(rows)).select("doc_id", "copy").collect()) == sorted(small)


def test_repeated_rows_draw_one_by_one(spark, documents):
    rows = [(None, "one text of many rows", "hot")] * 6000 + [(1, "some other words", None), (2, "more", "b")]
    docs = documents(rows).repartition(5)
    got = mixing.mix(docs, weights={"hot": 1.0, None: 3.0, "b": 1.0}, epoch=1.0, seed=2)
    sizes = {"hot": 6000 * 21, None: 16, "b": 4}
    rate = 1.0 / 5.0 * sum(sizes.values()) / sizes["hot"]
    hot = got.where("source = 'hot'")
    n = hot.count()
    assert abs(n - 6000 * rate) < 5 * math.sqrt(6000 * rate)
    assert hot.select("shuffle_key").distinct().count() > 0.99 * n
    parts = [len(p) for p in got.rdd.glom().collect()]
    assert max(parts) < 0.5 * sum(parts)
    assert got.where("source IS NULL").count() > 1000  # three fifths of the corpus from 16 code points
    assert sorted(got.select("doc_id", "shuffle_key").collect(), key=str) == sorted(
        mixing.mix(docs.repartition(3), weights={"hot": 1.0, None: 3.0, "b": 1.0}, epoch=1.0, seed=2).select("doc_id", "shuffle_key").collect(), key=str)


def test_inner_names_give_way(documents):
    docs = documents([(i % 5, "word " * (i % 3 + 1), "ab"[i % 2]) for i in range(30)])
    for name in ("_mix_nth", "_mix_source", "_mix_parts", "_mix_cdf", "_MIX_SALT", "_mix_hash", "_tie", "_part", "_n"):
        docs = docs.withColumn(name, F.lit(1))
    got = mixing.mix(docs)
    assert got.columns == [*(c for c in docs.columns if c not in mixing.OWN), "copies", "copy", "shuffle_key"]
    assert got.count() > 0 and got.where("_mix_nth <> 1 OR _tie <> 1").count() == 0
