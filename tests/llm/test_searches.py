"""Fingerprints of edited texts and nearest neighbours against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from daygauge.llm import nearest, piecewise


def test_edit_distance_is_the_table():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 70))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        assert piecewise.edit_distance(a, b) == row[-1]


def test_fingerprint():
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    own = piecewise.fingerprint(text.encode())
    assert own == piecewise.fingerprint(text.encode()) and piecewise.compare(own, own) == 1.0
    inserted = piecewise.fingerprint((text[:8000] + " some words put in " + text[8000:]).encode())
    assert piecewise.compare(own, inserted) > 0.85
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    assert piecewise.compare(own, piecewise.fingerprint(other.encode())) == 0.0
    assert piecewise.fingerprint(b"").count(":") == 2 and piecewise.compare(piecewise.fingerprint(b""), own) == 0.0
    assert max(map(len, piecewise.fingerprint(b"As " * 50_000).split(":"))) <= piecewise.MOST
    assert 0.5 < piecewise.compare(own, piecewise.fingerprint(text[: len(text) * 3 // 4].encode())) < 1


def test_edited_texts(documents):
    rng = random.Random(8)
    rows = [(i * 3, " ".join(rng.choice(["ab", "cde", "é漢", "f"]) for _ in range(rng.randrange(0, 300)))) for i in range(70)] + [(1, None), (2, "xyz")]
    got = {r["doc_id"]: r for r in piecewise.compare_edited(documents(rows).repartition(4)).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows, key=lambda r: r[0])]
    assert set(got) == {i for i, _ in ordered}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        q = len(t) // 4
        edited = (t[:len(t) - q] + after[:q]).encode()
        a, b, c = (piecewise.fingerprint(x) for x in (t.encode(), edited, after.encode()))
        want = (len(t), hashlib.sha256(edited).hexdigest(), a, b, piecewise.compare(a, b), piecewise.compare(a, c))
        assert tuple(got[i])[1:] == want


def test_odd_documents(documents, odd):
    rows = piecewise.compare_edited(documents(odd)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in odd)
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 0}) == 1
    assert piecewise.compare_edited(documents([])).count() == 0
    (alone,) = piecewise.compare_edited(documents([(5, "only one here")])).collect()
    assert alone["near_next"] == 1.0
    assert piecewise.fingerprints(documents(odd)).count() == len(odd)


def test_many_documents_alike_in_key_and_text(documents, monkeypatch):
    monkeypatch.setattr(piecewise, "ALIKE", 300)
    rows = [(7, "the same words, " * 30)] * 1000 + [(None, None)] * 301 + [(i, f"text {i} " * 40) for i in range(20)] + [(7, "another of that id")] * 2
    found = piecewise.compare_edited(documents(rows).repartition(5))
    got = Counter(tuple(r) for r in found.collect())
    once = Counter(tuple(r) for r in piecewise.compare_edited(documents(list(dict.fromkeys(rows))).repartition(3)).collect())
    assert set(got) == set(once) and sum(got.values()) == len(rows)
    assert sorted(got.values())[-3:] == [2, 301, 1000]


def brute(rows, k, every):
    live = sorted({(i, tuple(v)) for i, v in rows})
    out = set()
    for i, v in live:
        if i % every == 0:
            scored = sorted(((-float(np.dot(np.array(v), np.array(w))), j) for j, w in live if j != i))[:k]
            out |= {(i, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(scored, 1)}
    return out


def test_exact_search_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 150)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(500)] + [(1000 + i, [1.5, 0.25, -2.0, 0.5, 0.0, 1.0]) for i in range(90)]
    bad = [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [math.nan] * 6), (2080, [math.inf] + [1.0] * 5), (2100, [1.0]),
           (None, [1.0] * 6), (20, rows[20][1])]
    frame = spark.createDataFrame([(i, v, 3, "x") for i, v in rows + bad], "vec_id bigint, embedding array<double>, score int, ids string")
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest.nearest(frame, factor=1.0).collect()}
    assert got == brute(rows, 20, 20)


def test_few_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    got = nearest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2)]
    assert nearest.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest.nearest(spark.createDataFrame([(7, None), (20, [0.0])], schema)).count() == 0
    assert nearest.nearest(spark.createDataFrame([(20, [1.0])], schema)).count() == 0


def test_recall_of_the_default_factor(spark, sf_dir):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r[0], r[1]) for r in frame.select("vec_id", "embedding").collect()]
    want = {(q, j) for q, _, j, _ in brute(rows, 20, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in nearest.nearest(frame).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_ties_of_products_go_by_id(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-1, 2, size=12).astype(float).tolist()) for i in rng.permutation(3000)]
    rows += [(5000 + i, rng.integers(-1, 2, size=5).astype(float).tolist()) for i in range(60)]  # another length, for itself
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3), k=20, factor=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    seen = 0
    for i, v in rows:
        if i % 20 or not any(v):
            continue
        others = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v) and any(w))[:20]
        assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(others, 1)]
        seen += 1
    assert seen > 100 and len(got) == seen
