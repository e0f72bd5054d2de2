"""Each stage against what its predecessor kept."""

import re

import corpus_pipeline
from daygauge.llm import packing
from daygauge.llm.common import written

from .test_duplicates import Union, plain_print, plain_removed
from .test_packing import checked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], sf_dir), "stage"))
    assert all(f.columns == COLUMNS for f in frames[:-1])
    given, good, single, whole, mixed, pieces = ([tuple(r) for r in f.collect()] for f in frames)
    kept = {r[0] for r in good}
    assert set(good) <= set(given)
    assert sum((i in kept) == (labels[i] == 1) for i in labels) >= 0.9 * len(labels)
    prints, union = {r[0]: plain_print(r[1]) for r in good}, Union(kept)
    for a in kept:
        for b in kept:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                union.join(a, b)
    assert {r[0] for r in single} == {union.find(i) for i in kept} and set(single) <= set(good)
    want = {}
    removed = plain_removed([r[:2] for r in single])
    for r in single:
        n, gone, text = removed[r[0]]
        if not gone or gone < n:
            own = text if gone else r[1]
            want[r[0]] = (r[0], own, *r[2:4], len(own) if gone else r[4])
    assert {r[0]: r for r in whole} == want and len(whole) == len(want)
    assert set(mixed) <= set(whole) and mixed
    rows = [dict(zip(frames[-1].columns, p, strict=True)) for p in pieces]
    tokens = {}
    for p in rows:
        tokens[p["doc_id"]] = p["doc_tokens"]
    assert sum(p["length"] for p in rows) == sum(tokens[r[0]] for r in mixed)


def test_repeated_and_odd_rows_of_a_group(spark, documents, odd):
    got = corpus_pipeline.one_of_each_group(spark, documents(odd), "").collect()
    texts = [re.sub(r"\s+", " ", r["text"] or "").strip() for r in got]
    assert len(texts) == len(set(texts)) and "one two three four" in texts


def test_run(spark, sf_dir):
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.count() > 0
    assert result.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    assert packing.SEQUENCE == 2048 and checked
