"""Classifiers by held-out accuracy, their parts by brute force."""

import random
import zlib

import pytest

from daygauge.llm import quality, toxicity
from daygauge.llm.common import held_out, table, training_rows
from daygauge.llm.piecewise import edit_distance

DATA = "/root/testdata/sf0.01"


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").where(f"{label} is not null").select("doc_id", "predicted", label).collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


@pytest.mark.parametrize(("operator", "label", "least"), [(quality.score_quality, "quality", 0.95), (toxicity.score_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, operator, label, least):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    scored = operator(docs, labels)
    assert scored.columns == [*docs.columns, "score", "predicted"]
    assert accuracy(scored.select("doc_id", "predicted"), labels, label) >= least


@pytest.mark.parametrize(("operator", "label", "without"), [(quality.score_quality, "quality", 0.5), (toxicity.score_toxicity, "toxic", 0.0)])
def test_odd_rows(spark, documents, odd, operator, label, without):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    rows = operator(documents(odd), labels).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert len({r["score"] for r in rows if r["text"] == "one two three four"}) == 1
    assert {r["score"] for r in operator(documents(odd), labels.limit(0)).collect()} == {without}
    assert operator(documents([]), labels).count() == 0


def test_passages_cover_the_whole_text():
    features, first = quality.passage_features(["", "short", "x" * 5000, "é " * 3000])
    assert first.tolist() == [0, 1, 2, 9] and len(features) == 21  # 5000 = 6 * 768 + 392, 9000 = 11 * 768 + 552


def test_later_passages_count(spark):
    docs = [(i, ("good plain words here. " * 60) if i % 2 else "good plain words here. " * 30 + "### $$$ %%% " * 200) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    scored = quality.score_quality(frame, labels)
    assert accuracy(scored.select("doc_id", "predicted"), labels, "quality") == 1.0


def test_automaton_is_the_nearest_term_within_the_edits():
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 12))) for _ in range(60)})
    automaton = toxicity.LexiconAutomaton(terms)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 13))) for _ in range(1500)]
    for t in terms:
        cut = rng.randrange(len(t))
        words += [t, t[:cut] + t[cut + 1:], t[:cut] + "e" + t[cut:], t[:cut] + "e" + t[cut + 1:], "e" + t + "e"]
    for word in words:
        near = [(edit_distance(word, t), i) for i, t in enumerate(terms) if edit_distance(word, t) <= toxicity.allowed_edits(t)]
        want = min(near)[1] * 4 + min(near)[0] + 1 if near and word else 0
        assert automaton.match(word) == want, word


def test_quotation():
    words = 'he said "you are a moron" and left the moron there'.split()
    assert toxicity.quoted(words, 5) and not toxicity.quoted(words, 9)


def test_misspelled_and_quoted_terms(spark):
    clean = "the plain words of a calm text go on and on"
    rows = [(i, clean + (" you idiot and moron, stupid idiot" if i % 2 else ' she wrote "idiot moron" once' if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    more = [(1000, clean + " you idiott and mor0n, stupidd idiot"), (1001, clean + ' she wrote "idiot moron" once'), (1002, clean)]
    scored = toxicity.score_toxicity(spark.createDataFrame(rows + more, "doc_id bigint, text string"), labels)
    got = {r["doc_id"]: r["predicted"] for r in scored.where("doc_id >= 1000").collect()}
    assert got == {1000: 1, 1001: 0, 1002: 0}


def test_training_rows_are_bounded_where_an_id_repeats(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    hot = [r["doc_id"] for r in labels.where(~held_out()).orderBy("doc_id").limit(2).collect()]
    rows = [(i, f"text {i}") for i in range(60)] + [(hot[0], f"other {i}") for i in range(500)] + [(hot[1], "alike")] * 500
    for per_class in (5, 100):
        got = training_rows(documents(rows).repartition(3), labels, "quality", per_class).collect()
        ids = [r["doc_id"] for r in got]
        assert len(ids) == len(set(ids)) and all(r["_y"] == r["doc_id"] % 2 for r in got)
        assert all(sum(r["_y"] == y for r in got) <= per_class for y in (0, 1))
    assert set(hot) <= set(ids) and len(ids) == labels.where(~held_out()).count()
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_clashing_columns(documents, spark, score):
    docs = documents([(1, "some words"), (2, None), (2, "again")]).withColumnsRenamed({"kept": "_scored", "doc": "__SCORED", "place": "predicted"})
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = score(docs, labels).collect()
    assert {(r["doc_id"], r["_scored"], r["__SCORED"]) for r in got} == {(1, "y", "x"), (2, "y", "x")} and len(got) == 3
