"""Toxicity by Levenshtein automata over a lexicon trie and the context of each hit."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.llm.common import batches, free_name, held_out, query, schema_with, table, training_rows, written

#: Training documents per class. Weights are learned on each half with the lexicon of the other; scores use the lexicon of all.
PER_CLASS = 4000
#: A term stands in so many toxic documents, in such a share of them, and in so many times the share of clean ones, at least.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_RATIO = 4, 0.005, 12.0
#: Words on either side of a hit that make its context.
CONTEXT = 6
KEPT_WORDS = 400_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OPENING, _CLOSING = set("\"'“‘«‹„‚"), set("\"'”’»›“‘")
N_FEATURES = 9


def bare(word: str) -> str:
    return word if word.isalnum() else _EDGE.sub("", word)


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The trie of a lexicon run together with a Levenshtein automaton for each word read.

    A state is a set of trie nodes with the edits spent to reach them; states and steps are made when first met, so a word that
    resembles no term dies after a few characters.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.accepts: list[int] = [-1]
        self.budget: list[int] = [0]
        for number, term in enumerate(terms):
            node, most = 0, allowed_edits(term)
            self.budget[0] = max(self.budget[0], most)
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.accepts.append(-1)
                    self.budget.append(0)
                node = nxt
                self.budget[node] = max(self.budget[node], most)
            self.accepts[node] = number
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.best: list[int] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """The number of a state with all nodes reached by leaving out characters of terms; -1 if no node is left."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = spent[node] + 1
                if e <= self.budget[child] and e < spent.get(child, 9):
                    spent[child] = e
                    todo.append(child)
        if not spent:
            return -1
        key = tuple(sorted(spent.items()))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            ends = [(e, self.accepts[n]) for n, e in key if self.accepts[n] >= 0 and e <= allowed_edits(self.terms[self.accepts[n]])]
            self.best.append(min(ends)[1] * 4 + min(ends)[0] + 1 if ends else 0)
        return number

    def _step(self, state: int, ch: str) -> int:
        spent: dict[int, int] = {}
        for node, e in self.states[state]:
            if e < self.budget[node] and e + 1 < spent.get(node, 9):
                spent[node] = e + 1
            for letter, child in self.children[node].items():
                cost = e + (letter != ch)
                if cost <= self.budget[child] and cost < spent.get(child, 9):
                    spent[child] = cost
        return self._state(spent)

    def match(self, word: str) -> int:
        """0, or 1 + edits + 4 * term for the term nearest to the word (ties: the first)."""
        if len(self.steps) > 300_000:
            self.reset()
        state, steps = self.start, self.steps
        for ch in word:
            key = state, ch
            nxt = steps.get(key)
            if nxt is None:
                nxt = steps[key] = self._step(state, ch)
            if nxt < 0:
                return 0
            state = nxt
        return self.best[state] if word else 0


class Lexicon(dict):
    """By word as written the match of its bare form; near forms that clean documents use do not count."""

    def __init__(self, terms: Mapping[str, float], harmless: set[str]):
        super().__init__()
        self.terms = sorted(terms)
        self.strength = np.array([terms[t] for t in self.terms])
        self.harmless = harmless
        self.automaton = LexiconAutomaton(self.terms)

    def __reduce__(self):
        return Lexicon, (dict(zip(self.terms, self.strength.tolist(), strict=True)), self.harmless)

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        form = bare(word)
        found = self.automaton.match(form)
        if found and (found - 1) % 4 and form in self.harmless:
            found = 0
        self[word] = found
        return found


def quoted(words: list[str], at: int) -> bool:
    """Whether a quotation opens within CONTEXT words up to the hit and closes within as many after it."""
    opened = False
    for i in range(max(0, at - CONTEXT), at + 1):
        if words[i][0] in _OPENING:
            opened = True
        elif i < at and words[i].rstrip(".,;:!?")[-1:] in _CLOSING:
            opened = False
    return opened and any(w.rstrip(".,;:!?")[-1:] in _CLOSING for w in words[at:at + CONTEXT + 1])


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    """Strength of plain and quoted, exact and near hits, their variety, and the densest context."""
    words = text.lower().split()
    if not words:
        return [0.0] * N_FEATURES
    codes = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
    hits = np.flatnonzero(codes)
    if not len(hits):
        return [0.0] * (N_FEATURES - 1) + [np.log1p(len(words))]
    term, near = (codes[hits] - 1) // 4, (codes[hits] - 1) % 4 > 0
    said = np.array([quoted(words, i) for i in hits.tolist()])
    strength = lexicon.strength[term]
    dense = np.searchsorted(hits, hits + 2 * CONTEXT, "right") - np.arange(len(hits))
    plain = ~said
    return [float(x) for x in (
        np.log1p(strength[plain & ~near].sum()), np.log1p(strength[plain & near].sum()), np.log1p(strength[said & ~near].sum()),
        np.log1p(strength[said & near].sum()), np.log1p(len(np.unique(term[plain & ~near]))), np.log1p(len(np.unique(term[plain & near]))),
        np.log1p(dense[plain].max(initial=0)), np.log1p(100 * strength[plain & ~near].sum() / len(words)), np.log1p(len(words)))]


def _halves(sample: DataFrame) -> DataFrame:
    return sample.select(F.col("doc_id").cast("bigint"), "text", F.col("_y").cast("int").alias("y"),
                         (F.conv(F.substring(F.md5(F.concat(F.lit("half"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 2).alias("half"))


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = sorted({bare(w) for w in set((text or "").lower().split())} - {""})
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(np.full(len(own), y, np.int32))], names=["word", "y"])


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], set[str]]:
    """Terms with their strength, and near forms of them that are harmless, from texts with ``y``.

    The share of toxic documents with a term is taken one standard error low, so that chance makes no term of a rare word. All terms
    and forms are kept; they are words of the sample, which is bounded by its rows.
    """
    n = dict(sample.groupBy("y").count().collect())
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}, set()
    stats = written(sample.select("text", "y").mapInArrow(_words, "word string, y int").groupBy("word")
                    .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("u")), "word-counts")
    least = max(LEAST_DOCUMENTS, round(LEAST_SHARE * toxic))
    ratio = ((F.col("t") - F.sqrt("t")) / toxic) / ((F.col("u") + 1) / clean)
    rows = (stats.where((F.col("t") >= least) & (ratio >= LEAST_RATIO) & (F.length("word") >= 3))
            .select("word", F.log(ratio).alias("s")).collect())
    terms = {r["word"]: min(r["s"], 6.0) / 6.0 for r in rows}
    if not terms:
        return {}, set()

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = LexiconAutomaton(sorted(terms))
        words = [w for w in batch.column(0).to_pylist() if (automaton.match(w) - 1) % 4 > 0 and automaton.match(w)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    used = stats.where((F.col("u") >= 2) & (F.col("t") / toxic < LEAST_RATIO / 2 * F.col("u") / clean)).select("word")
    return terms, {r["word"] for r in used.mapInArrow(batches(near), "word string").collect()}


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients (the last is the constant) of a weighted ridge logistic regression, by Newton's steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = ridge * np.append(np.ones(x.shape[1]), 1e-6)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def _cross_fitted(sample: DataFrame, labels: DataFrame):
    """Weights of the features that each half of the sample has by the lexicon of the other; None if a class is missing."""
    parts = []
    for half in (0, 1):
        lexicon = Lexicon(*learn_lexicon(sample.where(F.col("half") != half)))

        def features(batch: pa.RecordBatch, lexicon=lexicon) -> pa.RecordBatch:
            rows = [text_features(t or "", lexicon) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        own = sample.where(F.col("half") == half).select("doc_id", "text", "y")
        parts.append(own.mapInArrow(batches(features), "doc_id bigint, y int, x array<double>").toPandas())
    rows = pd.concat(parts).sort_values("doc_id", kind="stable")
    shares = dict(labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("toxic").count().collect())
    y = rows["y"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    return fit_weights(np.array(list(rows["x"])), y, np.where(y == 1, shares[1] / y.sum(), shares[0] / (1 - y).sum()))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on).

    The lexicon is learned from labels: words that toxic documents share and clean ones lack. Every word of a text is run through
    the automaton of the lexicon, so misspelled terms count as near hits; a hit within a quotation counts apart from a plain one.
    Only the text is an input of a score. A null or empty text has no hits; columns named like a result are replaced; without
    labels of both classes every score is 0. An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in ("score", "predicted") if c not in (key, text)])
    scored_text = free_name(docs, "_scored")
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sample = written(_halves(training_rows(named, labels, "toxic", per_class)), "toxicity-sample")
    terms, harmless = learn_lexicon(sample)
    lexicon = Lexicon(terms, harmless)
    model = _cross_fitted(sample, labels) if terms else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(scored_text).to_pylist()
        scores = np.zeros(len(texts))
        if model is not None and texts:
            mean, scale, w = model
            x = (np.array([text_features(t or "", lexicon) for t in texts]) - mean) / scale
            scores = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        kept = [i for i, name in enumerate(batch.schema.names) if name != scored_text]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scores)], names=[*(batch.schema.names[i] for i in kept), "score"])

    scored = docs.withColumn(scored_text, F.col(text)).mapInArrow(batches(run), schema_with(docs, ("score", T.DoubleType())))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
