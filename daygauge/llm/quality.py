"""Quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.llm.common import batches, free_name, held_out, query, schema_with, table, training_rows, written

#: Bytes of a passage; a rest of less than REST joins the last one.
PASSAGE, REST = 768, 256
#: Training: documents per class, and passages of all of them; a document with more than an eighth of these is not taken.
PER_CLASS, FIT_PASSAGES = 4000, 400_000
HIDDEN, GATE = 16, 8
LAGS = 12
#: Byte classes by their members; what is in none of them is a class of its own.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|",
           b"#$%&*", b"()[]{}<>=+-_/\\@^~`", b"\"':;", bytes(range(128, 192)), bytes(range(192, 256)))
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _i
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES + 5
CHUNK_BYTES = 1 << 20


def passage_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the first passage of each text. A text without bytes is one empty passage."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in raw], np.int64)
    data = b"\n".join([*raw, b""])
    begin = np.cumsum(sizes + 1) - sizes - 1
    count = np.maximum((sizes + PASSAGE - REST) // PASSAGE, 1)
    first = np.cumsum(count) - count
    total = int(count.sum())
    start = np.repeat(begin, count) + (np.arange(total) - np.repeat(first, count)) * PASSAGE
    lengths = np.diff(np.append(start, len(data)))
    values = np.frombuffer(data, np.uint8)
    owner = np.repeat(np.arange(total), lengths)
    kinds = np.bincount(owner * N_CLASSES + _CLASS[values], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    space = (values == 32) | ((values >= 9) & (values <= 13))
    opens = ~space
    opens[1:] &= space[:-1]
    at = np.flatnonzero(opens)
    words = data.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    doc = np.searchsorted(begin, at, "right")
    same, near = np.zeros(len(words), bool), np.zeros(len(words), bool)
    for lag in range(1, LAGS + 1):
        hit = (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
        (same if lag == 1 else near)[lag:] |= hit
    of = owner[at]
    n_words, repeated, close = (np.bincount(of, weights=w, minlength=total) for w in (None, same, near))
    size = np.maximum(lengths, 1)[:, None]
    some = np.maximum(n_words, 1)
    features = np.concatenate((kinds / size, (n_words / size[:, 0])[:, None] * 4, (repeated / some)[:, None], (close / some)[:, None],
                               np.minimum(lengths / PASSAGE, 2)[:, None] / 2, np.log1p(lengths)[:, None] / 8), axis=1)
    return np.sqrt(features).astype(np.float32), first


@dataclass
class AttentionModel:
    """Encoder, gated attention and head; ``score`` weighs the encoded passages of each text by learned attention."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, first: np.ndarray):
        w = self.weights
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ w["encode"] + w["encode_b"])
        t, g = np.tanh(h @ w["tan"] + w["tan_b"]), 1 / (1 + np.exp(-(h @ w["gate"] + w["gate_b"])))
        raw = (t * g) @ w["attend"]
        counts = np.diff(np.append(first, len(features)))
        of = np.repeat(np.arange(len(first)), counts)
        e = np.exp(raw - np.maximum.reduceat(raw, first)[of])
        a = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        logit = z @ w["head"] + w["head_b"]
        return x, h, t, g, a, of, z, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(features, first)[-1] if len(first) else np.zeros(0)


def fit(features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 120, rate: float = 0.01, decay: float = 1e-4,
        batch: int = 256, seed: int = 11) -> AttentionModel:
    """Adam on the weighted logistic loss of the documents, attention included; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-2
    shape = {"encode": (features.shape[1], HIDDEN), "encode_b": (HIDDEN,), "tan": (HIDDEN, GATE), "tan_b": (GATE,), "gate": (HIDDEN, GATE),
             "gate_b": (GATE,), "attend": (GATE,), "head": (HIDDEN,), "head_b": ()}
    w = {k: np.asarray(rng.normal(0, 1 / np.sqrt(max(s[0], 1)), s) if not k.endswith("_b") else np.zeros(s)) for k, s in shape.items()}
    model = AttentionModel(mean, scale, w)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    counts = np.diff(np.append(first, len(features)))
    step = 0
    for epoch in range(epochs):
        speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(y))
        for low in range(0, len(order), batch):
            docs = order[low:low + batch]
            n = counts[docs]
            own = np.cumsum(n) - n
            rows = np.repeat(first[docs] - own, n) + np.arange(n.sum())
            x, h, t, g, a, of, z, p = model.forward(features[rows], own)
            d = (p - y[docs]) * weight[docs] / weight[docs].sum()
            dz = d[:, None] * w["head"]
            da = (dz[of] * h).sum(axis=1)
            dh = a[:, None] * dz[of]
            draw = a * (da - np.add.reduceat(a * da, own)[of])
            dt, dg = draw[:, None] * w["attend"] * g * (1 - t * t), draw[:, None] * w["attend"] * t * g * (1 - g)
            dh += dt @ w["tan"].T + dg @ w["gate"].T
            dx = dh * (1 - h * h)
            grads = {"encode": x.T @ dx, "encode_b": dx.sum(axis=0), "tan": h.T @ dt, "tan_b": dt.sum(axis=0), "gate": h.T @ dg,
                     "gate_b": dg.sum(axis=0), "attend": (draw[:, None] * t * g).sum(axis=0), "head": z.T @ d, "head_b": d.sum()}
            step += 1
            for k in w:
                grad = grads[k] + (0 if k.endswith("_b") else decay * w[k])
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fit_passages: int = FIT_PASSAGES) -> AttentionModel | None:
    """The model of at most ``per_class`` labelled documents of each class, none of them held out; None if a class is missing.

    All passages of a chosen document are encoded. What reaches the driver is bounded by ``fit_passages``: documents are taken by a
    hash of their id as long as their passages stay within it. Documents weigh so that the classes keep the shares they have among
    all labels, so scores are probabilities.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for low, high in _grouped(texts):
            features, first = passage_features(texts[low:high])
            rows += [own.reshape(-1) for own in np.split(features, first[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    sample = training_rows(docs, labels, "quality", per_class).select(F.col("doc_id").cast("bigint"), "text", F.col("_y").cast("int").alias("y"))
    passages = F.size("x") / N_FEATURES
    encoded = written(sample.mapInArrow(batches(run), "doc_id bigint, y int, x array<float>").where(passages <= fit_passages / 8), "training-passages")
    # The running total is over at most two classes of per_class rows.
    order = Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    taken = encoded.select("doc_id", F.sum(passages).over(order).alias("total")).where(F.col("total") <= fit_passages).select("doc_id")
    rows = encoded.join(F.broadcast(taken), "doc_id").toPandas().sort_values(["doc_id"], kind="stable")
    shares = dict(labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("quality").count().collect())
    if not {0, 1} <= set(rows["y"]):
        return None
    counts = np.array([len(x) // N_FEATURES for x in rows["x"]])
    y = rows["y"].to_numpy(np.float64)
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    features = np.concatenate(list(rows["x"])).reshape(-1, N_FEATURES).astype(np.float64)
    return fit(features, np.cumsum(counts) - counts, y, weight / weight.mean())


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on).

    Only the text is an input of a score. A null or empty text is one empty passage; equal texts score alike; columns named like
    a result are replaced. Labels are matched by key; where labels lack a class, every score is 0.5. An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in ("score", "predicted") if c not in (key, text)])
    scored_text = free_name(docs, "_scored")
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    model = train(named, labels, per_class)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(scored_text).to_pylist()]
        scores = np.full(len(texts), 0.5)
        if model is not None:
            for low, high in _grouped(texts):
                scores[low:high] = np.round(model.score(*passage_features(texts[low:high])), 12)  # last digits depend on a text's place in the batch
        kept = [i for i, name in enumerate(batch.schema.names) if name != scored_text]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scores)], names=[*(batch.schema.names[i] for i in kept), "score"])

    scored = docs.withColumn(scored_text, F.col(text)).mapInArrow(batches(run), schema_with(docs, ("score", T.DoubleType())))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op7_quality")
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
