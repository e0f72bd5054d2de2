"""Vectorised parts against plain loops over bytes, passages and blocks."""

import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from daygauge.llm import pages, piecewise, quality


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    words = ["ab", "Stone", "river,", "x1", "und", "été", "日本", "a.b", "!!", "\n", "tail?\t"]
    return ["", "a", "a a a", "no-space" * 300] + [" ".join(rng.choices(words, k=rng.randrange(1, 1200))) for _ in range(n)]


def test_fingerprint_by_bytes():
    def plain(data: bytes) -> str:
        ones = []
        for i in range(len(data)):
            h = sum((data[i - k] + 1) * pow(piecewise._STEP, k) for k in range(min(7, i + 1))) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            h ^= h >> 13
            count = 0
            while h >> count & 1:
                count += 1
            ones.append(count)

        def pieces(level: int) -> list[bytes]:
            out, low = [], 0
            for i, count in enumerate(ones):
                if count >= level:
                    out.append(data[low:i + 1])
                    low = i + 1
            return out + [data[low:]]

        level = 2
        while 2**level * 2 * piecewise.WANTED < len(data):
            level += 1
        while level > 2 and len(pieces(level)) < piecewise.WANTED:
            level -= 1
        while len(pieces(level)) > piecewise.MOST and level < 33:
            level += 1
        letters = ["".join(piecewise.ALPHABET[(zlib.crc32(p) * 0x9E3779B1 & 0xFFFFFFFF) >> 26] for p in pieces(k) if p) for k in (level, level + 1)]
        return f"{2**level}:{letters[0]}:{letters[1]}"

    for text in texts(1, 40) + ["same phrase " * 900, "z" * 5000]:
        data = text.encode()
        if len(data) > 6:  # shorter ones are hashed two bytes at a time
            assert piecewise.fingerprint(data) == plain(data)


def test_passage_features_by_bytes():
    given = texts(2, 30)
    features, first = quality.passage_features(given)
    row = 0
    for text, begin in zip(given, first, strict=True):
        assert begin == row
        data = text.encode() + b"\n"
        n = max((len(data) - 1 + quality.PASSAGE - quality.REST) // quality.PASSAGE, 1)
        words, at = [], 0
        for word in data.split():
            at = data.index(word, at)
            words.append((at, word))
            at += len(word)
        for i in range(n):
            low, high = i * quality.PASSAGE, (i + 1) * quality.PASSAGE if i < n - 1 else len(data)
            kinds = [0] * quality.N_CLASSES
            for b in data[low:high]:
                kinds[next((k for k, members in enumerate(quality.CLASSES) if b in members), len(quality.CLASSES))] += 1
            own = [k for k, (start, _) in enumerate(words) if low <= start < high]
            same = sum(k > 0 and words[k - 1][1] == words[k][1] for k in own)
            near = sum(any(words[j][1] == words[k][1] for j in range(max(0, k - quality.LAGS), k - 1)) for k in own)
            size, some = max(high - low, 1), max(len(own), 1)
            want = [c / size for c in kinds] + [len(own) / size * 4, same / some, near / some, min((high - low) / quality.PASSAGE, 2) / 2,
                                                math.log1p(high - low) / 8]
            np.testing.assert_allclose(features[row], np.sqrt(want), rtol=1e-5, atol=1e-6)
            row += 1
    assert row == len(features)


def plain_score(model: quality.AttentionModel, passages: np.ndarray) -> float:
    w, encoded, strength = model.weights, [], []
    for passage in passages:
        x = [(v - m) / s for v, m, s in zip(passage, model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(x[i] * w["encode"][i, j] for i in range(len(x))) + w["encode_b"][j]) for j in range(quality.HIDDEN)]
        raw = 0.0
        for k in range(quality.GATE):
            tan = math.tanh(sum(h[j] * w["tan"][j, k] for j in range(quality.HIDDEN)) + w["tan_b"][k])
            gate = 1 / (1 + math.exp(-sum(h[j] * w["gate"][j, k] for j in range(quality.HIDDEN)) - w["gate_b"][k]))
            raw += tan * gate * w["attend"][k]
        encoded.append(h)
        strength.append(math.exp(raw))
    z = [sum(s * h[j] for s, h in zip(strength, encoded, strict=True)) / sum(strength) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(z[j] * w["head"][j] for j in range(quality.HIDDEN)) - float(w["head_b"])))


def test_gated_attention_by_loops_and_its_gradients_by_differences():
    given = texts(3, 12)
    features, first = quality.passage_features(given)
    features = features.astype(np.float64)
    rng = np.random.default_rng(5)
    y, weight = rng.integers(0, 2, len(given)).astype(float), rng.uniform(0.5, 2, len(given))
    model = quality.fit(features, first, y, weight, epochs=4)
    got = model.score(features, first)
    for text, own in enumerate(np.split(features, first[1:])):
        assert abs(plain_score(model, own) - got[text]) < 1e-9

    # The first step of Adam moves each weight against the sign of its gradient.
    decay = 1e-4
    start = quality.fit(features, first, y, weight, epochs=1, rate=0.0, decay=decay)
    moved = quality.fit(features, first, y, weight, epochs=1, rate=0.01, decay=decay)

    def loss() -> float:
        p = start.score(features, first)
        own = -(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight
        return own.sum() / weight.sum() + decay / 2 * sum((v * v).sum() for k, v in start.weights.items() if not k.endswith("_b"))

    checked = 0
    for name in start.weights:
        held = np.atleast_1d(start.weights[name].copy())
        for at in np.ndindex(held.shape):
            sides = []
            for step in (1e-5, -1e-5):
                changed = held.copy()
                changed[at] += step
                start.weights[name] = changed.reshape(np.shape(moved.weights[name]))
                sides.append(loss())
            slope = (sides[0] - sides[1]) / 2e-5
            change = (np.atleast_1d(moved.weights[name]) - held)[at]
            if abs(slope) > 1e-6:
                assert change * slope < 0 and abs(abs(change) - 0.01) < 2e-4, (name, at)
                checked += 1
        start.weights[name] = held.reshape(np.shape(moved.weights[name]))
    assert checked > 500


def plain_main_text(page: str) -> str:
    found = pages.blocks(page)
    if not found:
        return ""
    n = len(found)
    length, marks = [0.0] * n, [0.0] * n
    for i, (path, _) in enumerate(found):
        same = [text for other, text in found if other == path]
        length[i] = sum(map(len, same)) / len(same)
        marks[i] = sum(ch in ".,;:!?…。，、；：！？।" for text in same for ch in text) / len(same)
    fused = []
    for i in range(n):
        before, after = max(i - 1, 0), min(i + 1, n - 1)
        a, b = ((x[before] + 2 * x[i] + x[after]) / 4 for x in (length, marks))
        fused.append(math.sqrt(a * (1 + b)))
    every = {path for path, _ in found}
    score, mass = {}, {}
    for path in every:
        own = [i for i in range(n) if found[i][0] == path]
        score[path] = sum(fused[i] for i in own) / len(own)
        mass[path] = sum(len(found[i][1]) for i in own) * (1 + marks[own[0]])
    least = 0.5 * sum(f * len(t) for f, (_, t) in zip(fused, found, strict=True)) / sum(len(t) for _, t in found)
    best = max([path for path, _ in found], key=lambda p: (mass[p], score[p]))
    content = {p for p in every if score[p] >= least} | {best}
    holder = next((best[:best.index(name) + 1] for name in ("article", "main") if name in best), best[:-1])
    out = []
    for path, text in found:
        keep = path in content
        if holder and holder[-1] in ("article", "main"):
            keep = keep or path[:len(holder)] == holder
        elif path and path[-1] in pages.COMPANIONS:
            keep = keep or path[:len(holder)] == holder
        if path and path[-1] in pages.COMPANIONS:
            for other in content:
                parent = other[:-1]
                if path[:len(parent)] == parent and len(path) > len(parent) and all(name in pages.BETWEEN for name in path[len(parent):-1]):
                    keep = True
        if keep:
            out.append(text)
    return "\n".join(out)


def test_ratios_by_loops(sf_dir):
    given = pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"]).column(0).to_pylist()[:300]
    rng = random.Random(8)
    for _ in range(60):
        body = "".join(f"<{tag}>{' '.join(rng.choices(['word', 'one,', 'end.', 'x'], k=rng.randrange(1, 40)))}</{tag}>" if rng.random() < 0.8
                       else f"<{tag}>" for tag in rng.choices(["p", "div", "li", "h2", "section", "td", "blockquote"], k=25))
        given.append(rng.choice(["<body>", "<main>", "<body><article>"]) + body)
    for page in given:
        assert pages.main_text(page or "") == plain_main_text(page or "")
