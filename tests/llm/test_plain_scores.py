"""Scores of the vectorised models against loops over windows, words and features."""
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa

from vitrine.llm import quality, toxicity
from vitrine.llm.toxicity import HIDDEN, STRIDE, WINDOW, cut, placed, score_texts

TEXTS = ["", "wort", "eins zwei, drei! éins zwei-DREI", " ".join(f"w{i % 37} böse{i % 5}" for i in range(70)), "a " * 33, "b " * 48 + "schlimm", "x" * 300]


def _model():
    p = toxicity._start(9)
    rng = np.random.default_rng(9)
    for key in ("word", "gram"):
        p[key] = (rng.standard_normal(p[key].shape) * 0.6).astype(np.float32)
    p["vocabulary"] = np.sort(cut(pa.array(["wort zwei w3 böse1 schlimm"])).keys)
    return p


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _vector(p, word):
    w = placed(cut(pa.array([word])), p["vocabulary"])
    assert len(w.words) == 1
    return p["word"][w.words[0]].astype(float) + p["gram"][w.grams].sum(0, dtype=float) / math.sqrt(len(w.grams))


def _states(p, side, vectors):
    h, out = np.zeros(HIDDEN), []
    for v in vectors:
        x, u = v @ p[side + "W"].astype(float) + p[side + "c"], h @ p[side + "U"].astype(float)
        r, z = _sigmoid(x[:HIDDEN] + u[:HIDDEN]), _sigmoid(x[HIDDEN:2 * HIDDEN] + u[HIDDEN:2 * HIDDEN])
        n = np.tanh(x[2 * HIDDEN:] + r * u[2 * HIDDEN:])
        h = (1 - z) * n + z * h
        out.append(h)
    return out


def _plain(p, text):
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)
    best = -math.inf
    for at in range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE):
        vectors = [_vector(p, w) for w in words[at:at + WINDOW]]
        if not vectors:
            best = max(best, float(p["bias"][0]))
            continue
        ahead, back = _states(p, "f", vectors), _states(p, "b", vectors[::-1])[::-1]
        states = np.array([np.concatenate(x) for x in zip(ahead, back)])
        e = np.tanh(states @ p["A"].astype(float)) @ p["v"]
        weights = np.exp(e - e.max())
        best = max(best, float((weights / weights.sum()) @ states @ p["out"] + p["bias"][0]))
    return _sigmoid(best)


def test_toxicity_is_that_of_a_loop_over_windows():
    p = _model()
    got = score_texts(p, pa.array(TEXTS))
    assert np.allclose(got, [_plain(p, t) for t in TEXTS], atol=2e-4)


def test_a_passage_over_the_edge_of_a_window_lies_whole_in_another():
    for length in (1, 10, WINDOW - STRIDE + 1):
        for at in range(60):
            words = [f"w{i}" for i in range(100)]
            w = cut(pa.array([" ".join(words)]))
            starts = np.arange(len(w.at)) * STRIDE
            assert ((starts <= at) & (at + length <= starts + WINDOW)).any()


def test_quality_is_the_sum_of_its_tables():
    texts = pa.array([*TEXTS, *(f"{t} {i}. Satz mit Wörtern, {i * 7}!\n" * (i % 4 + 1) for i, t in enumerate(TEXTS * 9))])
    x = quality.features(texts)
    y = (np.arange(len(x)) % 3 == 0).astype(float)
    model = quality.fit(x, y)
    for row, got in zip(x, model.score(texts)):
        total = model.base
        for j, v in enumerate(row):
            total += model.tables[j][bisect_right(model.cuts[j].tolist(), v)]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            total += table[bisect_right(model.pair_cuts[a].tolist(), row[a])][bisect_right(model.pair_cuts[b].tolist(), row[b])]
        assert abs(got - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-9
    assert len(model.pairs) and np.abs(model.pair_tables).sum() > 0
