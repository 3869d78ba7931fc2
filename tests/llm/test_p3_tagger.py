"""Problem 3: the scores of the tagger against plain formulas, and its gates at extremes."""

import warnings

import numpy as np

from ferrule.llm.p3_tagger import HIDDEN, TAGS, Tagger, sigmoid_of_minus


def plain(t: Tagger, ids: np.ndarray) -> np.ndarray:
    sig = lambda x: 1 / (1 + np.exp(-x))
    out = np.zeros((len(ids), TAGS)) + t.p["bias"]
    for d in "fb":
        h = c = np.zeros(HIDDEN)
        for k in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            i, f, o, a = np.split(t.p[f"x{d}"][ids[k]].astype(float) + h @ t.p[f"h{d}"], 4)
            c = sig(f) * c + sig(i) * np.tanh(a)
            h = sig(o) * np.tanh(c)
            out[k] += h @ t.p[f"e{d}"]
    return out


def test_scores_are_those_of_the_model():
    t = Tagger.load()
    windows = [t.encode(x) for x in ("请联系张伟，电话 13812345678。", "Write to ann@example.com, 12 High Street", "x")]
    for w, e in zip(windows, t.emissions(windows)):
        assert np.abs(e - plain(t, w)).max() < 1e-4


def test_gates_at_extremes():
    z = np.array([-1e4, -1, 0, 1, 1e4], np.float32)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        sigmoid_of_minus(z)
    assert np.allclose(z, [1, 0.7310586, 0.5, 0.26894143, 0])
