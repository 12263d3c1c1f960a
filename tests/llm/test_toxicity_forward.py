"""The network's score against a plain forward pass, word after word, and its odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as tox
from tessera.llm.words import NON_WORD, plain_words

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def word_vector(word, p):
    base, h = 0x9E3779B97F4A7C15 | 1, 0
    for k, b in enumerate(word):
        h = (h + (b + 1) * pow(base, k, 1 << 64)) & M
    h = mix((h + len(word) * 0xD6E8FEB86659FD93) & M)
    around = [0, *word, 0]
    tri = [p["char"][mix((around[k] << 16) + (around[k + 1] << 8) + around[k + 2]) & (tox.CHAR_ROWS - 1)] for k in range(len(word))]
    return np.r_[p["word"][h % (tox.WORD_ROWS - 1) + 1], np.mean(tri, axis=0)]


def window_logit(words, p):
    n, pad = tox.HIDDEN, np.zeros(2 * tox.WIDTH)
    x = [word_vector(w, p) for w in words] + [pad] * (tox.WINDOW - len(words))
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, order in (("f", range(tox.WINDOW)), ("b", reversed(range(tox.WINDOW)))):
        h, states[d] = np.zeros(n), {}
        for t in order:
            a, u = x[t] @ p[f"w{d}"] + p[f"b{d}"], h @ p[f"u{d}"]
            z, r = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h
            states[d][t] = h
    h = [np.r_[states["f"][t], states["b"][t]] for t in range(tox.WINDOW)]
    e = np.array([math.exp(v @ p["att"]) if t < len(words) else math.exp(-30) for t, v in enumerate(h)])
    return float(sum(w * (v @ p["out"]) for w, v in zip(e / e.sum(), h, strict=True)) + p["bias"][0])


def test_scores_are_those_of_a_plain_forward_pass(spark):
    net = tox.Network.fresh(3)
    rng = np.random.default_rng(3)
    net.p["word"] = (rng.standard_normal(net.p["word"].shape) * 0.5).astype(np.float32)
    net.calibration = np.array([1.3, -0.2, 0.4])
    texts = ["Bad words, here!", "one", "é日 本-x " * 9, " ".join(f"w{k % 17}" for k in range(75)), "", None, "!! --"]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    want = []
    for t in texts:
        words = plain_words(t, NON_WORD)
        logits = [window_logit(words[s : s + tox.WINDOW], p) for s in tox.window_starts(len(words))]
        a, b, c = net.calibration
        want.append((1 / (1 + math.exp(-(a * max(logits) + b * math.log(len(logits)) + c))) if logits else 0.0, len(logits), tox.window_starts(len(words))[int(np.argmax(logits))] if logits else None))
    d = spark.createDataFrame([(k, t, "score", 1) for k, t in enumerate(texts)], "doc_id long, text string, score string, n_windows int")
    got = {r.doc_id: r for r in tox.score(d, net).collect()}
    for k, (score, windows, worst) in enumerate(want):
        assert got[k].score == pytest.approx(score, abs=2e-4) and got[k].n_windows == windows and got[k].worst_start == worst
    assert tox.score(d.limit(0), net).count() == 0 and tox.below(d.limit(0), net, 0.3).columns == d.columns
    assert tox.below(d, net, 2.0).count() == len(texts)


def test_a_very_long_text_is_read_to_its_end(spark):
    net = tox.Network.fresh(5)
    long = "calm " * 200_000
    d = spark.createDataFrame([(1, long), (2, long + "other")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in tox.score(d, net).collect()}
    assert got[1].n_windows == len(tox.window_starts(200_000)) and got[2].n_windows == len(tox.window_starts(200_001))
    assert d.where(F.col("doc_id") == 1).count() == 1
