"""Words without blanks teach the lattice as short ones do."""

import os

import numpy as np
import pytest

from tessera.llm import lattice_lm as lm


@pytest.mark.skipif(not os.path.exists(lm.VOCABULARY), reason="no vocabulary")
def test_long_words_teach(monkeypatch):
    lattice = lm.Lattice(*lm.load_pieces(lm.VOCABULARY))
    words = ["日本語のテキストは空白を持たない" * 3, "thntatwh" * 20, "a"]
    data = [w.encode() for w in words]
    args = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(w) for w in data]), np.array([2, 3, 5])
    want, log_l = lattice.expected(*args), lattice.log_likelihood(*args[:2])
    monkeypatch.setattr(lm, "LONG_WORD", 20)
    assert lattice.expected(*args) == pytest.approx(want, rel=1e-6, abs=1e-9) and want.sum() > 0
    assert lattice.log_likelihood(*args[:2]) == pytest.approx(log_l)
    monkeypatch.undo()
    long = ("日本語の文" * 100).encode()
    got = lattice.expected(np.frombuffer(long, np.uint8), np.array([len(long)]), np.array([1]))
    size = np.array([len(p) for p in lm.load_pieces(lm.VOCABULARY)[0]])
    assert (got * size).sum() == pytest.approx(len(long) + 1)
