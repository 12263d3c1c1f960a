"""Words that occur more often in a text than a byte counts, and blocks of several documents."""

import collections
import math
import os
import re
import zlib

import pytest

from tessera.llm import lattice_lm as lm


@pytest.mark.skipif(not os.path.exists(lm.VOCABULARY), reason="no vocabulary")
def test_counts_beyond_a_byte(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2048)
    texts = {k: "the " * (k * 130) + f"w{k} é" for k in range(8)} | {20: None}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    c = collections.Counter(t for i, x in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for r in lm.score(d).collect():
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
