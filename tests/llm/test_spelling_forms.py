"""Spelling forms against plain statements of the same rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling_forms as s
from tessera.llm.registry import op13_spelling_forms

DATA = "/root/testdata/sf0.001"


def edits_of(words):
    """Ordered near pairs by deleting and wild-carding each place: not by intervals."""
    by, out = {}, set()
    for w in words:
        for k in range(len(w)):
            by.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if w[:k] + w[k + 1 :] in words:
                out |= {(w, w[:k] + w[k + 1 :]), (w[:k] + w[k + 1 :], w)}
    for same in by.values():
        out |= {(a, b) for a in same for b in same if a != b}
    return out


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def expected(n):
    near = {}
    for a, b in edits_of(set(n)):
        near.setdefault(a, set()).add(b)
    form = {}
    for w in n:
        best = min(near.get(w, ()), key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near.get(w, ())), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(st.sampled_from("abÿ汉"), min_size=1, max_size=7), max_size=60))
def test_blocks_find_each_pair_once(words):
    found = []
    for m in range(1, 8):
        asked = sorted(w for w in words if len(w) == m)
        for wide in (m, m + 1):
            held = sorted(w for w in words if len(w) == wide)
            for side in (0, 1) if asked and held else ():
                block = s.Block([w[::-1] if side else w for w in held])
                q, row = block.near(s._codes([w[::-1] if side else w for w in asked]), m // 2 if side == 0 else m - m // 2 + (wide > m), side == 0)
                for a, b in zip(q.tolist(), block.order[row].tolist(), strict=True):
                    found += [(asked[a], held[b])] + ([(held[b], asked[a])] if wide > m else [])
    assert sorted(found) == sorted(edits_of(words))


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(37)), st.lists(st.tuples(*[st.integers(0, 37)] * 4), max_size=20))
def test_wavelet_tree_reports_rectangles(values, boxes):
    a = np.array(values)
    lo, hi, least, end = (np.array([min(b[:2]) for b in boxes], int), np.array([max(b[:2]) for b in boxes], int), np.array([min(b[2:]) for b in boxes], int), np.array([max(b[2:]) for b in boxes], int))
    of, value = s.WaveletTree(a).report(lo, hi, least, end)
    want = sorted((k, int(v)) for k in range(len(boxes)) for v in a[lo[k] : hi[k]] if least[k] <= v < end[k])
    assert sorted(zip(of.tolist(), value.tolist(), strict=True)) == want


def test_forms_of_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = rows_of(op13_spelling_forms(spark, DATA))
    assert len(got) == len(set(got)) and set(got) == expected(counted(rows))


def test_chains_ties_and_odd_rows(spark):
    # thing <- thin1 steps of n: 3, 6, 12, 24; a tie between two near words; an id that is null; texts without words.
    rows = [(None, "chain " * 3), (1, "chaim " * 6), (2, "chaimo " * 12), (3, "chaimor " * 24), (4, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6), (5, None), (6, ""), (7, "12 34"), (8, "x" * 9000 + " " + "y" * 9000), (9, "x" * 9000), (10, "x" * 9001), (11, "x" * 9000 + "1" + "x" * 9001), (12, "x" * 9001), (13, "ÀÁÂÃÄ Éàáâã")] * 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'z' AS word", "2 AS side")
    got = rows_of(s.spelling_forms(s.counted_words(docs)))
    assert set(got) == expected(counted(rows)) and len(got) == len(set(got))


def test_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 8)
    monkeypatch.setattr(s, "QUERIES", 5)
    rng = np.random.default_rng(3)
    n = {"".join(rng.choice(list("aab"), 6)) + "q" * int(rng.integers(0, 2)): int(rng.integers(3, 40)) for _ in range(90)}
    words = spark.createDataFrame([(w, k) for w, k in n.items()] + [(None, 5), ("", 5)], "word string, n long")
    assert sorted((r.word, r.near) for r in s.near_pairs(words).collect()) == sorted(edits_of(set(n)))
    got = rows_of(s.spelling_forms(words.where("length(word) > 0")))
    assert len(got) == len(set(got)) and set(got) == expected(n)


@pytest.mark.parametrize("text", ["", None])
def test_no_words(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert s.spelling_forms(s.counted_words(docs)).count() == 0
    assert s.spelling_forms(s.counted_words(docs.limit(0))).count() == 0
