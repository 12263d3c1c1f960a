"""Vectors, toxicity, lattice likelihood, similarity join and the pipeline."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert_ann as ann
from tessera.llm import lattice_lm as lm
from tessera.llm import ngram_join as nj
from tessera.llm import toxicity as tox
from tessera.llm.components import components

DATA = "/root/testdata/sf0.001"


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    order = grid[np.argsort(ann.hilbert_index(grid, 2))]
    assert len(set(ann.hilbert_index(grid, 2).tolist())) == 64 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_nearest_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 8)).astype(np.float32)
    rows = [(k, base[k].tolist()) for k in range(150)] + [(150 + k, base[0].tolist()) for k in range(40)]
    odd = [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] + [1.0] * 7), (504, [1.0, 2.0]), (None, base[1].tolist()), (3, base[3].tolist())]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(d, 5, F.col("vec_id") % 10 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    vectors = {k: np.array(v, np.float64) for k, v in rows}
    assert dict(got) == ann.exact_nearest(vectors, [k for k in vectors if k % 10 == 0], 5)
    some = ann.nearest(d, 5, F.col("vec_id") % 10 == 0)
    assert some.groupBy("query_id").count().where("count < 5").count() == 0
    few = ann.nearest(d.where("vec_id < 3"), 5)
    assert few.count() == 6
    assert ann.nearest(d.limit(0), 5).count() == 0 and ann.nearest(d.where("vec_id >= 500"), 5).count() == 0


def test_toxicity_learns_a_word_and_scores_all_rows(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(200)]
    texts, y = [], []
    for k in range(900):
        body = [rng.choice(words) for _ in range(rng.choice([5, 30, 120]))]
        if k % 3 == 0:
            body[rng.randrange(len(body))] = "Scum!"
        texts.append(" ".join(body))
        y.append(int(k % 3 == 0))
    net = tox.train(texts[:800], y[:800])
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts[800:])] + [(900, None), (901, ""), (902, "!!"), (0, texts[800]), (None, texts[801])], "doc_id long, text string")
    got = tox.score(d, net).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 105 and all(0 <= r.score <= 1 for r in got)
    assert score[900] == score[901] == score[902] == 0.0
    assert np.mean([(score[k] >= 0.3) == bool(y[800 + k]) for k in range(100)]) > 0.95
    assert {r.doc_id for r in tox.below(d, net, 0.3).collect() if r.doc_id is not None} == {i for i, s in score.items() if i is not None and s < 0.3}
    assert tox.train([], []).score(np.zeros(1), np.ones(1, int)).shape == (1,)


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 100):
        starts = tox.window_starts(n)
        assert {p for s in starts for p in range(s, min(n, s + tox.WINDOW))} == set(range(n))


def test_gradients_are_right():
    texts, y = ["bad word here now", "a good one", "bad again a b c"], np.array([1, 0, 1], np.float32)
    x = tox.chunk_inputs(next(iter(tox.word_chunks(pa.array(texts), tox.NON_WORD))))
    net = tox.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"] += np.random.default_rng(0).standard_normal(net.p["word"].shape) * 0.1
    index, row, _ = tox.window_matrix(x.words, x.bounds)
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y[row] - 1) * net.logits(net.embed(x), index)))))
    g = net.gradients(x, net.embed(x), index, y[row], np.ones(len(row)))
    for name, at in (("wf", (3, 5)), ("ub", (2, 17)), ("att", (4,)), ("out", (9,)), ("bf", (20,)), ("word", (int(x.rows[1]), 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[name][at], rel=0.05, abs=2e-4)


@pytest.mark.skipif(not os.path.exists(lm.VOCABULARY), reason="no vocabulary")
def test_lattice_sums_all_segmentations_and_base_is_exact(spark):
    pieces, weight = lm.load_pieces(lm.VOCABULARY)
    words = ["the", "thntatwh", "éx", "a", "日本"]
    data = [w.encode() for w in words]
    got = lm.Lattice(pieces, weight).log_likelihood(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(w) for w in data]))
    assert got.tolist() == pytest.approx([lm.reference_log_likelihood(w, pieces, weight) for w in data])
    long = b"ab" * 150
    assert lm.Lattice(pieces, weight).long_word(np.frombuffer(b" the", np.uint8)) == pytest.approx(got[0])
    assert math.isfinite(lm.Lattice(pieces, weight).log_likelihood(np.frombuffer(long, np.uint8), np.array([300]))[0])
    rows = [(k, " ".join(random.Random(k).choice(["The", "cat", "sat", "on", "the", "mat", f"x{k}"]) for _ in range(k % 9))) for k in range(40)] + [(50, None), (51, ""), (None, "the cat"), (7, "again")]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    out = lm.score(d).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = collections.Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 6)) for i, x in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert lm.score(d.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(lm.VOCABULARY), reason="no vocabulary")
def test_score_is_the_likelihood_of_the_lattice_alone(spark):
    pieces, weight = lm.load_pieces(lm.VOCABULARY)
    texts = {k: "the cat the mat" if k % 2 else "the the sat" for k in range(12)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    train = [w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split()]
    ends = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in texts)
    words = sorted({w.encode() for t in texts.values() for w in t.split()})
    times = np.array([train.count(w.decode()) for w in words])
    for steps in (0, 1):
        count = np.full(len(pieces), 0.01)
        if steps:
            count += lm.Lattice(pieces, weight).expected(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]), times)
            assert count.sum() > len(train)
        drawn = count.sum() if steps else len(train)
        end = (ends + 0.5) / (ends + drawn + 1)
        fitted = (np.log(count / count.sum()) if steps else weight) + math.log(1 - end)
        log_l = {w.decode(): lm.reference_log_likelihood(w, pieces, fitted) for w in words}
        got = {r.doc_id: r.score for r in lm.score(d, steps=steps).collect()}
        want = {i: (math.log(end) + sum(log_l[w] for w in t.split())) / math.log(10) for i, t in texts.items()}
        assert got == pytest.approx(want, abs=1e-5)


def near_texts():
    rng = random.Random(5)
    words = [f"v{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = {}
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 20, 60, 150]))]
        if k % 4 == 0:
            base = passage + base
        for m in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(m):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts) * 3 + 1] = " ".join(copy)
    big = [rng.choice(words) for _ in range(5000)]
    texts |= {1000: None, 1001: "", 1002: " \t", 1003: "One two", 1004: "one TWO", 1005: " ".join(big), 1006: " ".join(big[:4800]), 1007: texts[1], 1008: texts[1]}
    return texts


def test_similarity_components_like_all_pairs(spark):
    texts = near_texts()
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in texts.items()], "doc_id long, text string, id int, n int")
    for n, num in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(d, n, num, 100).collect()}
        assert got == nj.reference_components(texts, n, num, 100)
    odd = d.select("doc_id", "text").unionAll(d.where("doc_id = 1").select("doc_id", "text")).unionAll(spark.createDataFrame([(None, texts[1])], "doc_id long, text string"))
    rows = nj.ngram_components(odd).collect()
    assert len(rows) == len(texts) + 2 and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert nj.ngram_components(d.limit(0)).count() == 0


def test_traversal_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    sets = []
    for k in range(90):
        s = rng.integers(0, 1 << 60, rng.integers(5, 60)).astype(np.uint64)
        sets += [np.unique(s), np.unique(np.r_[s[: len(s) - 1], rng.integers(0, 1 << 60, 1).astype(np.uint64)])]
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    size = np.array([len(s) for s in sets])
    maps = np.zeros((len(sets), nj.MAP_WORDS * 64), np.uint8)
    for k, s in enumerate(sets):
        maps[k, (s & np.uint64(maps.shape[1] - 1)).astype(np.int64)] = 1
    words = np.frombuffer(np.packbits(maps, axis=1).tobytes(), np.uint64).reshape(len(sets), -1)
    found = {(int(a), int(b)) for i, j in nj.dual_traversal(size, size, size - maps.sum(axis=1), words, 80, 100) for a, b in zip(i, j, strict=True)}
    linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= found and len(found) < len(sets) * (len(sets) - 1) // 4
    forest = nj.spanning_links(sets, 80, 100)
    assert set(map(tuple, map(sorted, forest))) <= linked


def test_components_of_a_chain_and_nothing(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 40), (40, 30), (None, 3), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(21)} | {30: 30, 40: 30}
    assert components(links.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages_keep_clean_rows(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = p.drop_toxic(spark, docs, DATA)
    assert kept.columns == docs.columns
    gone = set(texts) - {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert len(gone & set(clean)) <= 0.02 * len(clean) + 1
    one = {r.doc_id for r in p.one_of_each_group(spark, docs, DATA).collect()}
    assert one == {i for i, (_, c) in nj.reference_components(texts, 5, 80, 100).items() if i == c}
    from tessera.llm.decontamination import reference_matches

    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert {r.doc_id for r in p.drop_contaminated(spark, docs, DATA).collect()} == {i for i, t in texts.items() if not reference_matches(t, items)[1]}
    out = p.run(spark, DATA)
    assert out.columns == [*docs.columns, "slot", "shard"] and out.count() > 0
