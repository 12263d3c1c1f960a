"""What the n-gram join leaves on disk, and the pairs that it makes of unlike sets."""

import os
import random

import numpy as np
import pyarrow as pa

from tessera.llm import ngram_join as nj
from tessera.llm.shared import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tables(spark):
    top = f"{shared_dir(spark).removeprefix('file://')}/tessera"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_tables_and_shuffles_of_ended_steps_are_gone(spark, monkeypatch):
    rng = random.Random(2)
    texts = {k: " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(30)) for k in range(40)}
    texts |= {k + 100: t + " more" for k, t in texts.items() if k % 2}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    before, seen, were = tables(spark), [], spark.conf.get(CLEANUP, None)
    monkeypatch.setattr(nj, "components", lambda links, f=nj.components: (seen.append(spark.conf.get(CLEANUP)), f(links))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(docs, 4, 85, 100).collect()}
    assert got == nj.reference_components(texts, 4, 85, 100)
    assert set(seen) == {"true"} and spark.conf.get(CLEANUP, None) == were
    kept = {name.rsplit("-", 1)[0] for name in tables(spark) - before}
    assert not kept & {"sets", "classes", "nodes", "flat", "hot", "met"}


def test_a_hash_of_many_leaves_makes_no_flat_pairs():
    rows = np.array([(7, 20, 20, k, 0) for k in range(500)] + [(8, 20, 20, 1, 0), (8, 20, 20, 2, 0), (9, 20, 20, 3, 0)], np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=["token", "lo", "hi", "node", "place"])
    for size in (7, 100, len(rows)):
        batches = [whole.slice(k, size) for k in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in nj._pairs_under_hash(iter(batches), 85, 100, 32) for r in b.to_pylist()]
        assert sorted(out, key=str) == [(1, 2), (7, None)]
    assert [b.num_rows for b in nj._pairs_under_hash(iter([]), 85, 100, 32)] == [0]


def test_unlike_sets_of_one_name_are_leaves_of_their_own():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    sets = []
    for _ in range(30):
        own = np.r_[passage, rng.integers(0, 1 << 63, 40).astype(np.uint64)]
        sets += [np.unique(own), np.unique(np.r_[own[:-1], rng.integers(0, 1 << 63, 1).astype(np.uint64)])]
    maps = []
    for s in sets:
        flags = np.zeros(nj.MAP_WORDS * 64, np.uint8)
        flags[(s & np.uint64(len(flags) - 1)).astype(np.int64)] = 1
        maps.append((np.packbits(flags).tobytes(), [len(s) - int(flags.sum())]))
    rows = pa.table({"id": range(len(sets)), "n": [len(s) for s in sets], "bitmap": [m for m, _ in maps], "excess": [e for _, e in maps]})
    leaves = [sorted(t.column("id").to_pylist()) for t in nj._tight(rows, 85, 100)]
    assert sorted(leaves) == [[k, k + 1] for k in range(0, len(sets), 2)]


def test_passages_of_many_documents_give_the_same_components(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"v{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(25)]
    texts = {}
    for k in range(90):
        base = passage + [rng.choice(words) for _ in range(rng.choice([2, 12, 1500 if k % 30 == 0 else 30]))]
        for m in range(2):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words) if m else copy[0]
            texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(nj, "FLAT", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(docs, 4, 85, 100).collect()}
    assert got == nj.reference_components(texts, 4, 85, 100)
