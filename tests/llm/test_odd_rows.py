"""Nulls, repeats, empty tables and clashing columns in the pipeline's stages and the operators behind them."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tessera.llm import decontamination, mixing, sharding
from tessera.llm.shared import skew_join, stored

ODD = "doc_id long, text string, source string, size string, copy string, copies string, rate int, target int, source_size int, slot string, shard string, _slot int, _key string, _row int, _draw int, N int"


def odd_rows(texts):
    return [(i, t, s, f"own{k}", "mine", "c", 1, 2, 3, "old", "old", 4, "k", 5, 6, 7) for k, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 7 == 0)) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


TEXTS = (
    [(k, " ".join(f"a{k}x{j}" for j in range(40)), ["s", None, "t"][k % 3]) for k in range(12)]
    + [(20, "ONE two three, four five six seven eight nine ten!", "s"), (21, None, "s"), (21, None, "s"), (22, "", None), (None, "alone " * 9, "t"), (None, None, None)]
    + [(0, " ".join(f"a0x{j}" for j in range(40)), "s"), (0, "another text of this id " * 3, "s"), (30, " ".join(f"a1x{j}" for j in range(39)) + " end", "t")]
)


def test_stages_keep_odd_rows_and_columns(spark, folder):
    rows = odd_rows(TEXTS)
    docs = spark.createDataFrame(rows, ODD)
    whole = collections.Counter(map(tuple, rows))
    for name, stage in p.STAGES:
        got = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "sharding":
            assert got.columns == [c for c in docs.columns if c not in ("slot", "shard")] + ["slot", "shard"]
            assert collections.Counter(tuple(r)[:9] for r in got.collect()) == collections.Counter(r[:9] for r in rows)
            continue
        assert got.columns == docs.columns
        kept = collections.Counter(map(tuple, got.collect()))
        if name == "toxicity":
            assert not kept - whole and all((r[0], r[1]) in {(k[0], k[1]) for k in kept} for r in rows if not r[1])
        if name == "decontamination":
            assert whole - kept == collections.Counter(r for r in rows if r[0] == 20)
        if name == "ngram_join":
            left = sorted(((r[0], r[1]) for r in kept.elements()), key=str)
            want = {(i, t) for i, t, _ in TEXTS if i is not None and i != 30}
            assert left == sorted([*want, *[(i, t) for i, t, _ in TEXTS if i is None]], key=str)
            assert not kept - whole
        if name == "mixing":
            copies = {tuple(r[c] for c in docs.columns): r["_n"] for r in mixing._dealt(docs, mixing.WEIGHTS, 1.5, 2.0, 0, "doc_id", "text", "source").select("_row.*", F.col("_copies").alias("_n")).collect()}
            assert kept == collections.Counter({r: n for r, n in copies.items() if n})


def test_mix_and_place_replace_only_their_own_names(spark):
    docs = spark.createDataFrame(odd_rows(TEXTS), ODD)
    mixed = mixing.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c not in ("size", "copies", "rate", "target", "source_size")] + ["size", "source_size", "target", "rate", "copies"]
    assert {r.copy for r in mixed.collect()} == {"mine"} and {r["_key"] for r in mixed.collect()} == {"k"}
    placed = sharding.place(docs, ["x", "y"], 101).collect()
    assert {r["_slot"] for r in placed} == {4} and {r.shard for r in placed} <= {"x", "y"} and len(placed) == len(TEXTS)
    other = sharding.place(docs, ["x"], 101, slot_col="SIZE", shard_col="where").columns
    assert "size" not in other and other[-2:] == ["SIZE", "where"]


def test_skew_join_is_a_left_join(spark):
    left = spark.createDataFrame([(k % 50 if k % 3 else 7, k) for k in range(600)] + [(None, 1000)], "k int, v int")
    right = stored(left.where("k is not null and k % 5 <> 1").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")), "right")
    want = sorted(map(str, left.join(right.drop("n"), "k", "left").collect()))
    for most in (100_000, 12, 1):
        assert sorted(map(str, skew_join(left, right, "k", most=most).collect())) == want


def test_nearness_like_brute_force(spark):
    import random

    rng = random.Random(8)
    words = [f"w{k}" for k in range(9)]
    items = {k: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5]))) for k in range(6)} | {9: None}
    docs = {k: " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 9, 30]))) for k in range(40)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontamination.BLOCK_WINDOWS, 2):
        got = {r.doc_id: (r.n_near, r.n_hit) for r in decontamination.decontaminate(d, b, width=4, slop=2, block=block).collect()}
        assert got == {i: (decontamination.reference_near(t, items, 4, 2), decontamination.reference_matches(t, items, 4)[1]) for i, t in docs.items()}
    text_ids = decontamination.decontaminate(d.withColumn("doc_id", F.concat(F.lit("t"), "doc_id")), b, width=4).collect()
    assert {r.doc_id: r.n_hit for r in text_ids} == {f"t{i}": decontamination.reference_matches(t, items, 4)[1] for i, t in docs.items()}


def test_very_long_text_and_all_terms(spark):
    long = "zebra " + "word " * 400_000 + "one two three four"
    d = spark.createDataFrame([(1, long), (2, "one two three four")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.decontaminate(d, b, slop=2).collect()}
    assert got == {1: (400_005, 4), 2: (4, 4)}
    windows = decontamination.window_table(b, 10, "item_id", "text")
    assert len(decontamination.window_terms(windows)) == 4 and decontamination.window_terms(windows, 3) is None
    index = decontamination.build_index(d, None, 13)
    assert {r.doc_id for r in decontamination.search(index, next(decontamination.window_blocks(windows, 10)), None, 13, every=False).collect()} == {1, 2}
