"""Hard negatives against a full comparison and the query's SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as h
from tessera.llm.registry import OP11_SQL, op11_hard_negatives

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def full(rows, every=10, positives=5, negatives=10, scale=256):
    ok = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = (label, [math.floor(scale * x) for x in v])
    out = []
    for a, (label, q) in ok.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), b) for b, (_, v) in ok.items() if b != a)
        for s, p in [(-s, b) for s, b in scored if ok[b][0] == label][:positives]:
            fits = [(-n, b) for n, b in scored if ok[b][0] != label and 30 * s <= -100 * n <= 90 * s]
            out += [(a, p, k + 1, b, s, n) for k, (n, b) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("pivot", F.lit(1)).repartition(3)
    got = h.hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def test_same_as_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = duck.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({OP11_SQL}) ORDER BY ALL").fetchall()
    got = op11_hard_negatives(spark, DATA).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_groups_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8))
    rows = [(k, (centres[k % 12] + 0.1 * rng.standard_normal(8)).tolist(), int(rng.integers(0, 3))) for k in range(700)]
    same = rng.standard_normal(8).tolist()
    rows += [(700 + k, same, k % 2) for k in range(350)]
    rows += [(1100 + k, rng.integers(-2, 3, 8).astype(float).tolist(), k % 4) for k in range(200)]
    assert mined(spark, rows) == full(rows)


def test_blocks_beyond_the_radius_are_not_read(spark):
    rng = np.random.default_rng(6)
    centres = 4 * rng.standard_normal((16, 12))
    rows = [(k, (centres[k % 16] + 0.05 * rng.standard_normal(12)).tolist(), k % 2) for k in range(4000)]
    usable, dim = h.usable_rows(spark.createDataFrame(rows, SCHEMA), 256.0, "vec_id", "embedding", F.col("label"))
    index = h.build(usable, dim)
    asked = usable.where("id % 400 = 0").select("id", "label", F.col("v").alias("q"), F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-index.square).cast("long").alias("lo"), F.lit(index.square).cast("long").alias("hi"))).alias("windows"))
    first = asked.select("*", F.lit(-1.0).alias("reached"), F.array(F.lit(None).cast("long")).alias("best"))
    found = h.certified(index, asked, 5, True)
    kth = found.groupBy("id").agg(F.array(F.min("score")).alias("best"))
    done = first.drop("best").join(kth, "id").select("id", "label", "q", "windows", "reached", "best")
    blocks = done.mapInArrow(h._widened(index, None), f"{h.STATE}, upto double, blocks array<int>").select(F.size("blocks").alias("n")).collect()
    assert max(b.n for b in blocks) < 0.3 * len(index.n)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (6, [], 1)]
    rows += [(10, [1.0, 0.5], 1), (11, [1.0, 0.25], 1), (12, [0.5, 0.25], 2), (13, [-1.0, 0.0], 1), (14, [0.0, 0.0], 2), (15, [0.0, 0.0], 1), (16, [0.5, 0.2499], 2), (20, [0.0, 0.0], 2)]
    assert mined(spark, rows) == full(rows)
    assert mined(spark, [*rows, (11, [1.0, 0.25], 1), (30, [1.0, 1.0, 1.0], 1)]) == full(rows)
    assert mined(spark, []) == [] and mined(spark, rows[:7]) == [] and mined(spark, [(k, [1.0], 1) for k in range(30)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_scores_that_are_not_exact_raise(spark):
    with pytest.raises(ValueError):
        mined(spark, [(10, [1e9], 1), (11, [1e9], 2)])
