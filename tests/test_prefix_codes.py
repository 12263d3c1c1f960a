"""Code lengths against every choice of lengths, and prefix codes of many symbols in bounded memory."""

import heapq
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import entropy


def best(counts, limit):
    fits = (ls for ls in product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-k for k in ls) <= 1)
    return min(sum(n * k for n, k in zip(counts, ls, strict=True)) for ls in fits)


@pytest.mark.parametrize("limit", [3, 4, 6])
def test_total_length_is_the_least(spark, limit):
    rng = np.random.default_rng(limit)
    groups = {g: [int(v) for v in rng.integers(1, 1 + 4**g, int(rng.integers(2, 7)))] for g in range(5)}
    df = spark.createDataFrame([(g, k, n) for g, ns in groups.items() for k, n in enumerate(ns)], "g int, s int, n long")
    got = {}
    for r in entropy.huffman_lengths(df, ["g"], "s", limit).collect():
        got[r.g] = got.get(r.g, 0) + r.n * r.length
    assert got == {g: best(ns, limit) for g, ns in groups.items()}


def test_twenty_thousand_symbols(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("s"), (F.col("id") % 97 + 1).alias("n"))
    total = entropy.huffman_lengths(df, ["g"], "s", 20).agg(F.sum(F.col("n") * F.col("length"))).first()[0]
    heap, want = [k % 97 + 1 for k in range(20_000)], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        want += two
        heapq.heappush(heap, two)
    assert total == want
