"""Recall of the nearest-neighbour search at the production share, against brute force."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert_ann as ann

DATA = "/root/testdata/sf0.01"


def recall(got, vectors, queries, k):
    want = ann.exact_nearest(vectors, queries, k)
    return np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in queries])


def found(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
    return dict(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_on_the_supplied_vectors(spark):
    d = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in d.collect()}
    queries = [i for i in vectors if i % 50 == 0]
    got = found(ann.nearest(d, 20, F.col("vec_id") % 50 == 0))
    assert recall(got, vectors, queries, 20) >= 0.9
    assert found(ann.nearest(d.repartition(7).withColumn("score", F.lit(1)), 20, F.col("vec_id") % 50 == 0)) == got


def test_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.2, 3.0, (3000, 1))
    vectors = dict(enumerate(x))
    queries = list(range(0, 3000, 50))
    d = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id long, embedding array<double>")
    assert recall(found(ann.nearest(d, 20, F.col("vec_id") % 50 == 0)), vectors, queries, 20) >= 0.9
