"""An id that stands for unlike texts is no document of its own."""

import os

import pytest

import corpus_pipeline as p
from tessera.llm import ngram_join as nj

DATA = "/root/testdata/sf0.001"


def test_unlike_texts_of_one_id_stay(spark):
    text = lambda w, n=40: " ".join(f"{w}{k}" for k in range(n))
    rows = [(0, text("a")), (0, text("b")), (0, text("c")), (0, text("c")), (1, text("a") + " x"), (2, text("b") + " y"), (3, text("d")), (0, None), (None, text("d"))]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in p.one_of_each_group(spark, docs, "").collect()), key=str)
    want = sorted([(0, text("a")), (0, text("b")), (0, text("c")), (3, text("d")), (0, None), (None, text("d"))], key=str)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_smallest_id_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = p.one_of_each_group(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in nj.reference_components(texts, 5, 80, 100).items() if i == c}
