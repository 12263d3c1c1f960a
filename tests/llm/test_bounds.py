"""Inputs that once were lost, or that took time or memory with the square of a part of them."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, toxicity, url_filter, warc


def test_a_url_of_two_megabytes_is_read_back(spark):
    rows = [(1, "http://a/", "first"), (2, "http://b/" + "x" * (2 << 20), "second"), (3, "http://c/", "first")]
    path = warc.write_archives(warc.with_record_types(spark.createDataFrame(rows, "page_id long, url string, html string")))
    records = warc.read_archives(warc.read_folder(spark, path))
    assert {r.record_id: len(r.target_uri) for r in records.collect()} == {"1": 9, "2": 9 + (2 << 20), "3": 9}
    assert sorted((r.page_id, r.payload_bytes) for r in warc.resolved(records).collect()) == [(1, 5), (2, 6), (3, 5)]


def test_headers_without_end_are_gaps():
    good = warc._record("response", "1", "http://a/", warc.EMPTY_DIGEST, "", b"")
    bad = b"WARC/1.1\r\nWARC-Type: response\r\n" * 2000
    found = list(warc.salvage(good + bad + good))
    assert [(r[2] is None) for r in found] == [True, False, True] and found[1][1] == len(bad)
    start = time.time()
    assert [r[2] for r in warc.salvage(b"WARC/1.1\r\n" * 200_000)] != [None]
    assert time.time() - start < 20


def test_one_id_on_very_many_rows_gives_one_text(spark):
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("row "), F.col("id")).alias("text"))
    docs = many.unionAll(spark.createDataFrame([(8, "clean"), (9, None), (10, "both")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (9, 1), (10, 0), (10, 1), (11, 0), (None, 1)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels)
    assert sorted(zip(texts, y, strict=True)) == [("both", 1), ("clean", 0), ("row 0", 1)]
    assert len(toxicity.sample(docs, labels, rows=1)[0]) == 2


def test_a_million_hits_in_one_text(spark):
    n = 1_000_000
    docs = spark.createDataFrame([(1, "spam " * n), (2, "ham and spam"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "spam"), (6, "spam spam spam spam spam spam spam spam spam spam"), (None, "ham")], "item_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.n_near) for r in decontamination.decontaminate(docs, items, spans=False).collect()}
    assert got == {1: (n, n, [5, 6], n), 2: (3, 2, [5], 2), 3: (0, 0, [], 0)}
    assert time.time() - start < 60


def test_blocks_of_windows_give_the_same(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 23}" for j in range(60))) for k in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(f"w{(k * j + 3) % 23}" for j in range(14))) for k in range(30)], "item_id long, text string")
    rows = lambda **o: sorted((r.doc_id, r.n_hit, r["items"], r.n_near) for r in decontamination.decontaminate(docs, items, width=4, slop=1, **o).collect())
    assert rows(block=7, spans=False) == rows() and any(r[1] for r in rows())
    spans = decontamination.decontaminate(docs, items, width=4, slop=1, block=7)
    for r in spans.collect():
        hit = {p for s in r.spans if s.kind == "exact" for p in range(s.start, s.end)}
        assert len(hit) == r.n_hit and len({s.start for s in r.spans}) == r.n_near
        assert sorted({s.item_id for s in r.spans if s.kind == "exact"}) == r["items"]


@pytest.mark.parametrize("labels", [3_000, 100_000])
def test_a_host_of_very_many_labels(spark, labels):
    pages = spark.createDataFrame([(1, "http://" + "a." * labels + "example.com/en/x"), (2, "http://example.com/en/"), (3, "http://com"), (4, None)], "page_id long, url string")
    rules = url_filter.rule_table(spark, [("block", "example.com", "/en/"), ("allow", "com", "/"), ("block", "a.b.c.example.com", "/")])
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("example.com/en/", "block"), 3: (None, "allow"), 4: (None, "allow")}
    assert time.time() - start < 40
