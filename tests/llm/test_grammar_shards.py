"""Token shards: exact round trips, random access, and the library's own ids for whole texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F

from tessera.llm import grammar_shards as g

VOCABULARY = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return g.Encoder(VOCABULARY, False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=6), st.integers(2, 5))
def test_round_trip_and_random_access(docs, least):
    lengths = np.array([len(d) for d in docs], np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    shard = g.from_bytes(g.to_bytes(ids, lengths, [None if k % 3 == 2 else f"é{k}" for k in range(len(docs))], least))
    assert shard.all_tokens().tolist() == ids.tolist()
    assert [shard.document(k).tolist() for k in range(len(docs))] == docs
    assert shard.names == [None if k % 3 == 2 else f"é{k}" for k in range(len(docs))]
    for a in range(0, len(ids) + 1, 7):
        for b in range(a, len(ids) + 1, 5):
            assert shard.tokens(a, b).tolist() == ids[a:b].tolist()


def test_frequent_pairs_become_rules():
    ids = np.tile(np.array([7, 8, 9, 7, 8, 4], np.uint32), 200)
    made = g.compress(ids, np.array([len(ids)]))
    assert (7, 8) in set(zip(made["left"].tolist(), made["right"].tolist()))
    assert len(made["symbols"]) < len(ids) / 4


def test_damage_is_noticed():
    data = bytearray(g.to_bytes(np.arange(50, dtype=np.uint32), np.array([50]), ["1"]))
    with pytest.raises(ValueError):
        g.from_bytes(bytes(data[:-3]))
    data[90] ^= 1
    with pytest.raises(ValueError):
        g.from_bytes(bytes(data))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aAbé'sStT \t\n\x0b\x1c\x1f\u0085  ́　İΣ1,.!<|endoftext|>汉🙂ÉßþÿñÑ÷×&$")), max_size=40), max_size=5))
def test_chunks_give_the_ids_of_whole_texts(whole, texts):
    coded = [t.encode() for t in texts] + [b"it's <|endoftext|>5x", b"", "Straße, ñandúes&&& schön. o'er don't (x) [[ÿ]] <|ENDOFTEXT|> a<|b".encode()]
    a, b = whole(coded), g.encoder(VOCABULARY, True)(coded)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def _expected(whole, rows):
    out, start = [], 0
    for doc, text in rows:
        ids = np.append(whole([(text or "").encode()])[0], 2).astype("<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def _got(listed):
    rows = g.read_shards(listed).withColumn("doc_id", F.col("doc_id").cast("long")).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1])


def test_files_hold_all_documents_in_order(spark, whole):
    long = "the long text goes on, " * 4000
    rows = [(k, f"document {k % 7} says the same thing again and again {k}") for k in range(300, 0, -1)] + [(None, "no id"), (400, None), (401, ""), (402, long), (402, long), (-5, "  \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("x")).withColumn("part", F.lit(1)).repartition(5)
    listed = g.write_shards(docs, VOCABULARY, 2, apart=True, shard_ids=500)
    assert listed.count() > 5
    assert _got(listed) == _expected(whole, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))


def test_an_id_that_many_rows_have_is_spread_over_tasks(spark):
    rows = [(7, "the same row") for _ in range(4000)] + [(7, f"another {k}") for k in range(400)] + [(9, "last")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listed = g.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), VOCABULARY, 2, apart=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert listed.select("part").distinct().count() > 1
    got = _got(listed)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    assert len(got) == len(rows) and got[-1][0] == 9


def test_no_documents_give_no_files(spark):
    listed = g.write_shards(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, 2)
    assert listed.count() == 0 and g.read_shards(listed).count() == 0
