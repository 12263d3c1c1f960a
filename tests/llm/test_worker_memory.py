"""What stages hold at once beside an executor's heap: rows in Arrow batches, and workers of another kind."""

from types import SimpleNamespace

import pyarrow as pa

import corpus_pipeline
from tessera.llm import decontamination, ngram_join, sharding, toxicity

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class Handed:
    """Stands for documents: mapInArrow gives the function that tasks run."""

    columns, schema = ["doc_id", "text"], None
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda net: SimpleNamespace(value=net)))

    def mapInArrow(self, run, schema):
        return run


def test_rows_of_a_large_batch_go_back_in_pieces():
    net = toxicity.train(["bad evil words here", "good kind words here"] * 40, [1, 0] * 40)
    texts = [None, "", "x " * (2 << 20), *(f"{('evil bad ' if k % 3 else 'good kind ') * 20}{k}" for k in range(12_000)), "good"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = toxicity.below(Handed(), net, 0.3)
    out = list(run([batch, batch.slice(0, 0)]))
    few = 20 + (1 << 20) + 24 * len(texts)
    assert all(b.nbytes <= few or b.num_rows == 1 for b in out) and len(out) > 3
    kept = [i for b in out for i in b.column(0).to_pylist()]
    tops = {}
    for lo in range(3, 6):
        tops[lo % 3] = bool(list(run([batch.slice(lo, 1)]))[0].num_rows)
    assert set(tops.values()) == {True, False}
    expected = [0, 1, *[k for k in (2,) if list(run([batch.slice(2, 1)]))[0].num_rows], *(k for k in range(3, len(texts) - 1) if tops[k % 3]), len(texts) - 1]
    assert kept == expected and pa.Table.from_batches(out).column(1).to_pylist() == [texts[k] for k in kept]


def test_the_lookup_table_starts_no_python_worker(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    placed = sharding.place(docs, ["a", "b", "c"], slots=101)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    owner = sharding.lookup_table(["a", "b", "c"], 101)
    rows = placed.collect()
    assert len(rows) == 50 and all(r.shard == "abc"[owner[r.slot]] for r in rows)
    assert dict(placed.dtypes) == {"doc_id": "bigint", "slot": "int", "shard": "string"}


def test_stages_take_small_batches_and_put_the_setting_back(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, "one two three"), (4, None)], "doc_id long, text string")
    before, seen = spark.conf.get(BATCH, None), []
    for module, name in ((ngram_join, "links_between"), (decontamination, "build_index")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **b: (seen.append(spark.conf.get(BATCH)), f(*a, **b))[1])
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [1, 2, 4]
    assert seen == ["4m", "4m"] and spark.conf.get(BATCH, None) == before
