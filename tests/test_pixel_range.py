"""Sample arithmetic on values over the range of the smallest tables."""

import duckdb
from pyspark.sql import functions as F

import tessera.registry as registry
from tessera.functions import pixel


def test_samples_over_one_are_as_in_sql(spark, tmp_path):
    values = [0.0, 8.99, 9.0, 499.99, 500.0, 500.25, 520.16, 560.21, 12_345.67, None]
    rows = [(k, k * 37, v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = con.execute(registry.oracle_sql()["pixel_arithmetic"])
    names = [c[0] for c in got.description]
    expected = sorted(got.fetchall())
    assert sorted(tuple(r) for r in registry.queries()["pixel_arithmetic"](spark, str(tmp_path)).select(*names).collect()) == expected
    assert max(r[names.index("depth")] for r in expected) > 1023


def test_the_clamp_stays_the_default(spark):
    r = spark.range(1).select(*[pixel.depth_quantize(F.lit(v), 10, c).alias(n) for n, v, c in (("over", 1.5, True), ("under", -0.5, True), ("free", 1.5, False), ("nan", float("nan"), False))]).first()
    assert (r.over, r.under, r.free, r.nan) == (1023, 0, 1535, 0)
