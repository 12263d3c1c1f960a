"""The join for hot keys gives what a plain left join gives, whichever way it takes."""

import pytest
from pyspark.sql import functions as F

from tessera.llm.shared import skew_join, stored


@pytest.mark.parametrize(("most", "most_bytes"), [(100_000, 64 << 20), (4, 64 << 20), (100_000, 10), (4, 200), (4, 10)])
def test_same_as_a_left_join(spark, most, most_bytes):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("key")).repartition(3)
    counts = left.where("key is not null and key <> 'k5'").groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.array(F.repeat("key", 9)))
    got = skew_join(left, stored(counts, "counts"), "key", most=most, most_bytes=most_bytes)
    rows = lambda df: sorted((r.id, r.key, None if r.v is None else tuple(r.v)) for r in df.select("id", "key", "v").collect())
    assert rows(got) == rows(left.join(counts.drop("n"), "key", "left"))


def test_long_words_are_not_broadcast(spark):
    word = F.rpad(F.concat(F.lit("w"), F.col("id") % 40), 200_000, "x")
    left = spark.range(400).select("id", word.alias("key")).repartition(4)
    counts = stored(left.groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.length("key")), "counts")
    joined = skew_join(left, counts, "key", most=30, most_bytes=1 << 20)
    assert joined.where("v = 200000").count() == 400


def test_empty_tables(spark):
    left, right = spark.createDataFrame([], "id long, key string"), spark.createDataFrame([], "key string, n long, v int")
    assert skew_join(left, right, "key").count() == 0
    assert [tuple(r) for r in skew_join(spark.createDataFrame([("a", 1)], "key string, id long"), right, "key", most_bytes=-1).collect()] == [("a", 1, None)]
