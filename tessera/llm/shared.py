"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import discard, new_path, shared_dir, stored

__all__ = ["broadcast_if_few", "discard", "discarding_shuffles", "new_path", "shared_dir", "skew_join", "small_batches", "stored"]


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, size: str = "4m") -> contextlib.AbstractContextManager[None]:
    """Within it, Python gets Arrow batches of about size bytes, however long the rows are."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def discarding_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it, shuffle files go when the action that wrote them ends, not when the driver collects its garbage.

    For steps whose results are stored: a DataFrame on which a second action is run would be shuffled again.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def broadcast_if_few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df, a stored table of narrow rows, marked for broadcast if it has been counted to at most most rows; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


#: Bytes of a table, written out, up to which it is broadcast, and copies of hot rows beyond.
MOST_BYTES, SALTS = 64 << 20, 64


def _sized(df: DataFrame) -> F.Column:
    """Bytes of a table, as its rows are written out."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes")


def skew_join(left: DataFrame, right: DataFrame, on: str, n: str = "n", most: int = 100_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """left with the columns of right (but n), a stored table of one row for each key with the number n of left rows that have it.

    A left join, so null keys and keys that right lacks get nulls. right is broadcast if it has at most most rows and
    most_bytes bytes. Else its keys with more than one most-th of all rows are hot, of which there are fewer than most; rows
    are told apart by the hashes of these keys, which are broadcast, so no other key is a large group in the shuffle that
    takes the rest. The hot rows of right are broadcast if they have at most most_bytes bytes, else copied SALTS times, and the
    left rows of a hot key are dealt to the copies.
    """
    size = right.agg(F.count("*").alias("rows"), F.coalesce(F.sum(n), F.lit(0)).alias("all"), _sized(right)).first()
    if size.rows <= most and size.bytes <= most_bytes:
        return left.join(F.broadcast(right.drop(n)), on, "left")
    hashes = right.where((F.col(n) > size["all"] / most) & F.col(on).isNotNull()).select(F.xxhash64(on).alias("_h")).distinct().withColumn("_hot", F.lit(True))
    marked = lambda df: df.withColumn("_h", F.xxhash64(on)).join(F.broadcast(hashes), "_h", "left").drop("_h")
    mine, theirs = marked(left), marked(right.drop(n))
    rest = mine.where("_hot is null").drop("_hot").join(theirs.where("_hot is null").drop("_hot"), on, "left")
    hot_left, hot_right = mine.where("_hot").drop("_hot"), theirs.where("_hot").drop("_hot")
    if hot_right.agg(_sized(hot_right)).first().bytes <= most_bytes:
        return hot_left.join(F.broadcast(hot_right), on, "left").unionByName(rest)
    dealt = hot_left.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    copied = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [on, "_salt"], "left").drop("_salt").unionByName(rest)
