"""Bursts of stamped rows as session windows: the same function serves batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(df: DataFrame, key: str, stamp: str, seconds: int, late: str | None = None) -> DataFrame:
    """first, last and n of each burst: rows no further apart than seconds.

    Streams need late, how long rows may be delayed; a burst is given out once no row can join it any more. Rows without
    a stamp are left out.
    """
    rows = df.where(F.col(stamp).isNotNull()).withColumn("_at", F.col(stamp).cast("timestamp"))
    rows = rows if late is None else rows.withWatermark("_at", late)
    # A session ends its length after its last row; one microsecond more makes the border belong to it.
    window = F.session_window("_at", F.lit(f"{seconds} seconds 1 microsecond"))
    return rows.groupBy(key, window).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def progressive(df: DataFrame, keys: list[str], value: str, shift: str) -> DataFrame:
    """Coefficients so far of refinement passes: the sum of each pass' value times two to its shift (update mode)."""
    return df.groupBy(*keys).agg(F.sum(F.col(value) * F.pow(F.lit(2.0), F.col(shift).cast("double")).cast("bigint")).alias("coefficient"))


def append_once(df: DataFrame, done_path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Writes only rows whose key is not yet at done_path; a restarted stream skips what it has written."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        try:
            done = spark.read.schema(rows.schema).parquet(done_path).select(key).distinct()
            rows = rows.join(done, key, "left_anti")
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.dropDuplicates([key]).write.mode("append").parquet(done_path)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
