"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: (u, v) with v < u; each u's neighbours move to the smallest of them.

    Smallest neighbours are map-side combined and joined back, so a node with very many links is no group in one task.
    """
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
    return small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links reach, for every node of a link other than to itself.

    Alternates the two star steps until they change nothing; rounds grow with the logarithm of the longest path, and each
    round is a table in the shared folder. Nulls link nothing; repeated links count once; no links give no rows.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, was = stored(now, "links"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if was is not None and seen == was[1]:
            break
        if was is not None:
            discard(was[0])
        was = now, seen
        now = stored(_stars(now), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
