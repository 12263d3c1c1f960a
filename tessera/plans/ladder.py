"""Searches over a materialised ladder of candidates: filters and aggregates in place of a probe after probe.

They give the optimum of the ladder, not the sequence of probes that a live search would make.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest_within(ladder: DataFrame, by: Sequence[str], rung: str, size: str, target: Column) -> DataFrame:
    """The rung whose size is the largest within target; ties to the higher rung."""
    fit = F.max(F.when(F.col(size) <= target, F.struct(F.col(size).alias("size"), F.col(rung).alias("rung"))))
    return ladder.groupBy(*by).agg(fit.alias("c")).select(*by, F.col("c.rung").alias("rung"), F.col("c.size").alias("size"))


def smallest_reaching(ladder: DataFrame, by: Sequence[str], rung: str, size: str, score: str, target: Column) -> DataFrame:
    """The rung of the smallest size whose score reaches target; ties to the lower rung; null if none does."""
    fit = F.min(F.when(F.col(score) >= target, F.struct(F.col(size).alias("size"), F.col(rung).alias("rung"), F.col(score).alias("score"))))
    return ladder.groupBy(*by).agg(fit.alias("c")).select(*by, F.col("c.rung").alias("rung"), F.col("c.size").alias("size"), F.col("c.score").alias("score"))


def quadtree_cover(costs: DataFrame, by: Sequence[str], levels: int) -> DataFrame:
    """Cheapest cover of each root: a node's own cost or the sum of its four children's best, from the leaves up.

    costs: by, level (0 is a leaf), x, y, cost; the result has the root's best cost and its number of nodes.
    """
    best = costs.where("level = 0").select(*by, "x", "y", F.col("cost").alias("best"), F.lit(1).cast("bigint").alias("nodes"))
    for level in range(1, levels + 1):
        up = best.groupBy(*by, F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum("best").alias("_sum"), F.sum("nodes").alias("_n"))
        own = costs.where(F.col("level") == level).select(*by, "x", "y", "cost")
        keep = F.col("cost").isNotNull() & (F.col("cost") <= F.col("_sum"))
        best = up.join(own, [*by, "x", "y"], "left").select(*by, "x", "y", F.when(keep, F.col("cost")).otherwise(F.col("_sum")).alias("best"), F.when(keep, F.lit(1).cast("bigint")).otherwise(F.col("_n")).alias("nodes"))
    return best


def best_factor(df: DataFrame, by: Sequence[str], x: str, y: str, scale: int, low: int, high: int) -> DataFrame:
    """Integer factor of y over x: the least-squares optimum, then the cheapest of it, two on each side, and 0 first.

    Energies follow from three sums, so candidates are compared without the rows.
    """
    s = df.groupBy(*by).agg(F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    centre = F.when(F.col("xx") > 0, F.round(F.col("xy") / F.when(F.col("xx") > 0, F.col("xx")) * scale)).otherwise(0).cast("int")
    tried = F.transform(F.array_append(F.sequence(centre - 2, centre + 2), F.lit(0)), lambda f: F.least(F.greatest(f, F.lit(low)), F.lit(high)))
    rows = s.withColumn("factor", F.explode(F.array_distinct(tried)))
    f = F.col("factor") / F.lit(float(scale))
    energy = F.round(F.col("yy") - 2 * f * F.col("xy") + f * f * F.col("xx"), 6)
    return rows.withColumn("energy", energy).groupBy(*by).agg(F.min(F.struct("energy", (F.col("factor") != 0).alias("other"), "factor")).alias("b")).select(*by, F.col("b.factor").alias("factor"), F.col("b.energy").alias("energy"))
