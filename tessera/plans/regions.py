"""Regions of a quadtree by their paths: what a decision rule costs at each node, and where two covers agree.

A node's path is text, a digit from 0 to 3 for each level; the root's is empty. A region lies in another if its path begins with
the other's, so containment is an equi-join on beginnings and no range join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import discard, stored


def region_decisions(leaves: DataFrame, singles: DataFrame, by: Sequence[str], path: str, cost: str, single: str, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """by, path, split_cost, single_cost, merged, chosen, cost, agree, regret for each inner node above a leaf.

    leaves have a cost each; singles those of nodes that can be coded whole. A node merges if that costs less than the best of
    its four parts together; merge(split_cost, single_cost) is the rule under study, false if it gives null. regret is what
    the rule's choice costs beyond the best, each node's parts being the best. Level after level from the deepest, so the
    rounds are the tree's levels; null costs count as 0, absent parts too. (by, path) must be unique in both tables.
    """
    keys = list(by)
    level = stored(leaves.select(*keys, F.col(path).alias("path"), F.coalesce(F.col(cost), F.lit(0.0)).cast("double").alias("cost")), "leaves")
    whole = singles.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(path).alias("_path"), F.col(single).cast("double").alias("single_cost"))
    deepest = level.agg(F.max(F.length("path"))).first()[0] or 0
    done = []
    now = level.where(F.length("path") == deepest)
    for depth in range(deepest - 1, -1, -1):
        sums = now.groupBy(*keys, F.substring("path", 1, depth).alias("path")).agg(F.sum("cost").alias("split_cost"))
        on = sums["path"] == whole["_path"]
        for k in keys:
            on = on & sums[k].eqNullSafe(whole[f"_k_{k}"])
        both = sums.join(whole, on, "left").drop("_path", *[f"_k_{k}" for k in keys])
        best = F.coalesce(F.col("single_cost") < F.col("split_cost"), F.lit(False))
        rule = F.coalesce(merge(F.col("split_cost"), F.col("single_cost")), F.lit(False))
        price = lambda m: F.when(m, F.coalesce("single_cost", "split_cost")).otherwise(F.col("split_cost"))
        made = both.withColumns({"merged": best, "chosen": rule}).withColumns({"cost": price(F.col("merged")), "agree": F.col("merged") == F.col("chosen")})
        made = stored(made.withColumn("regret", F.greatest(price(F.col("chosen")) - F.col("cost"), F.lit(0.0))), "regions")
        done.append(made)
        now = made.select(*keys, "path", "cost").unionByName(level.where(F.length("path") == depth).select(*keys, "path", "cost"))
    if not done:
        return level.where("false").select(*keys, "path", *[F.lit(0.0).alias(c) for c in ("split_cost", "single_cost")], F.lit(False).alias("merged"), F.lit(False).alias("chosen"), "cost", F.lit(False).alias("agree"), F.lit(0.0).alias("regret"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = stored(out, "regions")
    for table in done:
        discard(table)
    return out


def cover(decisions: DataFrame, leaves: DataFrame, by: Sequence[str], path: str, merged: str) -> DataFrame:
    """by and path of the regions that are coded: merged nodes, and leaves, that no merged node lies above."""
    keys = list(by)
    tops = decisions.where(merged).select(*keys, "path")
    every = tops.unionByName(leaves.select(*keys, F.col(path).alias("path")))
    above = every.select(*keys, "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("_up"))
    named = tops.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("path").alias("_top"))
    above = above.where(F.length("_up") < F.length("path"))
    on = above["_up"] == named["_top"]
    for k in keys:
        on = on & above[k].eqNullSafe(named[f"_k_{k}"])
    under = above.join(named, on, "left_semi").select(*keys, "path").distinct().withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "path"]})
    on = every["path"] == under["_k_path"]
    for k in keys:
        on = on & every[k].eqNullSafe(under[f"_k_{k}"])
    return every.join(under, on, "left_anti")


def covered_agreement(one: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, same, area: the share of each group's area that both covers code by the same regions, and the area they share.

    Of two regions that overlap, one lies in the other; the smaller's area, 4 ** -depth, is theirs in common. Groups of one cover alone are left out.
    """
    keys = list(by)
    heads = lambda df, name: df.select(*keys, F.col("path").alias(name), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("_at"))

    def within(inner: DataFrame, outer: DataFrame, strict: bool) -> DataFrame:
        a = heads(inner, "_inner")
        b = outer.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("path").alias("_outer"))
        on = a["_at"] == b["_outer"]
        for k in keys:
            on = on & a[k].eqNullSafe(b[f"_k_{k}"])
        met = a.join(b, on)
        met = met.where(F.length("_outer") < F.length("_inner")) if strict else met
        return met.select(*keys, F.pow(F.lit(4.0), -F.length("_inner").cast("double")).alias("_area"), (F.col("_inner") == F.col("_outer")).alias("_same"))

    met = within(one, other, False).unionByName(within(other, one, True))
    return met.groupBy(*keys).agg((F.sum(F.when(F.col("_same"), F.col("_area")).otherwise(0.0)) / F.sum("_area")).alias("same"), F.sum("_area").alias("area"))
