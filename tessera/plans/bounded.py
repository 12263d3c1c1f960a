"""Costs that are given up as soon as they cannot win."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounded_costs(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: Sequence[tuple[str, str]], fixed: Column | None = None) -> DataFrame:
    """df with bound, cutoff, parts_done, cost and safe: each group's candidates, the lowest bound first.

    parts are (lower bound, exact cost) columns, in the order in which the costly ones are worked out. A candidate's cutoff is
    the least cost of those before it (ties of bounds by order); it is given up as soon as the parts worked out and the
    bounds of the others reach that: parts_done is how many it came to, and cost, what all parts and fixed come to, is null then, and
    null if it does not beat the cutoff. safe tells whether no part is below its bound: where all are, the last cost of a
    group that is not null is its least, whatever was given up. Null parts count as 0. A group is one window: the candidates of
    one place, which are few.
    """
    bounds = [F.coalesce(F.col(b), F.lit(0.0)).cast("double") for b, _ in parts]
    costs = [F.coalesce(F.col(c), F.lit(0.0)).cast("double") for _, c in parts]
    base = F.lit(0.0) if fixed is None else fixed.cast("double")
    stages = []
    for k in range(len(parts) + 1):
        total = base
        for c in [*costs[:k], *bounds[k:]]:
            total = total + c
        stages.append(total)
    safe = F.lit(True)
    for b, c in zip(bounds, costs, strict=True):
        safe = safe & (b <= c)
    rows = df.withColumns({"bound": stages[0], "_exact": stages[-1], "safe": safe})
    before = Window.partitionBy(*by).orderBy("bound", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cutoff", F.min("_exact").over(before))
    given_up = F.lit(None).cast("int")
    for k in range(len(parts) - 1, -1, -1):
        given_up = F.when(stages[k] >= F.col("cutoff"), k).otherwise(given_up)
    rows = rows.withColumn("parts_done", F.coalesce(given_up, F.lit(len(parts))))
    wins = (F.col("parts_done") == len(parts)) & F.coalesce(F.col("_exact") < F.col("cutoff"), F.lit(True))
    return rows.withColumn("cost", F.when(wins, F.col("_exact"))).drop("_exact")


def bounded_summary(rows: DataFrame, by: Sequence[str], parts: int) -> DataFrame:
    """by, candidates, best (the least cost), parts_done, skipped (parts that were not worked out) and unsafe candidates, of `bounded_costs`."""
    return rows.groupBy(*by).agg(F.count("*").alias("candidates"), F.min("cost").alias("best"), F.sum("parts_done").alias("parts_done"), (F.count("*") * parts - F.sum("parts_done")).alias("skipped"), F.count_if(~F.col("safe")).alias("unsafe"))
