"""Row numbers, running sums and predecessors in an order, in two levels, so that no group is one task's.

Rows are dealt to tasks by ranges of (group, order) and stored, which fixes the ranges. Each range gets what comes before
it in its group from a table with a row for each group and range; the rest is a window inside the range. A group that
holds a third of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import stored


def ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with _part, which rises with (by, order); rows of equal order are in one part."""
    return stored(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _joined(rows: DataFrame, per_part: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of per_part, by (by, _part), nulls equal."""
    named = per_part.withColumnsRenamed({c: f"_k_{c}" for c in [*by, "_part"]})
    on = rows["_part"] == named["_k__part"]
    for b in by:
        on = on & rows[b].eqNullSafe(named[f"_k_{b}"])
    return rows.join(named, on).drop(*[f"_k_{c}" for c in [*by, "_part"]])


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over the group's rows before this one, and name_all over the group.

    Without sums it is 0. Rows of equal order come in any order; order by something that tells them apart.
    """
    rows = ranges(df.withColumns({f"_s_{n}": c for n, c in sums.items()}), by, order)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    per_part = totals.select(*by, "_part", *[zero(F.sum(f"_t_{n}").over(earlier)).alias(f"_b_{n}") for n in sums], *[zero(F.sum(f"_t_{n}").over(group)).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{n}": zero(F.sum(f"_s_{n}").over(inside)) for n in sums})
    out = _joined(rows, per_part, by)
    return out.withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in sums}).drop("_part", *[f"_{k}_{n}" for n in sums for k in "sbi"])


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with its row number (from 1) in its group, and the group's rows as name_all."""
    return prefix_sums(df, by, order, {name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df with before_<c> for each c of values: its value in the group's row before this one, null in the first row.

    _part stays in the result; it rises with the order.
    """
    rows = ranges(df, by, [F.col(c) for c in order])
    last = rows.groupBy(*by, "_part").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    per_part = last.select(*by, "_part", F.lag("_last").over(Window.partitionBy(*by).orderBy("_part")).alias("_last"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    rows = rows.withColumns({f"_l_{c}": F.lag(c).over(inside) for c in values}).withColumn("_first", F.row_number().over(inside) == 1)
    out = _joined(rows, per_part, by)
    return out.withColumns({f"before_{c}": F.when(F.col("_first"), F.col(f"_last.{c}")).otherwise(F.col(f"_l_{c}")) for c in values}).drop("_last", "_first", *[f"_l_{c}" for c in values])
