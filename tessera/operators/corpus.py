"""Families, splits, samples and duplicates of a corpus of captures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.order import prefix_sums, previous


def unit_hash(text: Column) -> Column:
    """First eight bytes of the SHA-256 as a fraction of 2^64."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double") / F.lit(float(2**64))


def split(family: Column, holdout: float, development: float) -> Column:
    """'holdout', 'development' or 'calibration', by the family's hash alone."""
    u = unit_hash(family)
    return F.when(u < holdout, "holdout").when(u < holdout + development, "development").otherwise("calibration")


def fold(family: Column, folds: int) -> Column:
    """Fold of a family: the first four bytes of a salted SHA-256, modulo folds."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit("fold:"), family), 256), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def fold_bursts(df: DataFrame, by: Sequence[str], stamp: str, order: str, seconds: float, name: str = "family") -> DataFrame:
    """Family of each row: the order value of the first row of its burst.

    A row continues the burst if it comes no later than seconds after the stamped row before it. Rows without a stamp
    are families of their own.
    """
    w = Window.partitionBy(*by, F.col(stamp).isNull()).orderBy(stamp, order)
    at = F.col(stamp).cast("timestamp").cast("double")
    rows = df.withColumn("_new", F.when(F.col(stamp).isNull() | F.lag(stamp).over(w).isNull() | (at - F.lag(at).over(w) > seconds), 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(order).over(Window.partitionBy(*by, F.col(stamp).isNull(), "_g").orderBy(stamp, order))
    return rows.withColumn(name, first).drop("_new", "_g")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fold_similar(df: DataFrame, by: Sequence[str], order: Sequence[str], vector: str, threshold: float, name: str = "chain") -> DataFrame:
    """Number of the chain of each row: a row continues it if its vector is that like the one before.

    Predecessors and numbers are found in two levels, so a group of any size is spread over the tasks.
    """
    rows = previous(df, by, order, [vector]).drop("_part")
    like = cosine(F.col(vector), F.col(f"before_{vector}"))
    rows = rows.withColumn("_new", F.when(F.coalesce(like, F.lit(-2.0)) >= threshold, 0).otherwise(1)).drop(f"before_{vector}")
    out = prefix_sums(rows, by, [F.col(c) for c in order], {name: F.col("_new")})
    return out.withColumn(name, F.col(name) + F.col("_new")).drop("_new", f"{name}_all")


def sample(df: DataFrame, group: str, family: str, key: str, cap: int, most: int) -> DataFrame:
    """At most most rows: one of each family, at most cap of each group in hash order, groups taking turns.

    The group and turn are columns; the last limit is a top-k over (turn, group).
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    one = df.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy("_h", key))).where("_r = 1")
    turn = one.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy("_h", key))).where(F.col("turn") <= cap)
    return turn.orderBy("turn", group).limit(most).drop("_h", "_r")


def dedupe(df: DataFrame, by: Sequence[str], priced: Column, order: Sequence[Column | str]) -> DataFrame:
    """One row of each key: the first that is priced, else the first."""
    w = Window.partitionBy(*by).orderBy(F.when(priced, 0).otherwise(1), *order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def spanning_families(df: DataFrame, family: str, part: str) -> DataFrame:
    """Families whose rows are in more than one part."""
    return df.groupBy(family).agg(F.countDistinct(part).alias("parts")).where("parts > 1")


def exclude(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def unknown(selected: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Selected keys that are not known."""
    return selected.select(*on).distinct().join(known.select(*on), list(on), "left_anti")


def only(df: DataFrame, selected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of df whose key is selected; a selected key that df lacks fails the query."""
    lost = unknown(selected, df, on).select(F.raise_error(F.concat(F.lit("unknown: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))).cast("string").alias("_lost"))
    kept = df.join(selected.select(*on).distinct(), list(on), "left_semi")
    # Each lost key raises when it is counted; without one the count is 0 and all rows stay.
    n = lost.agg(F.count("_lost").alias("_n"))
    return kept.crossJoin(F.broadcast(n)).where("_n >= 0").drop("_n")


def referenced(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Sorted distinct values of each group."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("values"))


def geometric_grid(lo: int, hi: int, ratio: float) -> Column:
    """Integers lo .. hi in about geometric steps, rounded half to even, duplicates dropped, as an array."""
    n = math.ceil(math.log(hi / lo) / math.log(ratio)) + 1 if hi > lo else 1
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.least(F.lit(hi), F.bround(F.lit(float(lo)) * F.pow(F.lit(float(ratio)), k.cast("double"))).cast("int")))))


def refine_scales(below: Column, above: Column, count: int) -> Column:
    """Up to count integers strictly between two, in geometric steps."""
    at = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.bround(F.exp(F.ln(below) + (F.ln(above) - F.ln(below)) * k / (count + 1))).cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(at, lambda v: (v > F.least(below, above)) & (v < F.greatest(below, above)))))


def united(*rounds: DataFrame) -> DataFrame:
    """Rows of all frames by column name, missing columns null, with the number of their frame as round."""
    out = None
    for k, df in enumerate(rounds):
        own = df.withColumn("round", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def value_lattice(base: int, coarse: bool = False, refine_only: bool = False) -> list[int]:
    """Multipliers to try around base: every integer from half of it (base itself with refine_only) to twice it; coarse:
    half octaves from twice it down, the first of equal ones kept."""
    if not coarse:
        return list(range(base if refine_only else max(1, base // 2), 2 * base + 1))
    steps = [min(max(math.floor(base * 2.0 ** (-k / 2) + 0.5), 1), 2 * base) for k in range(-2, 1 if refine_only else 3)]
    return list(dict.fromkeys(steps))
