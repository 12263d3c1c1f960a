"""Distances between pairs of images held as rows with the same keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pairs(a: DataFrame, b: DataFrame, on: Sequence[str], v: str = "v") -> DataFrame:
    """Samples of both images side by side."""
    return a.select(*on, F.col(v).cast("double").alias("a")).join(b.select(*on, F.col(v).cast("double").alias("b")), list(on))


def same_shape(a: DataFrame, b: DataFrame, on: Sequence[str], shape: Sequence[str]) -> DataFrame:
    """Whether two images agree in all shape columns, nulls too."""
    other = b.select(*on, *[F.col(c).alias(f"_{c}") for c in shape])
    agree = F.lit(True)
    for c in shape:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, list(on)).select(*on, agree.alias("same_shape"))


def rmse() -> Column:
    return F.sqrt(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))))


def psnr(error: Column, peak: float) -> Column:
    """Decibels below the peak; infinite without error."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.lit(float(peak)) / F.when(error != 0, error)))


def quality(pair: DataFrame, by: Sequence[str], peak: float) -> DataFrame:
    """Largest error, root mean square error and PSNR."""
    out = pair.groupBy(*by).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("peak_error"), rmse().alias("rmse"))
    return out.withColumn("psnr_db", psnr(F.col("rmse"), peak))


def conforms(channels: DataFrame, by: Sequence[str], peak: float, error: float) -> DataFrame:
    """Whether every channel's peak error and RMSE are within both thresholds."""
    return channels.groupBy(*by).agg(F.bool_and((F.col("peak_error") <= peak) & (F.col("rmse") <= error)).alias("conforms"))


def pooled_norms(pair: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean distance and fourth root of the mean fourth power."""
    d = F.abs(F.col("a") - F.col("b"))
    return pair.groupBy(*by).agg(F.avg(d).alias("norm1"), F.pow(F.avg(d * d * d * d), F.lit(0.25)).alias("norm4"))


def weighted_error(terms: DataFrame, by: Sequence[str], order: Sequence[str], value: str, weights: DataFrame) -> DataFrame:
    """Sum of weight times |term|, weights (k, weight) dealt to the terms that exist in order."""
    ranked = terms.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return ranked.join(F.broadcast(weights), "k").groupBy(*by).agg(F.sum(F.col("weight") * F.abs(F.col(value))).alias("error"))


def churn(a: DataFrame, b: DataFrame, by: Sequence[str], on: Sequence[str], choice: str) -> DataFrame:
    """Share of the cells present in both maps whose choice differs; 0 if they share none."""
    both = a.select(*by, *on, F.col(choice).alias("_a")).join(b.select(*by, *on, F.col(choice).alias("_b")), [*by, *on])
    out = both.groupBy(*by).agg(F.avg(F.when(F.col("_a") != F.col("_b"), 1.0).otherwise(0.0)).alias("_churn"))
    return a.select(*by).distinct().join(out, list(by), "left").select(*by, F.coalesce("_churn", F.lit(0.0)).alias("churn"))
