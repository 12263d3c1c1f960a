"""Measured curves: rows of (key, x, score), one curve a key, ordered by x.

Brackets are made by one window a curve; looking values up in them is an equi-join on the curve with a range condition,
so the work of a curve never meets another's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_max(df: DataFrame, by: Sequence[str], x: Sequence[str], score: str, name: str) -> DataFrame:
    """The curve made monotone from its start."""
    return df.withColumn(name, F.max(score).over(Window.partitionBy(*by).orderBy(*x).rowsBetween(Window.unboundedPreceding, 0)))


def crossing_state(df: DataFrame, by: Sequence[str], x: Sequence[str], score: str, target: float) -> DataFrame:
    """First point of each curve at or above target, and the point before it.

    state is 'floor' if the first point of all is, 'censored' if none is, else 'crossed'.
    """
    w = Window.partitionBy(*by).orderBy(*x)
    rows = df.withColumn("_r", F.row_number().over(w)).withColumn("_px", F.lag(x[0]).over(w)).withColumn("_ps", F.lag(score).over(w))
    hit = F.min(F.when(F.col(score) >= target, F.struct(F.col("_r").alias("r"), F.col(x[0]).alias("x"), F.col(score).alias("s"), F.col("_px").alias("px"), F.col("_ps").alias("ps"))))
    out = rows.groupBy(*by).agg(hit.alias("h"), F.count("*").alias("points"))
    state = F.when(F.col("h").isNull(), "censored").when(F.col("h.r") == 1, "floor").otherwise("crossed")
    return out.select(*by, "points", state.alias("state"), F.col("h.x").alias("x"), F.col("h.s").alias("score"), F.col("h.px").alias("below_x"), F.col("h.ps").alias("below_score"))


def log_loss_crossing(below_x: Column, below: Column, above_x: Column, above: Column, target: float | Column, least: float = 1e-3) -> Column:
    """x at which the straight line of ln loss over ln x meets the target's loss, kept between both points.

    The loss is max(100 - score, 1e-3); where it does not fall from the first to the second point, the middle in ln x.
    """
    loss = lambda s: F.ln(F.greatest(F.lit(100.0) - s, F.lit(least)))
    a, b, t = loss(below), loss(above), loss(target if isinstance(target, Column) else F.lit(float(target)))
    lx, hx = F.ln(below_x), F.ln(above_x)
    at = F.when((b >= a) | (hx <= lx), (lx + hx) / 2).otherwise(F.greatest(F.least(lx + (hx - lx) * (t - a) / F.when(b != a, b - a), hx), lx))
    return F.exp(at)


def inner_crossing(low_rung: Column, low_x: Column, low: Column, high_rung: Column, high_x: Column, high: Column, aim: Column, rung_of) -> Column:
    """Rung at which the line of ln loss over ln x meets the aim, strictly between two rungs; null if they are neighbours
    or the loss does not fall. rung_of gives the rung of an x."""
    y0, y1, t = (F.ln(F.greatest(F.lit(100.0) - s, F.lit(1e-3))) for s in (low, high, aim))
    x0, x1 = F.ln(low_x), F.ln(high_x)
    ordered = (y1 < y0) & (x1 > x0) & (high_rung > low_rung + 1)
    x = F.exp(x0 + (t - y0) * (x1 - x0) / F.when(y1 != y0, y1 - y0))
    return F.when(ordered, F.least(F.greatest(rung_of(x), low_rung + 1), high_rung - 1))


def brackets(df: DataFrame, by: Sequence[str], x: str, y: Sequence[str]) -> DataFrame:
    """Adjacent points of each curve: x0, x1 and y0, y1 of each column."""
    w = Window.partitionBy(*by).orderBy(x, *y)
    cols = [F.col(x).alias("x0"), F.lead(x).over(w).alias("x1")]
    for c in y:
        cols += [F.col(c).alias(f"{c}0"), F.lead(c).over(w).alias(f"{c}1")]
    return df.select(*by, *cols, F.row_number().over(w).alias("bracket")).where("x1 is not null")


def interpolate(targets: DataFrame, points: DataFrame, by: Sequence[str], target: str, x: str, y: str) -> DataFrame:
    """targets with the linear value of the first bracket that holds them; null outside the curve."""
    b = brackets(points, by, x, [y])
    met = targets.join(b, list(by), "left").where(F.col(target).between(F.col("x0"), F.col("x1")))
    first = met.groupBy(*targets.columns).agg(F.min_by(F.struct("x0", "x1", f"{y}0", f"{y}1"), "bracket").alias("b"))
    share = F.when(F.col("b.x1") == F.col("b.x0"), F.lit(0.0)).otherwise((F.col(target) - F.col("b.x0")) / F.when(F.col("b.x1") != F.col("b.x0"), F.col("b.x1") - F.col("b.x0")))
    value = first.select(*targets.columns, (F.col(f"b.{y}0") + share * (F.col(f"b.{y}1") - F.col(f"b.{y}0"))).alias(f"{y}_at"))
    return targets.join(value, list(targets.columns), "left")


def match_metric(targets: DataFrame, curve: DataFrame, by: Sequence[str], target: str, x: str, metric: str, log_rate: bool = False) -> DataFrame:
    """For each target the setting at which the curve has that metric.

    Of the adjacent points that enclose the target the narrowest in the metric counts, an exact point before all; the
    setting is interpolated in x, or in ln x with log_rate. status is 'exact', 'interpolated' or 'outside'.
    """
    b = brackets(curve, by, x, [metric])
    lo, hi = F.least(f"{metric}0", f"{metric}1"), F.greatest(f"{metric}0", f"{metric}1")
    met = targets.join(b, list(by)).where(F.col(target).between(lo, hi))
    best = met.groupBy(*targets.columns).agg(F.min(F.struct((hi - lo).alias("span"), "x0", "x1", f"{metric}0", f"{metric}1")).alias("b"))
    exact = targets.join(curve, list(by)).where(F.col(target) == F.col(metric)).groupBy(*targets.columns).agg(F.min(x).alias("_exact"))
    share = (F.col(target) - F.col(f"b.{metric}0")) / F.when(F.col(f"b.{metric}1") != F.col(f"b.{metric}0"), F.col(f"b.{metric}1") - F.col(f"b.{metric}0"))
    f, g = (F.ln, F.exp) if log_rate else (lambda c: c, lambda c: c)
    value = g(f(F.col("b.x0")) + F.coalesce(share, F.lit(0.0)) * (f(F.col("b.x1")) - f(F.col("b.x0"))))
    out = targets.join(best, list(targets.columns), "left").join(exact, list(targets.columns), "left")
    status = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("b").isNotNull(), "interpolated").otherwise("outside")
    return out.select(*targets.columns, F.coalesce(F.col("_exact").cast("double"), value).alias("setting"), status.alias("status"))


def as_of(targets: DataFrame, curve: DataFrame, by: Sequence[str], target: str, x: str, y: str) -> DataFrame:
    """Clamped piecewise-linear lookup in (ln x, y): the end points' values outside the curve, null without a curve."""
    b = brackets(curve, by, x, [y]).withColumnRenamed("bracket", "_b")
    ends = curve.groupBy(*by).agg(F.min(F.struct(x, y)).alias("lo"), F.max(F.struct(x, y)).alias("hi"))
    inside = targets.join(b, list(by)).where((F.col(target) >= F.col("x0")) & (F.col(target) < F.col("x1")))
    share = (F.ln(target) - F.ln("x0")) / (F.ln("x1") - F.ln("x0"))
    inside = inside.groupBy(*targets.columns).agg(F.max_by(F.col(f"{y}0") + share * (F.col(f"{y}1") - F.col(f"{y}0")), "_b").alias("_y"))
    out = targets.join(ends, list(by), "left").join(inside, list(targets.columns), "left")
    value = F.when(F.col(target) <= F.col(f"lo.{x}"), F.col(f"lo.{y}")).when(F.col(target) >= F.col(f"hi.{x}"), F.col(f"hi.{y}")).otherwise(F.col("_y"))
    return out.select(*targets.columns, value.alias(f"{y}_at"))


def log_loss(score: Column, least: float = 1e-3) -> Column:
    """Natural log of what a score lacks to 100, at least least."""
    return F.ln(F.greatest(F.lit(100.0) - score, F.lit(least)))


def score_at(targets: DataFrame, curve: DataFrame, by: Sequence[str], target: str, x: str, score: str) -> DataFrame:
    """targets with score_at: the curve's score at x on lines of ln loss over ln x, the end points' beyond them."""
    lossy = curve.select(*by, x, log_loss(F.col(score)).alias("_l"))
    out = as_of(targets, lossy, by, target, x, "_l")
    return out.withColumn("score_at", 100 - F.exp("_l_at")).drop("_l_at")


def segment_slopes(df: DataFrame, by: Sequence[str], x: str, score: str) -> DataFrame:
    """Differences of ln x over differences of ln loss of adjacent points of the curve's running maximum, where the loss differs."""
    w = Window.partitionBy(*by).orderBy(x)
    rows = running_max(df, by, [x], score, "_top").withColumn("_l", log_loss(F.col("_top")))
    rows = rows.withColumn("_dx", F.ln(x) - F.ln(F.lag(x).over(w))).withColumn("_dy", F.col("_l") - F.lag("_l").over(w)).withColumn("segment", F.row_number().over(w) - 1)
    return rows.where("_dy is not null and _dy <> 0").select(*by, "segment", (F.col("_dx") / F.col("_dy")).alias("slope"))


def loss_exponent(df: DataFrame, by: Sequence[str], x: str, score: str) -> DataFrame:
    """Least-squares slope of ln loss over ln x of the curve's running maximum; null with fewer than two points."""
    rows = running_max(df, by, [x], score, "_top")
    return rows.groupBy(*by).agg(F.regr_slope(log_loss(F.col("_top")), F.ln(x)).alias("exponent"))


def local_slope(df: DataFrame, by: Sequence[str], x: str, score: str, at: str, k: int = 4) -> DataFrame:
    """How fast ln loss falls over ln x: the negative least-squares slope of the k points nearest to at in ln x, ties to the
    smaller x; null if it is not positive or there are fewer than two places."""
    w = Window.partitionBy(*by).orderBy(F.abs(F.ln(x) - F.ln(at)), x)
    near = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    out = near.groupBy(*by).agg((-F.regr_slope(log_loss(F.col(score)), F.ln(x))).alias("_s"))
    return out.select(*by, F.when(F.col("_s") > 0, F.col("_s")).alias("beta"))


def crossing_scale(df: DataFrame, by: Sequence[str], x: str, score: str, target: float, low: int = 1, high: int = 73_728) -> DataFrame:
    """by, crossing, saturated: where the curve's running maximum meets target on straight lines of ln loss over ln x.

    Beyond the first and last point the line of the nearest segment goes on; a single point stands for itself. The result
    is rounded half to even within low .. high. saturated: even the last point misses the target.
    """
    w = Window.partitionBy(*by).orderBy(x)
    rows = running_max(df, by, [x], score, "_top").select(*by, F.ln(x).alias("x0"), log_loss(F.col("_top")).alias("y0"), "_top", F.row_number().over(w).alias("_k"), F.lead(F.ln(x)).over(w).alias("x1"))
    rows = rows.withColumn("y1", F.lead("y0").over(Window.partitionBy(*by).orderBy("_k")))
    t = math.log(max(100.0 - target, 1e-9))
    line = F.when(F.col("y1") == F.col("y0"), F.when(F.lit(t) <= F.col("y0"), F.col("x1")).otherwise(F.col("x0"))).otherwise(F.col("x0") + (F.lit(t) - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.when(F.col("y1") != F.col("y0"), F.col("y1") - F.col("y0")))
    segment = F.col("x1").isNotNull()
    holds = segment & (F.col("y0") >= t) & (F.lit(t) >= F.col("y1"))
    one = F.struct(F.col("_k"), F.col("y0"), line.alias("at"))
    found = rows.groupBy(*by).agg(
        F.min(F.when(segment, one)).alias("first"), F.max(F.when(segment, one)).alias("last"), F.min(F.when(holds, one)).alias("in"),
        F.max(F.struct("_k", "y0", "x0", "_top")).alias("end"),
    )
    at = F.when(F.col("first").isNull(), F.col("end.x0")).when(F.lit(t) >= F.col("first.y0"), F.col("first.at")).when(F.lit(t) <= F.col("end.y0"), F.col("last.at")).otherwise(F.coalesce("in.at", "end.x0"))
    scale = F.bround(F.least(F.greatest(F.exp(at), F.lit(float(low))), F.lit(float(high)))).cast("bigint")
    return found.select(*by, scale.alias("crossing"), (F.col("end._top") < target).alias("saturated"))


def monotone(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str) -> DataFrame:
    """Whether each curve never falls, and never rises."""
    w = Window.partitionBy(*by).orderBy(*x)
    rows = df.withColumn("_p", F.lag(y).over(w))
    return rows.groupBy(*by).agg(F.coalesce(F.bool_and(F.when(F.col("_p").isNotNull(), F.col(y) >= F.col("_p"))), F.lit(True)).alias("rising"), F.coalesce(F.bool_and(F.when(F.col("_p").isNotNull(), F.col(y) <= F.col("_p"))), F.lit(True)).alias("falling"))


def non_monotone_pairs(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, pairs: pairs of any distance within a curve in which the higher x has the smaller y.

    Points are numbered by y. Two numbers differ first in one of their bits, which tells which is larger: for each bit the
    points that agree above it are put in order of x, and each with the bit unset counts those before it that have it set.
    That is one row for each point and bit and one window, not a row for each pair. Null values are no points.
    """
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = kept.select(*by, F.col(x).alias("_x"), (F.rank().over(Window.partitionBy(*by).orderBy(y)) - 1).cast("bigint").alias("_k"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    bits = ranked.select(*by, "_x", "_k", F.explode(F.sequence(F.lit(0), F.length(F.bin("_n")) - 1)).alias("_b"))
    above = F.call_function("shiftright", F.col("_k"), F.col("_b") + 1)
    one = F.call_function("shiftright", F.col("_k"), F.col("_b")).bitwiseAND(F.lit(1).cast("bigint"))
    rows = bits.select(*by, "_b", above.alias("_a"), "_x", one.alias("_one"))
    w = Window.partitionBy(*by, "_b", "_a")
    before = F.sum("_one").over(w.orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("_one").over(Window.partitionBy(*by, "_b", "_a", "_x"))
    count = F.coalesce(F.sum(F.when(F.col("_one") == 0, F.col("_before"))), F.lit(0)).cast("bigint")
    return rows.withColumn("_before", before).groupBy(*by).agg(count.alias("pairs"))


def refinements(curve: DataFrame, targets: DataFrame, by: Sequence[str], target: str, x: str, metric: str, tolerance: float) -> DataFrame:
    """Middle settings of brackets that enclose a target and are wider than tolerance in the metric, widest first."""
    b = brackets(curve, by, x, [metric])
    lo, hi = F.least(f"{metric}0", f"{metric}1"), F.greatest(f"{metric}0", f"{metric}1")
    met = targets.join(b, list(by)).where(F.col(target).between(lo, hi)).where((hi - lo) > tolerance)
    return met.select(*by, ((F.col("x0") + F.col("x1")) / 2).alias("setting"), (hi - lo).alias("width")).distinct().orderBy(F.desc("width"), *by, "setting")


def bd_rate(df: DataFrame, by: Sequence[str], arm: str, reference: str, test: str, rate: str, quality: str, order: Sequence[str] = ()) -> DataFrame:
    """Mean rate difference in percent at equal quality of two arms: the gap of two cubic fits of log10 rate over quality,
    integrated over the common range; null with fewer than four qualities in an arm or no common range.

    Rates that are not positive are no points. Of points of one quality the last in order counts (of equals, and without
    an order, the one with the largest rate). Fits are sums of powers of the quality, moved and scaled to -1 .. 1 over the
    group: aggregates of groups of any size; Python solves four equations for each arm.
    """
    points = df.where((F.col(rate) > 0) & F.col(quality).isNotNull() & F.col(arm).isin(reference, test))
    last = F.max_by(F.col(rate), F.struct(*order, rate))
    points = points.groupBy(*by, F.col(arm).alias("_arm"), F.col(quality).cast("double").alias("_q")).agg(F.log10(last).alias("_y"))
    ends = points.groupBy(*by, "_arm").agg(F.min("_q").alias("_lo"), F.max("_q").alias("_hi"), F.count("*").alias("_n")).groupBy(*by).agg(F.max("_lo").alias("lo"), F.min("_hi").alias("hi"), F.min("_lo").alias("_a"), F.max("_hi").alias("_b"), F.min("_n").alias("n"), F.count("*").alias("arms"))
    named = points.withColumnsRenamed({b: f"_k_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & ends[b].eqNullSafe(named[f"_k_{b}"])
    z = (F.col("_q") - (F.col("_a") + F.col("_b")) / 2) / F.greatest((F.col("_b") - F.col("_a")) / 2, F.lit(1e-300))
    rows = ends.join(named, on).withColumn("_z", z)
    power = lambda k: F.lit(1.0) if not k else F.pow(F.col("_z"), F.lit(float(k)))
    side = lambda name: F.col("_arm") == name
    sums = []
    for s, name in (("r", reference), ("t", test)):
        sums += [F.sum(F.when(side(name), power(k))).alias(f"{s}m{k}") for k in range(7)] + [F.sum(F.when(side(name), power(k) * F.col("_y"))).alias(f"{s}v{k}") for k in range(4)]
    moments = rows.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("lo", "hi", "_a", "_b", "n", "arms")], *sums)

    def gap(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list[float | None] = []
            for r in pdf.to_dict("records"):
                if r["arms"] < 2 or r["n"] < 4 or not r["hi"] > r["lo"]:
                    out.append(None)
                    continue
                middle, half = (r["_a"] + r["_b"]) / 2, (r["_b"] - r["_a"]) / 2
                ends = [(r[c] - middle) / half for c in ("lo", "hi")]
                area = []
                for s in "rt":
                    m = np.array([[r[f"{s}m{i + j}"] for j in range(4)] for i in range(4)], float)
                    c = np.linalg.solve(m, np.array([r[f"{s}v{k}"] for k in range(4)], float))
                    whole = np.polynomial.Polynomial(c).integ()
                    area.append((whole(ends[1]) - whole(ends[0])) / (ends[1] - ends[0]))
                out.append(float((10 ** (area[1] - area[0]) - 1) * 100))
            yield pdf[list(by)].assign(bd_rate=pd.Series(out, dtype="Float64", index=pdf.index))

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.select(*by).dtypes], "bd_rate double"])
    return moments.mapInPandas(gap, schema)
