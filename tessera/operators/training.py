"""Fits that leave a family out, scores of its rows under them, routes over measured curves, and tables that a fit becomes.

Least squares needs moment sums alone: those without a family are the total less the family's own, so one pass over the
rows gives every family's fit. Quantile fits are reweighted least squares: each round is one aggregate over the rows, for
all quantiles and all held-out parts at once. No family is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.curves import log_loss
from tessera.operators.labels import bytes_ratio, fold_at_target
from tessera.operators.models import logistic, predict
from tessera.operators.stats import ceil_index, order_statistics
from tessera.sources.shared import stored

# Ends of ln scale, score band that counts as met, margin that a correction aims above the target, work of a fallback.
LN_SCALE = (0.0, 16.0)
MET_BAND, AIM_MARGIN, FALLBACK_WORK = 1.0, 0.25, 4
#: Width of the interval from which a row is not predicted, and how far outside the seen range a feature may lie.
WIDE, OUTSIDE = 0.405465, 0.25
#: Held-out parts whose quantile fits are made side by side; use folds of families beyond.
MOST_PARTS = 64


def _columns(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f).cast("double") for f in features]]


def _names(n: int) -> tuple[list[str], list[str]]:
    return [f"m{i}_{j}" for i in range(n) for j in range(i, n)], [f"v{i}" for i in range(n)]


def _moments(cols: Sequence[Column], y: Column, weight: Column) -> list[Column]:
    n = len(cols)
    square, line = _names(n)
    out = [F.sum(weight * cols[i] * cols[j]) for i in range(n) for j in range(i, n)]
    return [c.alias(name) for c, name in zip([*out, *[F.sum(weight * c * y) for c in cols]], [*square, *line], strict=True)]


def _solved(row: Mapping[str, float], n: int, penalty: float) -> list[float]:
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float) + np.diag([0.0, *[penalty] * (n - 1)])
    return np.linalg.lstsq(m, np.array([row[f"v{i}"] for i in range(n)], float), rcond=None)[0].tolist()


def held_out_ridge(df: DataFrame, held: str, features: Sequence[str], y: str, weight: str | None = None, penalty: float = 1e-3) -> DataFrame:
    """held, n, w: for each value of held, a ridge fit of all rows that have another, and how many those are.

    w is [constant, coefficients]; the constant is not penalised. Rows whose y or a feature is null take no part; a null of
    held is a value of its own. The only value there is has n 0 and w null. The rows are read once and summed by held; a
    task solves one small system for each value.
    """
    cols = _columns(features)
    n = len(cols)
    names = [x for part in _names(n) for x in part]
    whole = df.where(F.col(y).isNotNull() & ~F.greatest(F.lit(False), *[F.col(f).isNull() for f in features]))
    sums = stored(whole.groupBy(held).agg(F.count("*").alias("n"), *_moments(cols, F.col(y).cast("double"), F.lit(1.0) if weight is None else F.col(weight))), "moments")
    total = sums.agg(*[F.sum(c).alias(c) for c in ("n", *names)]).first()
    rest = sums.select(held, *[(F.lit(total[c]) - F.col(c)).alias(c) for c in ("n", *names)])

    def solve(parts):
        for pdf in parts:
            out = [_solved(r, n, penalty) if r["n"] else None for r in pdf.to_dict("records")]
            yield pd.DataFrame({held: pdf[held], "n": pdf["n"], "w": out})

    return rest.mapInPandas(solve, f"`{held}` {dict(df.dtypes)[held]}, n bigint, w array<double>")


def quantile_fits(df: DataFrame, features: Sequence[str], y: str, quantiles: Mapping[str, float], held: str | None = None, weight: str | None = None, penalty: float = 1e-3, rounds: int = 40, least: float = 1e-3) -> DataFrame:
    """held, quantile, w: quantile regressions, by reweighted least squares from the plain fit on.

    With held, there is one fit of each quantile for each value of it, of the rows that have another (one value alone has no
    fit); there may be at most MOST_PARTS values, so fold families to fewer. Without, one fit of all rows. A round weighs a
    row by tau above the fit and 1 - tau below it, over its distance from the fit (at least least), and is one aggregate over the rows.
    Rows whose y or a feature is null take no part.
    """
    cols = _columns(features)
    n = len(cols)
    spark = df.sparkSession
    rows = df.where(F.col(y).isNotNull() & ~F.greatest(F.lit(False), *[F.col(f).isNull() for f in features]))
    rows = stored(rows.select((F.lit(0) if held is None else F.col(held)).alias("_held"), *[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias("_y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w")), "rows")
    parts = [r[0] for r in rows.select("_held").distinct().limit(MOST_PARTS + 1).collect()] if held else [None]
    if len(parts) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} held-out parts: fold them")
    kind = dict(rows.dtypes)["_held"]
    fits = {(k, name): None for k in range(len(parts)) for name in quantiles}
    for turn in range(rounds + 1):
        table = spark.createDataFrame([(k, parts[k], name, float(quantiles[name]), w) for (k, name), w in fits.items()], f"part int, out {kind}, quantile string, tau double, w array<double>")
        # At most MOST_PARTS times the quantiles.
        seen = rows.join(F.broadcast(table), ~F.col("_held").eqNullSafe(F.col("out")) if held else F.lit(True))
        r = F.col("_y") - predict(F.col("w"), [F.col(f) for f in features])
        own = F.col("_w") if not turn else F.col("_w") * F.when(r > 0, F.col("tau")).otherwise(1 - F.col("tau")) / F.greatest(F.abs(r), F.lit(least))
        sums = seen.groupBy("part", "quantile").agg(*_moments(cols, F.col("_y"), own)).collect()
        new = {(s["part"], s["quantile"]): _solved(s.asDict(), n, penalty) for s in sums}
        if all(w is not None and new.get(k) is not None and np.allclose(w, new[k], rtol=0, atol=1e-13) for k, w in fits.items() if k in new) and turn:
            break
        fits = {k: new.get(k) for k in fits if k in new}
        if not fits:
            break
    out = [(parts[k], name, w) for (k, name), w in sorted(fits.items(), key=lambda e: e[0])]
    found = spark.createDataFrame(out, f"held {kind}, quantile string, w array<double>")
    return found.withColumnRenamed("held", held) if held else found.drop("held")


def clamped(ln_scale: Column) -> Column:
    return F.greatest(F.least(ln_scale, F.lit(LN_SCALE[1])), F.lit(LN_SCALE[0]))


def held_out_scores(df: DataFrame, held: str, fits: DataFrame, beta: DataFrame, features: Sequence[str], quantiles: Sequence[str] = ("lower", "median", "candidate", "upper")) -> DataFrame:
    """df with ln_<quantile> (clamped), ln_beta (null without a fit) and outside: whether a feature lies outside the range that other
    parts' rows have, by more than OUTSIDE of its width.

    fits and beta are those of `quantile_fits` and `held_out_ridge` with the same held. The range without a part is that of
    the other parts' ends, found from the two lowest and highest of them. Rows of the only part get nulls.
    """
    wide = fits.groupBy(held).pivot("quantile", list(quantiles)).agg(F.first("w"))
    wide = wide.select(F.col(held).alias("_of"), *[F.col(q).alias(f"_w_{q}") for q in quantiles])
    ends = stored(df.groupBy(held).agg(*[a(f).alias(f"{n}_{k}") for k, f in enumerate(features) for n, a in (("lo", F.min), ("hi", F.max))]), "ends")
    # Of two lowest and two highest ends, one is not the part's own.
    two = ends.agg(*[c for k in range(len(features)) for c in (F.slice(F.array_sort(F.collect_list(f"lo_{k}")), 1, 2).alias(f"lo_{k}"), F.slice(F.reverse(F.array_sort(F.collect_list(f"hi_{k}"))), 1, 2).alias(f"hi_{k}"))]).first() if ends.count() <= MOST_PARTS else None
    if two is None:
        raise ValueError(f"more than {MOST_PARTS} held-out parts: fold them")
    other = lambda name: F.when(F.col(name) == F.lit(two[name][0] if two[name] else None), F.lit(two[name][1] if len(two[name]) > 1 else None)).otherwise(F.lit(two[name][0] if two[name] else None)).cast("double")
    ranges = ends.select(F.col(held).alias("_held"), *[other(f"{n}_{k}").alias(f"_{n}_{k}") for k in range(len(features)) for n in ("lo", "hi")])
    models = ranges.join(wide, ranges["_held"].eqNullSafe(wide["_of"]), "left").drop("_of")
    own = beta.select(F.col(held).alias("_b_held"), F.col("w").alias("_w_beta"))
    models = models.join(own, models["_held"].eqNullSafe(own["_b_held"]), "left").drop("_b_held")
    # A row for each part, of which there are at most MOST_PARTS.
    both = df.join(F.broadcast(models), df[held].eqNullSafe(models["_held"]), "left")
    f = [F.col(x).cast("double") for x in features]
    far = [(c < F.col(f"_lo_{k}") - OUTSIDE * F.greatest(F.col(f"_hi_{k}") - F.col(f"_lo_{k}"), F.lit(1e-6))) | (c > F.col(f"_hi_{k}") + OUTSIDE * F.greatest(F.col(f"_hi_{k}") - F.col(f"_lo_{k}"), F.lit(1e-6))) for k, c in enumerate(f)]
    outside = far[0]
    for c in far[1:]:
        outside = outside | c
    return both.select(*[df[c] for c in df.columns], *[clamped(predict(F.col(f"_w_{q}"), f)).alias(f"ln_{q}") for q in quantiles], predict(F.col("_w_beta"), f).alias("ln_beta"), outside.alias("outside"))


def score_on(points: Column, scale: Column) -> Column:
    """Score of a measured curve, an array of (scale, score) by rising scale, at a scale: on lines of ln loss over ln scale, constant beyond its ends."""
    n = F.size(points)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    at = F.greatest(F.size(F.filter(points, lambda p: p["scale"] < scale)), F.lit(1))
    a, b = F.element_at(points, at), F.try_element_at(points, at + 1)
    t = (F.ln(scale) - F.ln(a["scale"])) / F.nullif(F.ln(b["scale"]) - F.ln(a["scale"]), F.lit(0.0))
    line = 100.0 - F.exp(log_loss(a["score"]) + t * (log_loss(b["score"]) - log_loss(a["score"])))
    return F.when(n > 0, F.when(scale <= first["scale"], first["score"]).when(scale >= last["scale"], last["score"]).otherwise(F.coalesce(line, b["score"])))


def routes(rows: DataFrame) -> DataFrame:
    """rows with error, success, fallback, observed, route, work, ok and ratio: what a predicted plan would have come to.

    rows: target, crossing, ln_lower, ln_median, ln_candidate, ln_upper, ln_beta, outside, neighbours and label_bytes (of
    `labels`), curve (array of scale and score; null: only error, success, fallback and the first plan's ratio). A wide interval
    or an outlying feature falls back at once. A first plan that meets the target stands, if it overshoots by no more than
    MET_BAND; else one step along beta is tried, and kept if it still meets it. One that misses is corrected by a step, and
    falls back if that misses too. ratio: bytes against the label's, 1 for a fallback, null without prices.
    """
    candidate = F.exp("ln_candidate")
    success = candidate >= F.col("crossing")
    fallback = F.coalesce(F.col("outside"), F.lit(False)) | (F.col("ln_upper") - F.col("ln_lower") > WIDE)
    beta = F.when(F.col("ln_beta").isNotNull(), F.least(F.greatest(F.exp("ln_beta"), F.lit(0.2)), F.lit(3.0))).otherwise(0.9)
    out = rows.withColumns({"error": F.col("ln_median") - F.ln("crossing"), "success": success, "fallback": fallback, "observed": score_on(F.col("curve"), candidate)})
    out = out.withColumn("_to", F.exp(clamped(F.col("ln_candidate") + (log_loss(F.col("observed")) - log_loss(F.col("target") + AIM_MARGIN)) / beta)))
    held = F.col("_to") >= F.col("crossing")
    over = F.col("observed") - F.col("target") > MET_BAND
    met = F.when(~over, "one_shot").when(held, "tightened").otherwise("tighten_kept_first")
    route = F.when(F.col("curve").isNull(), None).when(F.col("fallback"), "fallback_preflight").when(F.col("success"), met).when(held, "corrected").otherwise("fallback_exact")
    out = out.withColumn("route", route)
    work = F.when(F.col("route") == "fallback_preflight", FALLBACK_WORK).when(F.col("route") == "one_shot", 1).when(F.col("route") == "fallback_exact", 2 + FALLBACK_WORK).when(F.col("route").isNotNull(), 2)
    end = F.when(F.col("route").isin("tightened", "corrected"), F.col("_to")).otherwise(candidate)
    falls = F.col("route").isin("fallback_preflight", "fallback_exact")
    ratio = F.when(falls, 1.0).otherwise(bytes_ratio(F.col("neighbours"), F.col("label_bytes"), end))
    return out.withColumns({"work": work, "ok": F.col("route") != "fallback_exact", "ratio": F.when(F.col("route").isNotNull(), ratio).when(F.col("success"), ratio)}).drop("_to")


def route_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, rows, median_abs, p90_abs, p99_abs, first_plan, first_or_corrected, fallback_rate, byte_geomean, expected_work.

    The quantiles of the absolute error are those at int(q (n - 1) + 0.9999). An empty table gives no rows.
    """
    rows = scored.withColumn("_e", F.abs("error")).where("_e is not null")
    ends = order_statistics(rows, by, "_e", {"median_abs": ceil_index(0.5), "p90_abs": ceil_index(0.9), "p99_abs": ceil_index(0.99)})
    share = lambda c: F.avg(F.col(c).cast("double"))
    rest = rows.groupBy(*by).agg(
        F.count("*").alias("rows"), share("success").alias("first_plan"), share("ok").alias("first_or_corrected"), share("fallback").alias("fallback_rate"),
        F.exp(F.avg(F.ln("ratio"))).alias("byte_geomean"), F.avg("work").alias("expected_work"),
    )
    if not by:
        return rest.where("rows > 0").crossJoin(F.broadcast(ends))
    named = ends.withColumnsRenamed({b: f"_k_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & rest[b].eqNullSafe(named[f"_k_{b}"])
    return rest.join(named, on).drop(*[f"_k_{b}" for b in by])


def route_fractions(scored: DataFrame) -> DataFrame:
    """route, n, fraction of all routed rows."""
    counts = scored.where("route is not null").groupBy("route").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.withColumn("fraction", F.col("n") / F.lit(total))


def train_table(df: DataFrame, vector: Sequence[str], interacting: Sequence[int], knots: Sequence[float], family: str, quantiles: Mapping[str, float], penalty: float = 1e-3, rounds: int = 40, center: float = 3.0) -> DataFrame:
    """target, rows, censored, models and saturation: a pooled fit as an affine model of the vector at each knot.

    df has target, state, crossing, beta, the family and the vector's columns, standardised. The pooled fit is over all rows
    that are not censored, each family with a total weight of 1, on the vector, the centred ln loss of the target and its
    products with the interacting entries. models maps each quantile, and beta (a plain ridge fit, from 8 rows on), to
    [constant, coefficients]. saturation is a logistic fit of being censored at the knot. Knots without rows are left out.
    """
    x = log_loss(F.col("target")) - center
    names = [*vector, "_x", *[f"_x{i}" for i in interacting]]
    rows = df.withColumns({"_x": x, **{f"_x{i}": x * F.col(vector[i]) for i in interacting}})
    # Each family's rows are counted apart and joined back, so that a large family is no task's window.
    sizes = lambda t, on: t.join(t.groupBy(*on).agg((1.0 / F.count("*")).alias("_weight")), list(on))
    open_ = stored(sizes(rows.where("state <> 'censored'").withColumn("_y", F.ln("crossing")), [family]), "train-rows")
    w = {r["quantile"]: list(r["w"]) for r in quantile_fits(open_, names, "_y", quantiles, None, "_weight", penalty, rounds).collect()}
    slopes = open_.where("beta > 0").withColumns({"_lb": F.ln("beta"), "_one": F.lit(1)})
    if slopes.limit(8).count() == 8:
        m = slopes.agg(*_moments(_columns(names), F.col("_lb"), F.lit(1.0))).first().asDict()
        w["beta"] = _solved(m, len(names) + 1, penalty)
    counts = df.where(F.col("target").isin([float(t) for t in knots])).groupBy("target").agg(F.count_if(F.col("state") != "censored").alias("rows"), F.count_if(F.col("state") == "censored").alias("censored"))
    folded = [(float(t), {k: fold_at_target(v, t, len(vector), list(interacting), center) for k, v in w.items()}) for t in knots]
    models = df.sparkSession.createDataFrame(folded, "target double, models map<string, array<double>>")
    flagged = sizes(rows.withColumn("_censored", (F.col("state") == "censored").cast("double")), [family, "target"])
    saturation = logistic(flagged, ["target"], list(vector), "_censored", "_weight").select("target", F.col("w").alias("saturation"))
    return counts.join(F.broadcast(models), "target").join(saturation, "target", "left")
