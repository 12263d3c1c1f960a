"""Comparison reports of coders measured on images: matches at equal size or score, summaries by image and corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.stats import _recall_at, best_weights, geometric_mean, order_statistics, rank_index, summary, weight_search
from tessera.operators.order import row_numbers


def mix(low: Column, high: Column, fraction: Column) -> Column:
    """A value between two, null if either is."""
    return low + fraction * (high - low)


def equal_size(own: DataFrame, rival: DataFrame, by: Sequence[str], key: Sequence[str], size: str, metrics: Sequence[str]) -> DataFrame:
    """by, key, fraction, size0, size1 and the rival's metrics at the size of each own record: of the rival's records in
    order of size, the first two that enclose it; null where none do."""
    w = Window.partitionBy(*by).orderBy(size)
    ends = [F.col(size).alias("size0"), F.lead(size).over(w).alias("size1")]
    for m in metrics:
        ends += [F.col(m).alias(f"_{m}0"), F.lead(m).over(w).alias(f"_{m}1")]
    brackets = rival.select(*by, *ends, F.row_number().over(w).alias("_k")).where("size1 > size0")
    met = own.select(*by, *key, F.col(size).alias("_t")).join(brackets, list(by)).where("_t between size0 and size1")
    first = met.groupBy(*by, *key).agg(F.min_by(F.struct("_t", "size0", "size1", *[f"_{m}{e}" for m in metrics for e in "01"]), "_k").alias("b"))
    fraction = (F.col("b._t") - F.col("b.size0")) / (F.col("b.size1") - F.col("b.size0"))
    values = [mix(F.col(f"b._{m}0"), F.col(f"b._{m}1"), fraction).alias(f"{m}_at") for m in metrics]
    found = first.select(*by, *key, fraction.alias("fraction"), F.col("b.size0").alias("size0"), F.col("b.size1").alias("size1"), *values)
    return own.select(*by, *key).join(found, [*by, *key], "left")


def equal_metric(own: DataFrame, rival: DataFrame, by: Sequence[str], key: Sequence[str], target: str, setting: str, size: str, metric: str, increasing: bool, log_size: bool = False) -> DataFrame:
    """by, key, matched_size, matched_setting, span, kind: the rival's size and setting at the metric of each own record.

    A rival record with that metric counts ('exact', the smallest size of several). Else, of the rival's neighbours in order
    of setting whose metric goes the right way (rising if increasing) and encloses the target, the pair with the smallest
    step of the metric ('interpolated'); sizes lie on its line, in the logarithm with log_size. Null where there is none.
    """
    w = Window.partitionBy(*by).orderBy(setting)
    cols = {"v": metric, "s": setting, "b": size}
    pairs = rival.select(*by, *[x for n, c in cols.items() for x in (F.col(c).cast("double").alias(f"{n}0"), F.lead(F.col(c).cast("double")).over(w).alias(f"{n}1"))])
    pairs = pairs.where(F.col("v0") < F.col("v1") if increasing else F.col("v0") > F.col("v1"))
    pairs = pairs.where("b0 > 0 and b1 > 0") if log_size else pairs
    wanted = own.where(F.col(target).isNotNull()).select(*by, *key, F.col(target).cast("double").alias("_t"))
    met = wanted.join(pairs, list(by)).where(F.col("_t").between(F.least("v0", "v1"), F.greatest("v0", "v1")))
    best = met.groupBy(*by, *key).agg(F.min(F.struct(F.abs(F.col("v1") - F.col("v0")).alias("span"), "s0", "s1", "v0", "v1", "b0", "b1", "_t")).alias("m"))
    exact = wanted.join(rival.select(*by, F.col(metric).cast("double").alias("_v"), F.col(setting).cast("double").alias("_s"), F.col(size).cast("double").alias("_b")), list(by)).where(F.abs(F.col("_v") - F.col("_t")) <= 1e-12)
    exact = exact.groupBy(*by, *key).agg(F.min(F.struct("_b", "_s")).alias("x"))
    f = (F.col("m._t") - F.col("m.v0")) / (F.col("m.v1") - F.col("m.v0"))
    line = F.exp(mix(F.ln("m.b0"), F.ln("m.b1"), f)) if log_size else mix(F.col("m.b0"), F.col("m.b1"), f)
    out = own.select(*by, *key).join(best, [*by, *key], "left").join(exact, [*by, *key], "left")
    kind = F.when(F.col("x").isNotNull(), "exact").when(F.col("m").isNotNull(), "interpolated")
    return out.select(*by, *key, F.coalesce("x._b", line).alias("matched_size"), F.coalesce("x._s", mix(F.col("m.s0"), F.col("m.s1"), f)).alias("matched_setting"), F.when(F.col("x").isNotNull(), F.lit(0.0)).otherwise(F.col("m.span")).alias("span"), kind.alias("kind"))


def match_status(matched: Column, target: Column, low: Column, high: Column) -> Column:
    return F.when(matched, "matched").when(target.isNull(), "quality_metric_unavailable").when(low.isNull(), "metric_unavailable").when(target < low, "below_range").when(target > high, "above_range").otherwise("unbracketed_non_monotone")


def target_rows(own: DataFrame, rivals: dict[str, tuple[DataFrame, bool]], image: str, key: str, guard: float = 0.0) -> DataFrame:
    """Each own record (image, key, requested, achieved, score, bytes) with overshoot, floor_violation and, for each rival
    (records image, setting, score, bytes, and whether its score rises with the setting), bytes_<name> at equal score,
    ratio_<name> and status_<name>."""
    out = own.withColumn("overshoot", F.col("achieved") - F.col("requested")).withColumn("floor_violation", F.col("achieved") < F.col("requested") - guard)
    for name, (rival, increasing) in rivals.items():
        met = equal_metric(own, rival, [image], [key], "score", "setting", "bytes", "score", increasing, True).select(image, key, F.col("matched_size").alias(f"bytes_{name}"), F.col("kind").isNotNull().alias("_met"))
        ends = rival.groupBy(image).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        out = out.join(met, [image, key], "left").join(ends, image, "left")
        ratio = F.col("bytes") / F.when(F.col(f"bytes_{name}") != 0, F.col(f"bytes_{name}"))
        out = out.withColumn(f"ratio_{name}", ratio).withColumn(f"status_{name}", match_status(F.col("_met"), F.col("score"), F.col("_lo"), F.col("_hi"))).drop("_met", "_lo", "_hi")
    return out


def image_summary(targets: DataFrame, image: str, key: str, rivals: Sequence[str]) -> DataFrame:
    """A row for each image of target_rows(): targets, floor_violations, matched_<rival> and geomean_<rival>, and whether
    achieved score and bytes rise with the requested score."""
    w = Window.partitionBy(image).orderBy("requested", key)
    rows = targets.withColumn("_a", F.lag("achieved").over(w)).withColumn("_b", F.lag("bytes").over(w))
    rises = lambda c, p: F.coalesce(F.bool_and(F.when(F.col(p).isNotNull(), F.col(c) >= F.col(p))), F.lit(True))
    per = []
    for r in rivals:
        per += [F.count_if(F.col(f"status_{r}") == "matched").alias(f"matched_{r}"), geometric_mean(f"ratio_{r}").alias(f"geomean_{r}")]
    return rows.groupBy(image).agg(F.count("*").alias("targets"), F.count_if("floor_violation").alias("floor_violations"), *per, rises("achieved", "_a").alias("achieved_monotone"), rises("bytes", "_b").alias("bytes_monotone"))


def corpus_aggregate(targets: DataFrame, images: DataFrame, rivals: Sequence[str]) -> DataFrame:
    """One row over all target rows and image summaries: counts, median and largest score error, coverage and geometric
    mean ratio for each rival, and whether all images are monotone; `status_counts` has the statuses."""
    errors = targets.select(F.abs("overshoot").alias("_e"))
    middle = order_statistics(errors, [], "_e", {"_l": lambda n: F.floor((n - 1) / 2), "_h": lambda n: F.ceil((n - 1) / 2)})
    per = []
    for r in rivals:
        hit = F.count_if(F.col(f"status_{r}") == "matched")
        per += [(hit / F.nullif(F.count("*"), F.lit(0))).alias(f"coverage_{r}"), geometric_mean(f"ratio_{r}").alias(f"geomean_{r}")]
    whole = targets.agg(F.count("*").alias("target_count"), F.count_if("floor_violation").alias("floor_violation_count"), F.max(F.abs("overshoot")).alias("max_abs_score_error"), *per)
    flags = images.agg(F.coalesce(F.bool_and("achieved_monotone"), F.lit(True)).alias("all_achieved_monotone"), F.coalesce(F.bool_and("bytes_monotone"), F.lit(True)).alias("all_bytes_monotone"))
    # Three tables of one row.
    return whole.crossJoin(middle.select(((F.col("_l") + F.col("_h")) / 2).alias("median_abs_score_error"))).crossJoin(flags)


def status_counts(targets: DataFrame, rivals: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, rival, status, n: how often each status of each rival occurs; null is the text 'null'. No targets, no rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rival"), F.coalesce(F.col(f"status_{r}").cast("string"), F.lit("null")).alias("status")) for r in rivals]))
    return targets.select(*by, pairs.alias("_s")).select(*by, "_s.*").groupBy(*by, "rival", "status").agg(F.count("*").alias("n"))


def timing_summary(runs: DataFrame, by: Sequence[str], setting: Column, valid: Column, wall: str, cpu: str, rss: str) -> DataFrame:
    """by, setting (as JSON or text), valid_runs, the five numbers of wall and cpu times and peak_rss of valid runs."""
    kept = runs.where(valid).select(*by, setting.alias("setting"), wall, cpu, rss)
    keys = [*by, "setting"]
    base = kept.groupBy(*keys).agg(F.count("*").alias("valid_runs"), F.max(rss).alias("peak_rss"))
    out = base
    for name, column in (("wall", wall), ("cpu", cpu)):
        five = summary(kept, keys, column)
        out = out.join(five.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("min", "median", "p95", "p99", "max")]), keys, "left")
    return out


def atom_errors(atoms: DataFrame, pixels: DataFrame, image: str, side: int = 8) -> DataFrame:
    """image, tx, ty, smooth_half, split, p95_abs, mean_error, rms and label of each atom (image, tx, ty, gx, gy).

    pixels: image, x, y, source, decoded. A tile is split in the middle of its extent, across x if gx >= gy, else y; the
    half whose source varies less (the first of equals) is where errors are judged: label is the 95th percentile of their
    sizes by nearest rank, plus the size of their mean, plus half their root mean square.
    """
    at = [F.floor(F.col("x") / side).cast("int").alias("tx"), F.floor(F.col("y") / side).cast("int").alias("ty")]
    rows = pixels.select(image, *at, "x", "y", "source", "decoded").join(atoms.select(image, "tx", "ty", (F.col("gx") >= F.col("gy")).alias("_by_x")), [image, "tx", "ty"])
    place = F.when(F.col("_by_x"), F.col("x")).otherwise(F.col("y"))
    w = Window.partitionBy(image, "tx", "ty")
    middle = F.floor((F.min(place).over(w) + F.max(place).over(w) + 1) / 2)
    rows = rows.withColumn("_half", F.when(place >= middle, 1).otherwise(0)).withColumn("_e", F.col("decoded") - F.col("source"))
    sizes = F.array_sort(F.collect_list(F.abs("_e")))
    halves = rows.groupBy(image, "tx", "ty", "_by_x", "_half").agg(F.var_pop("source").alias("_v"), sizes.alias("_s"), F.avg("_e").alias("mean_error"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms"))
    best = halves.groupBy(image, "tx", "ty", "_by_x").agg(F.min(F.struct(F.round("_v", 12).alias("v"), F.col("_half").alias("half"), "_s", "mean_error", "rms")).alias("b"))
    p95 = F.element_at("b._s", F.greatest(F.ceil(F.size("b._s") * F.lit(0.95)), F.lit(1)).cast("int"))
    label = p95 + F.abs("b.mean_error") + 0.5 * F.col("b.rms")
    return best.select(image, "tx", "ty", F.col("b.half").alias("smooth_half"), F.when(F.col("_by_x"), "x").otherwise("y").alias("split"), p95.alias("p95_abs"), F.col("b.mean_error").alias("mean_error"), F.col("b.rms").alias("rms"), label.alias("label"))


def top_rows(df: DataFrame, by: Sequence[str], score: Column, order: Sequence[str], k: int = 20) -> DataFrame:
    """The k rows of each group with the highest score, ties in order, with score and rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *order)
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def risk_report(df: DataFrame, image: str, training: Column, truth: str, features: Sequence[str], levels: int, order: Sequence[str]) -> DataFrame:
    """image, training, weights (those that do best on the training images) and recall_at_1, 5 and 10 of every image."""
    names = [f"w{k}" for k in range(len(features))]
    best = best_weights(weight_search(df.where(training), [image], truth, features, levels, order), names)
    score = sum((F.col(w) * F.col(f) for w, f in zip(names, features, strict=True)), F.lit(0.0))
    scored = df.crossJoin(F.broadcast(best.select(*names))).withColumn("_score", score).withColumn("_train", training)
    scored = row_numbers(scored.select(image, "_train", truth, "_score", F.array(*names).alias("weights"), *order), [image], [F.desc(truth), *[F.col(c) for c in order]], "_t").drop("_t_all")
    ranked = row_numbers(scored, [image], [F.desc("_score"), *[F.col(c) for c in order]], "_p")
    return ranked.groupBy(image, F.col("_train").alias("training"), "weights").agg(*[_recall_at(0.05, k / 100).alias(f"recall_at_{k}") for k in (1, 5, 10)])


def policies(df: DataFrame, alternatives: Sequence[tuple[str, str, int]], keys: Sequence[str], flat: Column, edge: Column, gray: Column) -> DataFrame:
    """keys, rank, axis, policy, priority: alternatives (axis, policy, priority) in order of their priority for each row.

    Chroma is left out of gray images; quantiser and restoration gain 25 on flat ones, chroma and lambda on edged ones.
    """
    one = [F.struct(F.lit(k).alias("k"), F.lit(a).alias("axis"), F.lit(p).alias("policy"), F.lit(n).alias("base")) for k, (a, p, n) in enumerate(alternatives)]
    rows = df.select(*keys, flat.alias("_f"), edge.alias("_e"), gray.alias("_g"), F.explode(F.array(*one)).alias("a")).where(~(F.col("_g") & (F.col("a.axis") == "chroma")))
    boost = F.when(F.col("_f") & F.col("a.axis").isin("quant_lf", "restoration"), 25).when(F.col("_e") & F.col("a.axis").isin("chroma", "lambda"), 25).otherwise(0)
    rows = rows.select(*keys, F.col("a.axis").alias("axis"), F.col("a.policy").alias("policy"), (F.col("a.base") + boost).alias("priority"), F.col("a.k").alias("_k"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority"), "_k"))).drop("_k")


def schedule(runs: int, seed: int) -> str:
    """Order of runs of two arms: blocks ABBA or BAAB, drawn from the seed, then the arm that has fewer."""
    import random

    if runs < 1:
        raise ValueError("at least one run")
    rng, out = random.Random(seed), ""
    while len(out) + 4 <= runs:
        out += rng.choice(("ABBA", "BAAB"))
    while len(out) < runs:
        out += "A" if out.count("A") <= out.count("B") else "B"
    return out


def nearest_probe(probes: DataFrame, by: Sequence[str], scale: str, at: str) -> DataFrame:
    """Of each group the probe nearest to a scale in the logarithm, ties to the smaller scale."""
    w = Window.partitionBy(*by).orderBy(F.abs(F.ln(scale) - F.ln(at)), scale)
    return probes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


__all__ = [
    "atom_errors", "corpus_aggregate", "equal_metric", "equal_size", "image_summary", "match_status", "mix", "nearest_probe", "policies", "rank_index", "risk_report",
    "schedule", "target_rows", "timing_summary", "top_rows",
]
