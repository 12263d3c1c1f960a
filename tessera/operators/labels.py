"""Labels of measured curves: where each target is crossed, what that costs, and tables of cases."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.arrays import standardise
from tessera.operators.curves import log_loss, log_loss_crossing


def labels(points: DataFrame, by: Sequence[str], rung: str, scale: str, score: str, size: str, targets: Sequence[float]) -> DataFrame:
    """A row for each curve and target: state, label_rung, label_scale, label_score, crossing, beta, label_bytes, neighbours
    and the curve's top_rung, top_scale, top_score.

    The label is the first point in order of scale that reaches the target: 'floor' if it is the curve's first, 'crossed'
    else, 'censored' if there is none (then all but the top is null, and neighbours is empty). crossing lies between it
    and the point before on a line of ln loss over ln scale. beta is how fast ln loss falls over ln scale at the four
    points nearest to the crossing, null if it does not. neighbours holds the label and the points beside it that have a
    size, by scale. Scales of a curve are distinct.
    """
    rows = points.select(*by, F.col(rung).alias("_rung"), F.col(scale).cast("double").alias("_scale"), F.col(score).alias("_score"), F.col(size).alias("_size"), F.row_number().over(Window.partitionBy(*by).orderBy(scale)).alias("_k"))
    point = F.struct(F.col("_scale").alias("scale"), F.col("_rung").alias("rung"), F.col("_score").alias("score"), F.col("_size").alias("size"))
    firsts = [F.min(F.when(F.col("_score") >= t, F.col("_k"))).alias(f"_f{i}") for i, t in enumerate(targets)]
    per = rows.groupBy(*by).agg(F.max(point).alias("_top"), *firsts)
    long = per.select(*by, "_top", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_f{i}").alias("_first")) for i, t in enumerate(targets)])).alias("_t")).select(*by, "_top", "_t.*")
    near = rows.join(long.where("_first is not null").select(*by, "target", "_first"), list(by)).where(F.col("_k").between(F.col("_first") - 1, F.col("_first") + 1))
    ends = near.groupBy(*by, "target").agg(
        F.max(F.when(F.col("_k") == F.col("_first"), point)).alias("_above"), F.max(F.when(F.col("_k") == F.col("_first") - 1, point)).alias("_below"),
        F.array_sort(F.collect_list(F.when(F.col("_size").isNotNull(), point))).alias("neighbours"),
    )
    crossing = F.when(F.col("_below").isNull(), F.col("_above.scale")).otherwise(log_loss_crossing(F.col("_below.scale"), F.col("_below.score"), F.col("_above.scale"), F.col("_above.score"), F.col("target")))
    found = ends.withColumn("crossing", crossing)
    apart = Window.partitionBy(*by, "target").orderBy(F.abs(F.ln("_scale") - F.ln("crossing")), "_scale")
    four = rows.join(found.select(*by, "target", "crossing"), list(by)).withColumn("_r", F.row_number().over(apart)).where("_r <= 4")
    slope = -F.regr_slope(log_loss(F.col("_score")), F.ln("_scale"))
    beta = four.groupBy(*by, "target").agg(slope.alias("_s")).select(*by, "target", F.when(F.col("_s") > 0, F.col("_s")).alias("beta"))
    out = long.join(found, [*by, "target"], "left").join(beta, [*by, "target"], "left")
    state = F.when(F.col("_first").isNull(), "censored").when(F.col("_first") == 1, "floor").otherwise("crossed")
    return out.select(
        *by, "target", state.alias("state"), F.col("_above.rung").alias("label_rung"), F.col("_above.scale").alias("label_scale"), F.col("_above.score").alias("label_score"), "crossing", "beta",
        F.col("_above.size").alias("label_bytes"), F.coalesce("neighbours", F.array()).alias("neighbours"), F.col("_top.rung").alias("top_rung"), F.col("_top.scale").alias("top_scale"), F.col("_top.score").alias("top_score"),
    )


def priced_rungs(label_rows: DataFrame, by: Sequence[str], rung: str = "label_rung") -> DataFrame:
    """by and rung: the labels' rungs and those beside them, each once: what a pricing run has to measure."""
    return label_rows.where(F.col(rung).isNotNull()).select(*by, F.explode(F.array(F.col(rung) - 1, F.col(rung), F.col(rung) + 1)).alias("rung")).where("rung >= 1").distinct()


def bytes_ratio(neighbours: Column, label_bytes: Column, predicted: Column) -> Column:
    """Bytes at a predicted scale over the label's, on the lines of ln bytes over ln scale through the priced neighbours,
    the end lines beyond them; null with fewer than two of them or a label without bytes."""
    s = F.filter(neighbours, lambda p: F.coalesce(p["size"], F.lit(0)) > 0)
    n, x = F.size(s), F.ln(predicted)
    inner = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (F.ln(F.element_at(s, k)["scale"]) <= x) & (x <= F.ln(F.try_element_at(s, k + 1)["scale"])))
    at = F.when(x <= F.ln(F.element_at(s, 1)["scale"]), 1).when(x >= F.ln(F.element_at(s, F.greatest(n, F.lit(1)))["scale"]), n - 1).otherwise(F.get(inner, F.lit(0)))
    a, b = F.element_at(s, at), F.element_at(s, at + 1)
    dx = F.ln(b["scale"]) - F.ln(a["scale"])
    slope = F.when(dx > 0, (F.ln(b["size"]) - F.ln(a["size"])) / F.when(dx > 0, dx)).otherwise(0.0)
    return F.when((n >= 2) & (label_bytes > 0), F.exp(F.ln(a["size"]) + slope * (x - F.ln(a["scale"]))) / label_bytes)


def bucket_table_scale(df: DataFrame, table: DataFrame, keys: Sequence[str], target: Column, fallback: Column, name: str = "scale") -> DataFrame:
    """df with the scale that a table (keys, target, scale) gives for a target in the row's bucket.

    A bucket's rows lie on lines of ln scale over ln loss of their targets, the end lines beyond them; of one row the scale
    stands alone, and of none the fallback is taken. The table has a row for each bucket and target, a model's size.
    """
    entries = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(log_loss(F.col("target").cast("double")).alias("x"), F.ln(F.greatest(F.col("scale"), F.lit(1)).cast("double")).alias("y")))).alias("_e"))
    t, e, n = log_loss(target), F.col("_e"), F.size("_e")
    inner = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (F.element_at(e, k)["x"] <= t) & (t <= F.try_element_at(e, k + 1)["x"]))
    at = F.when(F.size(inner) > 0, F.get(inner, F.lit(0))).when(t < F.element_at(e, 1)["x"], 1).otherwise(n - 1)
    a, b = F.element_at(e, at), F.element_at(e, at + 1)
    line = F.exp(a["y"] + (t - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"]))
    value = F.when(e.isNull(), fallback).when(n == 1, F.exp(F.element_at(e, 1)["y"])).when(F.abs(b["x"] - a["x"]) > 2.3e-16, line).otherwise(F.exp(F.element_at(e, 1)["y"]))
    return df.join(entries, list(keys), "left").withColumn(name, value).drop("_e")


def cases(label_rows: DataFrame, image: str, vector: str, knots: Sequence[float], centers: Sequence[float], scales: Sequence[float], prior: float = 0.9) -> DataFrame:
    """A case for each image that crosses every knot: image, z (its standardised vector), ln_crossing and ln_beta by knot.

    A missing beta takes the mean of the image's own in the logarithm, or the prior's.
    """
    at = lambda name, t: F.max(F.when((F.abs(F.col("target") - t) < 1e-9) & (F.col("state") != "censored"), F.col(name)))
    crossings, betas = F.array(*[F.ln(at("crossing", t)) for t in knots]), F.array(*[F.ln(at("beta", t)) for t in knots])
    per = label_rows.groupBy(image).agg(F.first(vector).alias("_v"), crossings.alias("ln_crossing"), betas.alias("_b")).where(F.forall("ln_crossing", lambda v: v.isNotNull()))
    known = F.filter("_b", lambda v: v.isNotNull())
    fill = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)).otherwise(math.log(prior))
    return per.select(image, standardise(F.col("_v"), centers, scales).alias("z"), "ln_crossing", F.transform("_b", lambda v: F.coalesce(v, fill)).alias("ln_beta"))


def infer(vector: Column, knots: Sequence[tuple[float, Sequence[float]]], target: Column) -> Column:
    """ln scale that affine models at rising targets give a standardised vector, never falling from knot to knot, on lines
    of ln loss between the knots and constant beyond them."""
    from tessera.functions.arrays import affine, interpolate_knots

    values, top = [], None
    for _, w in knots:
        own = affine(F.lit([float(x) for x in w]), vector)
        top = own if top is None else F.greatest(top, own)
        values.append(top)
    return interpolate_knots(F.array(*values), log_loss(target), [math.log(max(100.0 - t, 1e-3)) for t, _ in knots])


def design(z: Column, target: Column, interacting: Sequence[int], center: float = 3.0) -> Column:
    """Row of a pooled fit: the vector, the centred ln loss of the target, and its products with some of the entries."""
    x = log_loss(target) - center
    return F.concat(z, F.array(x), F.array(*[x * F.get(z, F.lit(i)) for i in interacting]))


def fold_at_target(w: Sequence[float], target: float, dim: int, interacting: Sequence[int], center: float = 3.0) -> list[float]:
    """A pooled fit as an affine model of the vector at one target."""
    x = math.log(max(100.0 - target, 1e-3)) - center
    out = [w[0] + w[1 + dim] * x, *w[1 : 1 + dim]]
    for j, i in enumerate(interacting):
        out[1 + i] += w[2 + dim + j] * x
    return out
