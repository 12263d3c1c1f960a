"""Features of images and their cells, from rows of pixels or tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.entropy import direction_entropy
from tessera.operators.stats import linear_quantiles, order_statistics

# Thresholds of the cell classes and of the gradients that they count.
EDGE_GRADIENT, FLAT_GRADIENT, WEAK_GRADIENT = 48, 12, 24
TEXT_EDGE, DENSE_EDGE, GRADIENT_EDGE, FLAT_EDGE = 64, 38, 26, 13
LOW_ENTROPY, HIGH_ENTROPY, DOMINANT, AXIS_ALIGNED = 110, 150, 128, 160
NOISY, FLAT_VARIANCE, TEXTURE_VARIANCE, CHROMA_CRITICAL, HETERO_BITS = 7, 12, 64, 96, 2.0


def source_features(atoms: DataFrame, image: str, flat: float = 2e-5) -> DataFrame:
    """Per image of atoms (var_x, var_y, var_b): luma_q10, luma_q50, luma_q90, chroma_q50 (floor-indexed quantiles of the
    variances), flat_fraction and edge_proxy."""
    luma = order_statistics(atoms, [image], "var_y", {f"luma_q{round(q * 100)}": lambda n, q=q: F.floor((n - 1) * F.lit(q)) for q in (0.1, 0.5, 0.9)})
    chroma = order_statistics(atoms.select(image, (F.col("var_x") + F.col("var_b")).alias("_c")), [image], "_c", {"chroma_q50": lambda n: F.floor((n - 1) * F.lit(0.5))})
    share = atoms.groupBy(image).agg((F.count_if(F.col("var_y") < flat) / F.count("*")).alias("flat_fraction"))
    return luma.join(chroma, image).join(share, image).withColumn("edge_proxy", F.col("luma_q90") - F.col("luma_q50"))


def luma8(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def chroma8(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    kept = lambda v: F.least(F.greatest(F.shiftright(v, 8) + 128, F.lit(0)), F.lit(255))
    return kept(-43 * r - 85 * g + 128 * b + 128), kept(128 * r - 107 * g - 21 * b + 128)


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a.cast("bigint"), F.lit(b) if isinstance(b, int) else b)


def cells(rgb: DataFrame, side: int = 32, whole: bool = True) -> DataFrame:
    """image, cy, cx, variance, edge, flat, noise, chroma, has_edges, entropy, dominance and axis of the cells of rows
    (image, x, y, r, g, b) with integers up to 255; shares are in 256ths.

    Gradients are 3 x 3 Sobel sums of the luma, the border repeated. whole leaves out cells that the image cuts off.
    """
    cb, cr = chroma8(F.col("r"), F.col("g"), F.col("b"))
    rows = rgb.repartition("image").select("image", "x", "y", luma8(F.col("r"), F.col("g"), F.col("b")).cast("bigint").alias("l"), cb.cast("bigint").alias("cb"), cr.cast("bigint").alias("cr"))
    across, down = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    side_of = lambda c, f, w: F.coalesce(f(c).over(w), F.col(c))
    rows = rows.withColumn("ml", side_of("l", F.lag, across)).withColumn("mr", side_of("l", F.lead, across))
    for c, up, low in (("l", "tc", "bc"), ("ml", "tl", "bl"), ("mr", "tr", "br")):
        rows = rows.withColumn(up, side_of(c, F.lag, down)).withColumn(low, side_of(c, F.lead, down))
    v = {c: F.col(c) for c in ("l", "ml", "mr", "tc", "bc", "tl", "bl", "tr", "br")}
    gx, gy = (v["tr"] + 2 * v["mr"] + v["br"]) - (v["tl"] + 2 * v["ml"] + v["bl"]), (v["bl"] + 2 * v["bc"] + v["br"]) - (v["tl"] + 2 * v["tc"] + v["tr"])
    rows = rows.withColumn("gx", gx).withColumn("gy", gy).withColumn("grad", F.abs(gx) + F.abs(gy)).withColumn("box", _div(sum(v.values(), F.lit(0)), 9))
    ax, ay = F.abs("gx"), F.abs("gy")
    bin_ = F.when(ax >= 2 * ay, 0).when(ay >= 2 * ax, 1).when((F.col("gx") > 0) == (F.col("gy") > 0), 2).otherwise(3)
    edge, weak = F.col("grad") > EDGE_GRADIENT, F.col("grad") < WEAK_GRADIENT
    rows = rows.withColumn("dir", F.when(edge, bin_)).withColumn("cy", F.floor(F.col("y") / side).cast("int")).withColumn("cx", F.floor(F.col("x") / side).cast("int"))
    n = F.col("n")
    sums = rows.groupBy("image", "cy", "cx").agg(
        F.count("*").alias("n"), F.sum("l").alias("s"), F.sum(F.col("l") * F.col("l")).alias("ss"), F.count_if(edge).alias("e"), F.count_if(F.col("grad") < FLAT_GRADIENT).alias("f"),
        F.sum(F.when(weak, F.abs(F.col("l") - F.col("box"))).otherwise(0)).alias("q"), F.count_if(weak).alias("k"), *[F.count_if(F.col("dir") == d).alias(f"d{d}") for d in range(4)],
        *[F.sum(F.col(c)).alias(f"{c}s") for c in ("cb", "cr")], *[F.sum(F.col(c) * F.col(c)).alias(f"{c}q") for c in ("cb", "cr")],
    )
    sums = sums.where(n == side * side) if whole else sums
    spread = lambda q, s: F.greatest(_div(F.col(q), n) - _div(F.col(s), n) * _div(F.col(s), n), F.lit(0))
    dirs = [F.col(f"d{d}") for d in range(4)]
    total = sum(dirs, F.lit(0))
    at_least = F.greatest(total, F.lit(1))
    return sums.select(
        "image", "cy", "cx", spread("ss", "s").alias("variance"), _div(F.col("e") * 256, n).alias("edge"), _div(F.col("f") * 256, n).alias("flat"), F.when(F.col("k") > 0, _div(F.col("q"), F.greatest("k", F.lit(1)))).otherwise(0).alias("noise"),
        F.least(spread("cbq", "cbs") + spread("crq", "crs"), F.lit(65535)).alias("chroma"), (total > 0).alias("has_edges"), direction_entropy(F.array(*dirs)).alias("entropy"),
        _div(F.greatest(*dirs) * 256, at_least).alias("dominance"), _div((dirs[0] + dirs[1]) * 256, at_least).alias("axis"),
    )


def cell_class() -> Column:
    """Class of a cell: the first rule that holds."""
    c = {k: F.col(k) for k in ("edge", "entropy", "axis", "noise", "dominance", "variance", "chroma")}
    return (
        F.when((c["edge"] >= TEXT_EDGE) & (c["entropy"] < LOW_ENTROPY) & (c["axis"] >= AXIS_ALIGNED) & (c["noise"] < NOISY), "text_like")
        .when((c["edge"] >= DENSE_EDGE) & (c["dominance"] >= DOMINANT), "directional_edge")
        .when((c["noise"] >= NOISY) & (c["variance"] < TEXTURE_VARIANCE), "noisy")
        .when((c["variance"] >= TEXTURE_VARIANCE) & (c["entropy"] >= HIGH_ENTROPY), "texture")
        .when((c["variance"] < FLAT_VARIANCE) & (c["edge"] < FLAT_EDGE), "flat")
        .when(c["edge"] < GRADIENT_EDGE, "gradient")
        .when(c["chroma"] >= CHROMA_CRITICAL, "chroma_critical")
        .otherwise("texture")
    )


CLASSES = ("flat", "gradient", "chroma_critical", "noisy", "texture", "directional_edge", "text_like")


def structure(cell_rows: DataFrame, hetero: float = HETERO_BITS) -> DataFrame:
    """Per image: cells, the share of each class, and means and interpolated quantiles over its cells.

    log2var is the binary logarithm of one plus the variance, as chroma_log2; hetero_frac the share of cells whose log2var
    is more than hetero from the image's mean; orientation means are over cells with edges, 0 without one.
    """
    rows = cell_rows.withColumn("class", cell_class()).withColumn("lv", F.log2(1.0 + F.col("variance"))).withColumn("ed", F.col("edge") / 256.0).withColumn("ch", F.log2(1.0 + F.col("chroma"))).withColumn("no", F.col("noise").cast("double"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("has_edges"), F.col(c) / 256.0)), F.lit(0.0))
    base = rows.groupBy("image").agg(
        F.count("*").alias("cells"), *[(F.count_if(F.col("class") == k) / F.count("*")).alias(f"share_{k}") for k in CLASSES], F.avg("lv").alias("log2var_mean"), F.stddev_pop("lv").alias("log2var_std"), F.avg("ed").alias("edge_mean"),
        F.avg(F.col("flat") / 256.0).alias("flat_mean"), F.avg("no").alias("noise_mean"), F.avg("ch").alias("chroma_log2_mean"), mean("entropy").alias("orient_entropy_mean"), mean("dominance").alias("dir_dominance_mean"), mean("axis").alias("axis_aligned_mean"),
    )
    far = rows.join(base.select("image", "log2var_mean"), "image").groupBy("image").agg((F.count_if(F.abs(F.col("lv") - F.col("log2var_mean")) > hetero) / F.count("*")).alias("hetero_frac"))
    out = base.join(far, "image")
    for c, name, quantiles in (("lv", "log2var", (0.1, 0.9)), ("ed", "edge", (0.9,)), ("no", "noise", (0.9,)), ("ch", "chroma_log2", (0.9,))):
        q = linear_quantiles(rows, ["image"], c, quantiles)
        out = out.join(q.withColumnsRenamed({k: f"{name}_{k}" for k in q.columns if k != "image"}), "image")
    return out


def cell_shares(cell_rows: DataFrame) -> DataFrame:
    """Per image the shares of text-like, structured (text-like or directional) and crisp cells."""
    rows = cell_rows.withColumn("class", cell_class())
    share = lambda c: F.count_if(c) / F.count("*")
    crisp = (F.col("edge") >= TEXT_EDGE) & (F.col("noise") < NOISY)
    return rows.groupBy("image").agg(share(F.col("class") == "text_like").alias("textlike_share"), share(F.col("class").isin("text_like", "directional_edge")).alias("structured_share"), share(crisp).alias("crisp_share"))


def flags(pixels: DataFrame, image: str, most: int = 255) -> DataFrame:
    """image, grayscale (all channels equal) and opaque (alpha at its largest throughout) of rows with r, g, b, a."""
    gray = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    return pixels.groupBy(image).agg(F.bool_and(gray).alias("grayscale"), F.bool_and(F.col("a") == most).alias("opaque"))


def gradients(df: DataFrame, side: int = 8) -> DataFrame:
    """Per atom of rows (image, x, y, v): energies of the steps to the right and down inside the atom, their mean product,
    the energy and median size of the Laplacian of inner samples, and the range."""
    rows = df.repartition("image").withColumn("ty", F.floor(F.col("y") / side).cast("int")).withColumn("tx", F.floor(F.col("x") / side).cast("int")).withColumn("v", F.col("v").cast("double"))
    across, down = Window.partitionBy("image", "ty", "tx", "y").orderBy("x"), Window.partitionBy("image", "ty", "tx", "x").orderBy("y")
    gx, gy = F.lead("v").over(across) - F.col("v"), F.lead("v").over(down) - F.col("v")
    near = F.lag("v").over(across) + F.lead("v").over(across) + F.lag("v").over(down) + F.lead("v").over(down) - 4 * F.col("v")
    rows = rows.withColumn("gx", gx).withColumn("gy", gy).withColumn("l", near)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    # An atom has at most side * side samples.
    sizes = F.array_sort(F.collect_list(F.abs("l")))
    out = rows.groupBy("image", "ty", "tx").agg(mean(F.col("gx") * F.col("gx")).alias("energy_x"), mean(F.col("gy") * F.col("gy")).alias("energy_y"), mean(F.col("gx") * F.col("gy")).alias("cross"), mean(F.col("l") * F.col("l")).alias("laplacian"), (F.max("v") - F.min("v")).alias("range"), sizes.alias("_s"))
    n = F.size("_s")
    middle = (F.element_at("_s", F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.element_at("_s", F.greatest(F.floor(n / 2) + 1, F.lit(1)).cast("int"))) / 2
    return out.withColumn("noise", F.when(n > 0, middle).otherwise(0.0)).drop("_s")


def quant_field(atoms: DataFrame, image: str, strength: float = 0.5, chroma_weight: float = 0.5, clamp: float = 1.0, scale: float = 65025.0, sign: float = 1.0) -> DataFrame:
    """atoms (var_x, var_y, var_b) with activity, and adjustment: its distance to the image's mean, weighed and clamped."""
    activity = F.log2(1 + F.col("var_y") * scale) + chroma_weight * F.log2(1 + (F.col("var_x") + F.col("var_b")) * scale)
    rows = atoms.withColumn("activity", activity)
    mean = rows.groupBy(image).agg(F.avg("activity").alias("_mean"))
    moved = sign * strength * (F.col("activity") - F.col("_mean"))
    return rows.join(mean, image).withColumn("adjustment", F.least(F.greatest(moved, F.lit(-clamp)), F.lit(clamp))).drop("_mean")


def footprint_multiplier(field: DataFrame, by: Sequence[str], base: int, fine: bool, refine_only: bool = False) -> DataFrame:
    """by, multiplier: base times two to the minus the mean adjustment of a footprint's atoms, clamped to one octave (fine)
    or rounded to half octaves, kept in 1 .. 2 base."""
    mean = F.avg("adjustment")
    adj = F.least(F.greatest(mean, F.lit(-1.0)), F.lit(1.0)) if fine else F.round(mean * 2) / 2
    adj = F.least(adj, F.lit(0.0)) if refine_only else adj
    return field.groupBy(*by).agg(F.least(F.greatest(F.round(base * F.pow(F.lit(2.0), -adj)), F.lit(1.0)), F.lit(2.0 * base)).cast("int").alias("multiplier"))
