"""Planar images as rows (image, x, y, v): neighbours, filters, transforms and tile statistics.

Stencils deal rows to tasks by image once; their windows, by lines and columns of an image, then only sort. Tiles and
pyramids are plain aggregates; transforms of blocks work on arrays, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import pixel

PREDICTORS = ("zero", "west", "north", "avg_wn", "select", "gradient", "north_east", "north_west", "west_west", "avg_wnw", "avg_nnw", "avg_nne", "avg_all")


def from_blocks(df: DataFrame, image: str, values: str, side: int, v: Column | None = None) -> DataFrame:
    """Rows (image, x, y, v) of blocks held as arrays in raster order; v is an expression of value."""
    rows = df.select(F.col(image).alias("image"), F.posexplode(values).alias("pos", "value"))
    return rows.select("image", (F.col("pos") % side).alias("x"), F.floor(F.col("pos") / side).cast("int").alias("y"), (F.col("value") if v is None else v).alias("v"))


def whole_images(df: DataFrame) -> DataFrame:
    """df with all rows of an image in one task: windows within an image need no shuffle of their own after it."""
    return df.repartition("image")


def to_blocks(df: DataFrame, image: str = "image") -> DataFrame:
    """The inverse: one array in raster order for each image."""
    return df.groupBy(image).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda e: e.v).alias("values"))


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    kept = df.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return kept.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def tiles(df: DataFrame, side: int, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Mean, population variance (not below 0), smallest, largest and count of each tile; border tiles may be partial."""
    at = [F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx")]
    v = F.col("v").cast("double")
    return df.groupBy(*keys, *at).agg(F.avg(v).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.var_pop(v).alias("variance"))


def flat_share(tile_rows: DataFrame, threshold: float = 2e-5, keys: Sequence[str] = ("image",)) -> DataFrame:
    return tile_rows.groupBy(*keys).agg((F.count_if(F.col("variance") < threshold) / F.count("*")).alias("flat_fraction"))


def neighbours(df: DataFrame) -> DataFrame:
    """w, n, nw, ne, nn, nee and ww of each sample, each falling back to a nearer one at the border."""
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    up = whole_images(df).withColumn("_n", F.lag("v").over(col)).withColumn("_nn", F.lag("v", 2).over(col))
    side = up.withColumn("_w", F.lag("v").over(row)).withColumn("_ww", F.lag("v", 2).over(row))
    side = side.withColumn("_nw", F.lag("_n").over(row)).withColumn("_ne", F.lead("_n").over(row)).withColumn("_nee", F.lead("_n", 2).over(row))
    zero = F.lit(0).cast(dict(df.dtypes)["v"])
    out = side.withColumn("w", F.coalesce("_w", "_n", zero))
    out = out.withColumn("n", F.coalesce("_n", "w")).withColumn("nw", F.coalesce("_nw", "w")).withColumn("ww", F.coalesce("_ww", "w"))
    out = out.withColumn("ne", F.coalesce("_ne", "n")).withColumn("nn", F.coalesce("_nn", "n")).withColumn("nee", F.coalesce("_nee", "ne"))
    return out.drop("_n", "_nn", "_w", "_ww", "_nw", "_ne", "_nee")


def prediction(name: str) -> Column:
    """A predictor's value from neighbours(); averages truncate."""
    w, n, nw, ne, nn, nee, ww = (F.col(c) for c in ("w", "n", "nw", "ne", "nn", "nee", "ww"))
    every = 6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8
    return {
        "zero": F.lit(0).cast("bigint"), "west": w, "north": n, "avg_wn": pixel.truncated(w + n, 2),
        "select": F.when(F.abs(n - nw) < F.abs(w - nw), w).otherwise(n), "gradient": pixel.gradient(w, n, nw),
        "north_east": ne, "north_west": nw, "west_west": ww, "avg_wnw": pixel.truncated(w + nw, 2), "avg_nnw": pixel.truncated(n + nw, 2),
        "avg_nne": pixel.truncated(n + ne, 2), "avg_all": pixel.truncated(every, 16),
    }[name]


def residual_cost(df: DataFrame, predictors: Sequence[str] = PREDICTORS) -> DataFrame:
    """Summed absolute residual of each predictor, a row for each image and predictor."""
    cols = [F.sum(F.abs(F.col("v") - prediction(p))).alias(p) for p in predictors]
    wide = neighbours(df).groupBy("image").agg(*cols)
    return wide.unpivot(["image"], list(predictors), "predictor", "cost")


def squeeze(df: DataFrame, along: str = "x") -> DataFrame:
    """Wavelet step along x or y: for each pair its average and the difference less what its neighbours let expect.

    An odd last sample is an average without a residual.
    """
    across = "y" if along == "x" else "x"
    pair = F.floor(F.col(along) / 2).cast("int")
    of = lambda k: F.max(F.when(F.col(along) % 2 == k, F.col("v")))
    halves = whole_images(df).groupBy("image", across, pair.alias(along)).agg(of(0).alias("_a"), of(1).alias("_b"))
    w = Window.partitionBy("image", across).orderBy(along)
    d = F.col("_a") - F.col("_b")
    halves = halves.withColumn("average", F.when(F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") - pixel.truncated(d, 2)))
    step = halves.withColumn("_next", F.coalesce(F.lead("average").over(w), F.col("average"))).withColumn("_left", F.coalesce(F.lag("_b").over(w), F.col("average")))
    residual = F.when(F.col("_b").isNotNull(), d - pixel.tendency(F.col("_left"), F.col("average"), F.col("_next")))
    return step.select("image", "y", "x", "average", residual.alias("residual"))


def squeeze_rows(df: DataFrame) -> DataFrame:
    return squeeze(df, "x")


def unsqueeze_line(averages: list[int], residuals: list[int | None]) -> list[int]:
    out: list[int] = []
    for k, (average, residual) in enumerate(zip(averages, residuals, strict=True)):
        if residual is None:
            out.append(average)
            continue
        left = out[-1] if out else average
        after = averages[k + 1] if k + 1 < len(averages) else average
        d = residual + expected_residual(left, average, after)
        first = average + int(d / 2)
        out += [first, first - d]
    return out


def unsqueeze_rows(df: DataFrame) -> DataFrame:
    """Inverse of squeeze_rows. Each sample needs the one before it, so a line is one array; lines are independent."""
    lines = df.groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct(F.col("x"), F.col("average").cast("bigint").alias("a"), F.col("residual").cast("bigint").alias("r")))).alias("s"))
    lines = lines.select("image", "y", F.transform("s", lambda e: e.a).alias("a"), F.transform("s", lambda e: e.r).alias("r"))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            made = [unsqueeze_line(a, r) for a, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int64()))], names=["image", "y", "v"])

    kinds = dict(df.dtypes)
    whole = lines.mapInArrow(run, f"image {kinds['image']}, y {kinds['y']}, v array<bigint>")
    return whole.select("image", F.posexplode("v").alias("x", "v"), "y").select("image", "x", "y", "v")


def expected_residual(a: int, b: int, c: int) -> int:
    """pixel.tendency for plain integers: the slope's share, kept so that both samples stay between their neighbours."""
    if not (a >= b >= c or a <= b <= c):
        return 0
    sign = 1 if a >= b >= c else -1
    # A rising run is a falling one with all signs changed.
    x = int(sign * (4 * a - 3 * c - b) + 6) // 12
    odd, first, second = x & 1, 2 * sign * (a - b), 2 * sign * (b - c)
    if x - odd > first:
        x = first + 1
    if x + (x & 1) > second:
        x = second
    return sign * x


def erode(df: DataFrame) -> DataFrame:
    """Smallest value of each sample's 3 x 3 surrounding, cut off at the border."""
    row, col = Window.partitionBy("image", "y").orderBy("x").rowsBetween(-1, 1), Window.partitionBy("image", "x").orderBy("y").rowsBetween(-1, 1)
    return whole_images(df).withColumn("_m", F.min("v").over(row)).withColumn("eroded", F.min("_m").over(col)).drop("_m")


def gaborish(df: DataFrame, side: float = 0.115169525, corner: float = 0.061248592) -> DataFrame:
    """Symmetric 3 x 3 smoothing of weight 1, border samples counted twice beyond the border."""
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    near = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c)) + F.coalesce(F.lead(c).over(w), F.col(c))
    lines = whole_images(df).withColumn("v", F.col("v").cast("double")).withColumn("_h", near("v", row))
    both = lines.withColumn("_v", near("v", col)).withColumn("_d", near("_h", col))
    total = 1 + 4 * side + 4 * corner
    return both.select("image", "x", "y", ((F.col("v") + side * (F.col("_h") + F.col("_v")) + corner * F.col("_d")) / total).alias("v"))


def laplacian(df: DataFrame) -> DataFrame:
    """5 x 5 stencil: 0.16 of all neighbours less 3.84 of the middle; lines and columns mirror at the border."""
    w = lambda a, b: Window.partitionBy("image", a).orderBy(b)

    def around(c: str, a: str, b: str) -> Column:
        at = [F.lag(c, 1).over(w(a, b)), F.lag(c, 2).over(w(a, b)), F.lead(c, 1).over(w(a, b)), F.lead(c, 2).over(w(a, b))]
        me = F.col(c)
        l1, r1 = F.coalesce(at[0], me), F.coalesce(at[2], me)
        l2 = F.coalesce(at[1], F.when(at[0].isNull(), F.coalesce(at[2], me)).otherwise(at[0]))
        r2 = F.coalesce(at[3], F.when(at[2].isNull(), F.coalesce(at[0], me)).otherwise(at[2]))
        return me + l1 + l2 + r1 + r2

    lines = whole_images(df).withColumn("v", F.col("v").cast("double")).withColumn("_h", around("v", "y", "x"))
    return lines.withColumn("_s", around("_h", "x", "y")).select("image", "x", "y", (0.16 * F.col("_s") - 4.0 * F.col("v")).alias("v"))


def pyramid(df: DataFrame) -> DataFrame:
    """Half size: means of 2 x 2 samples, of those that exist at an odd border."""
    return df.groupBy("image", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.avg("v").alias("v"))


def dct_basis(n: int) -> list[list[float]]:
    """Row u: cos((2 x + 1) u pi / 2 n) times sqrt(2), 1 for u = 0, over n: the constant coefficient is the mean."""
    return [[(math.sqrt(2) if u else 1.0) * math.cos((2 * x + 1) * u * math.pi / (2 * n)) / n for x in range(n)] for u in range(n)]


def separable(df: DataFrame, values: str, left: list[list[float]], right: list[list[float]], keep: Sequence[str]) -> DataFrame:
    """keep and values: each array in raster order as a matrix M, replaced by left M transpose(right); no row leaves its task.

    left is of rows x height, right of columns x width. Arrays that are null or of another size stay null.
    """
    a, b = np.array(left), np.array(right)
    size = a.shape[1] * b.shape[1]

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            column = batch.column(len(keep))
            ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
            m = np.asarray(pc.list_flatten(column.filter(pa.array(ok))), np.float64).reshape(-1, a.shape[1], b.shape[1])
            out = np.einsum("uy,nyx,wx->nuw", a, m, b, optimize=True).reshape(len(m), -1)
            places = np.cumsum(ok) - 1
            made = pa.array([out[k].tolist() if good else None for k, good in zip(places.tolist(), ok.tolist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, "values"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.select(*keep).dtypes], "`values` array<double>"])
    return df.select(*keep, F.col(values).cast("array<double>").alias("values")).mapInArrow(run, schema)


def dct_blocks(df: DataFrame, image: str, values: str, n: int) -> DataFrame:
    """image, u, w, coefficient of n x n blocks held as arrays in raster order; u counts along x, w along y."""
    out = separable(df, values, dct_basis(n), dct_basis(n), [image])
    rows = out.select(F.col(image).alias("image"), F.posexplode("values").alias("_k", "coefficient"))
    return rows.select("image", (F.col("_k") % n).alias("u"), F.floor(F.col("_k") / n).cast("int").alias("w"), "coefficient")


def dct(df: DataFrame, n: int) -> DataFrame:
    """The same of rows (image, x, y, v); one shuffle gathers the blocks."""
    return dct_blocks(to_blocks(df), "image", "values", n)


def inverse_dct(df: DataFrame, n: int) -> DataFrame:
    back = (np.array(dct_basis(n)).T * n).tolist()
    blocks = to_blocks(df.select("image", F.col("u").alias("x"), F.col("w").alias("y"), F.col("coefficient").alias("v")))
    return from_blocks(separable(blocks, "values", back, back, ["image"]), "image", "values", n)


def dct_lines(df: DataFrame, n: int) -> DataFrame:
    """One-dimensional transform of each line of n samples: image, y, u, coefficient."""
    identity = np.eye(n).tolist()
    out = separable(to_blocks(df), "values", identity, dct_basis(n), ["image"])
    return from_blocks(out, "image", "values", n).select("image", "y", F.col("x").alias("u"), F.col("v").alias("coefficient"))


def half_inverse_dct(df: DataFrame, n: int) -> DataFrame:
    """Half-size image of n x n coefficients: the inverse transform of their lower half, whose constant is the same mean."""
    low = df.where((F.col("u") < n // 2) & (F.col("w") < n // 2))
    return inverse_dct(low, n // 2)


def palette(df: DataFrame, colour: Sequence[str], order: str, cap: int = 256) -> DataFrame:
    """Distinct colours numbered by first appearance; empty above cap."""
    first = df.groupBy(*colour).agg(F.min(order).alias("first"), F.count("*").alias("n")).orderBy("first").limit(cap + 1)
    # At most cap + 1 rows reach the windows.
    numbered = first.withColumn("index", F.row_number().over(Window.orderBy("first")) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(0))))
    return numbered.where(F.col("_all") <= cap).drop("_all")


def palette_lookup(df: DataFrame, table: DataFrame, index: str, bits: int, colours: int, deltas: Sequence[Sequence[int]] = ()) -> DataFrame:
    """df (with an index and a channel c) with value: the table's (index, c, value) below colours, computed ones elsewhere.

    The 64 indices from colours on are a cube with four steps a channel, two bits each, moved up by half a step; all later
    ones a cube with five steps, digits to the base 5. A negative index is an offset from deltas: -1 is the first, and each
    later one has two indices, one for either sign, scaled up for more than 8 bits; without deltas it is null.
    """
    most = (1 << bits) - 1
    place = F.col(index).cast("bigint") - colours
    four = pixel.truncated(F.shiftright(place, 0).bitwiseAND(F.lit(63)).cast("bigint"), F.pow(F.lit(4.0), F.col("c")).cast("bigint")) % 4
    five = pixel.truncated(place - 64, F.pow(F.lit(5.0), F.col("c")).cast("bigint")) % 5
    beyond = F.when(place < 64, pixel.truncated(four * most, 4) + (1 << max(0, bits - 3))).otherwise(pixel.truncated(five * most, 4))
    below = F.lit(None).cast("bigint")
    if deltas:
        folded = F.pmod(-F.col(index).cast("bigint") - 1, F.lit(2 * len(deltas) - 1))
        row = F.element_at(F.lit([[int(v) for v in d] for d in deltas]), (F.shiftright(folded + 1, 1) + 1).cast("int"))
        value = F.coalesce(F.get(row, F.col("c").cast("int")), F.lit(0)).cast("bigint")
        below = F.when(folded % 2 == 0, -value).otherwise(value) * (1 << max(0, min(bits, 24) - 8))
    known = table.select(F.col("index").alias("_i"), F.col("c").alias("_c"), F.col("value").cast("bigint").alias("_value"))
    out = df.join(known, (F.col(index) == F.col("_i")) & (F.col("c") == F.col("_c")), "left")
    value = F.when(F.col(index) < 0, below).when(F.col(index) < colours, F.col("_value")).otherwise(beyond)
    return out.withColumn("value", value).drop("_i", "_c", "_value")


# Weights of the middle, the sides and the corners of the low-frequency smoothing.
SMOOTH_MIDDLE, SMOOTH_SIDE, SMOOTH_CORNER = 0.052262735, 0.2034514, 0.03348292


def adaptive_smoothing(df: DataFrame, planes: Sequence[str], steps: Sequence[float]) -> DataFrame:
    """Rows (image, x, y and planes) smoothed by a 3 x 3 mean where no plane moves by much against its step.

    The share falls from 1 to 0 as the largest move grows from half a step to three quarters; samples at the border stay.
    """
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    rows = whole_images(df).withColumns({p: F.col(p).cast("double") for p in planes})
    rows = rows.withColumns({f"_h_{p}": F.lag(p).over(row) + F.lead(p).over(row) for p in planes})
    mean = lambda p: SMOOTH_MIDDLE * F.col(p) + SMOOTH_SIDE * (F.col(f"_h_{p}") + F.lag(p).over(col) + F.lead(p).over(col)) + SMOOTH_CORNER * (F.lag(f"_h_{p}").over(col) + F.lead(f"_h_{p}").over(col))
    rows = rows.withColumns({f"_m_{p}": mean(p) for p in planes})
    gap = F.greatest(F.lit(0.5), *[F.abs(F.col(f"_m_{p}") - F.col(p)) / s for p, s in zip(planes, steps, strict=True)])
    share = F.greatest(3 - 4 * gap, F.lit(0.0))
    return rows.select("image", "x", "y", *[F.when(F.col(f"_m_{p}").isNull(), F.col(p)).otherwise((F.col(f"_m_{p}") - F.col(p)) * share + F.col(p)).alias(p) for p in planes])


def plane_at(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (image, x, y) with v, 0 where the plane has no such sample."""
    return wanted.join(df.select("image", "x", "y", "v"), ["image", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def interleave(df: DataFrame, channels: int) -> DataFrame:
    """image and values: the samples (image, c, x, y, v) of all channels place after place."""
    rows = df.where(F.col("c") < channels)
    return rows.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "c", "v"))), lambda e: e.v).alias("values"))


def deinterleave(df: DataFrame, image: str, values: str, width: int, channels: int) -> DataFrame:
    """image, c, x, y, v of arrays that hold the channels place after place."""
    rows = df.select(F.col(image).alias("image"), F.posexplode(values).alias("_k", "v"))
    place = F.floor(F.col("_k") / channels)
    return rows.select("image", (F.col("_k") % channels).alias("c"), (place % width).cast("int").alias("x"), F.floor(place / width).cast("int").alias("y"), "v")


def with_tile(df: DataFrame, tiles_: DataFrame, side: int, columns: Sequence[str]) -> DataFrame:
    """Rows (image, x, y, ...) with columns of their tile (image, ty, tx); rows without one get nulls."""
    keyed = df.withColumn("ty", F.floor(F.col("y") / side).cast("int")).withColumn("tx", F.floor(F.col("x") / side).cast("int"))
    return keyed.join(tiles_.select("image", "ty", "tx", *columns), ["image", "ty", "tx"], "left").drop("ty", "tx")


def apply_patches(canvas: DataFrame, reference: DataFrame, patches: DataFrame) -> DataFrame:
    """Canvas rows (image, x, y, v) with patches blended onto them.

    A patch (image, slot, x0, y0, width, height, at_x, at_y, mode, alpha) takes a rectangle of the reference (image, slot,
    x, y, v) to a place. Patches of a layer do not overlap; layers are applied one after the other.
    """
    r = reference.select("image", "slot", F.col("x").alias("_rx"), F.col("y").alias("_ry"), F.col("v").alias("_new"))
    moved = patches.join(r, ["image", "slot"]).where("_rx >= x0 and _rx < x0 + width and _ry >= y0 and _ry < y0 + height")
    moved = moved.select("image", (F.col("_rx") - F.col("x0") + F.col("at_x")).alias("x"), (F.col("_ry") - F.col("y0") + F.col("at_y")).alias("y"), "_new", "mode", "alpha")
    out = canvas.join(moved, ["image", "x", "y"], "left")
    return out.select("image", "x", "y", F.when(F.col("_new").isNull(), F.col("v")).otherwise(pixel.patch_blend(F.col("mode"), F.col("v"), F.col("_new"), F.col("alpha"))).alias("v"))


def composite(canvas: DataFrame, frame: DataFrame, mode: str, x: int, y: int) -> DataFrame:
    """A frame blended onto a canvas at a place; samples outside the frame keep the canvas', a missing one is 0."""
    moved = frame.select("image", (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), F.col("v").alias("_new"), F.col("alpha").alias("_a"))
    out = canvas.join(moved, ["image", "x", "y"], "left")
    old = F.coalesce(F.col("v"), F.lit(0.0))
    value = F.when(F.col("_new").isNull(), old).otherwise(pixel.blend(F.lit(mode), old, F.col("_new"), F.lit(1.0), F.col("_a")))
    return out.select("image", "x", "y", value.alias("v"))


def colour_census(df: DataFrame, image: str, rgb: Column, cap: int = 1 << 17) -> DataFrame:
    """Exact number of colours of each image, and whether it is over cap."""
    out = df.groupBy(image).agg(F.countDistinct(rgb).alias("_n"), F.count("*").alias("pixels"))
    return out.select(image, "pixels", F.least("_n", F.lit(cap)).alias("colours"), (F.col("_n") > cap).alias("capped"))


def route(census: DataFrame, few: int = 65_536, dense: float = 50.0) -> DataFrame:
    """photo if over the cap; text if few colours and many pixels a colour; else unknown."""
    text = (F.col("colours") <= few) & (F.col("pixels") / F.col("colours") >= dense)
    return census.withColumn("route", F.when(F.col("capped"), "photo").when(text, "text").otherwise("unknown"))
