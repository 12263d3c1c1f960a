"""Stencils over tiles with halos: an image larger than a task is split, and each tile is computed as an array.

A sample goes to its tile and, beside an edge, to the tiles whose halo it is in; beyond an image's border the halo holds
mirrored samples. So one shuffle serves several steps, whose halos add up, and a tile's size bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.pixel import mirror

#: Side of a tile.
TILE = 256

# Neighbours within a distance of 2 and of 1, scales of the three planes in a distance, the slope of the weights, scales of
# the first and third step, of samples at the edge of a block of 8, and sigma below which a sample stays.
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
DIAMOND = (*CROSS, (1, -1), (1, 1), (-1, 1), (-1, -1), (-2, 0), (2, 0), (0, 2), (0, -2))
PLANE_SCALES = (40.0, 5.0, 3.5)
SLOPE, FIRST_SCALE, THIRD_SCALE, EDGE_SCALE, LEAST_SIGMA = 1.65, 0.9, 6.5, 2.0 / 3.0, 0.3

# Weights for two and four times the size, the upper triangle of a symmetric table of positions by positions.
UP2 = (-0.01716200, -0.03452303, -0.04022174, -0.02921014, -0.00624645, 0.14111091, 0.28896755, 0.00278718, -0.01610267, 0.56661550, 0.03777607, -0.01986694, -0.03144731, -0.01185068, -0.00213539)
UP4 = (
    -0.02419067, -0.03491987, -0.03693351, -0.03094285, -0.00529785, -0.01663432, -0.03556863, -0.03888905, -0.03516850, -0.00989469, 0.23651958, 0.33392945, -0.01073543, -0.01313181,
    -0.03556694, 0.13048175, 0.40103025, 0.03951150, -0.02077584, 0.46914198, -0.00209270, -0.01484589, -0.04064806, 0.18942530, 0.56279892, 0.06674400, -0.02335494, -0.03551682,
    -0.00754830, -0.02267919, -0.02363578, 0.00315804, -0.03399098, -0.01359519, -0.00091653, -0.00335467, -0.01163294, -0.01610294, -0.00974088, -0.00191622, -0.01095446, -0.03198464,
    -0.04455121, -0.02799790, -0.00645912, 0.06390599, 0.22963888, 0.00630981, -0.01897349, 0.67537268, 0.08483369, -0.02534994, -0.02205197, -0.01667999, -0.00384443,
)


def _copies(at: Column, size: Column, margin: int, side: int) -> Column:
    """Places that show a sample, its own and mirrored ones within the margin, each with the tiles that need it."""
    near = F.filter(F.concat(F.sequence(F.lit(-margin), F.lit(-1)), F.array(at), F.sequence(size, size + margin - 1)), lambda v: mirror(v, size) == at)
    places = F.when((at >= margin) & (at < size - margin), F.array(at)).otherwise(near)
    last = F.floor((size - 1) / side)
    tiles = lambda v: F.sequence(F.greatest(F.floor((v - margin) / side), F.lit(0)), F.least(F.floor((v + margin) / side), last))
    return F.flatten(F.transform(places, lambda v: F.transform(F.filter(tiles(v), lambda t: (v >= t * side - margin) & (v < t * side + side + margin) & (v < size + margin)), lambda t: F.struct(v.cast("int").alias("v"), t.cast("int").alias("t")))))


def tiled(df: DataFrame, planes: Sequence[str], margin: int, compute: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: Sequence[str], scale: int = 1, side: int = TILE) -> DataFrame:
    """image, x, y and out (doubles): compute over each tile of images (image, x, y, planes), which start at (0, 0).

    compute gets the planes as arrays with the tile's samples and margin more on each side, and returns arrays of scale times
    the tile's own size. Samples that are missing, and nulls, are NaN there, and a NaN that comes back is null. Rows without
    an image, x or y are left out, of rows that repeat a place one counts; a null image is none. Other columns are not read.
    """
    rows = df.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.col(p).cast("double").alias(p) for p in planes]).dropna(subset=["image", "x", "y"])
    sizes = rows.groupBy("image").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    placed = rows.join(sizes, "image").withColumn("_x", F.explode(_copies(F.col("x"), F.col("_w"), margin, side))).withColumn("_y", F.explode(_copies(F.col("y"), F.col("_h"), margin, side)))
    placed = placed.select("image", F.col("_x.t").alias("tx"), F.col("_y.t").alias("ty"), F.col("_x.v").alias("x"), F.col("_y.v").alias("y"), "_w", "_h", *planes)
    names = ["image", "x", "y", *out]
    kind = dict(df.dtypes)["image"]

    def run(tile: pa.Table) -> pa.Table:
        x0, y0 = (tile.column(c)[0].as_py() * side for c in ("tx", "ty"))
        width, height = min(side, tile.column("_w")[0].as_py() - x0), min(side, tile.column("_h")[0].as_py() - y0)
        at = (tile.column("y").to_numpy() - y0 + margin, tile.column("x").to_numpy() - x0 + margin)
        held = {}
        for p in planes:
            held[p] = np.full((height + 2 * margin, width + 2 * margin), np.nan)
            held[p][at] = tile.column(p).to_numpy(zero_copy_only=False)
        made = compute(held)
        ys, xs = np.divmod(np.arange(height * width * scale * scale), width * scale)
        columns = [pa.array([tile.column("image")[0].as_py()] * len(xs), tile.schema.field("image").type), pa.array((xs + x0 * scale).astype(np.int32)), pa.array((ys + y0 * scale).astype(np.int32))]
        return pa.table([*columns, *[pa.array(made[o].ravel(), from_pandas=True) for o in out]], names=names)

    return placed.groupBy("image", "tx", "ty").applyInArrow(run, ", ".join([f"`image` {kind}", "x int", "y int", *[f"`{o}` double" for o in out]]))


def _inner(a: np.ndarray, by: int, dx: int = 0, dy: int = 0) -> np.ndarray:
    """a without by samples on each side, moved by (dx, dy)."""
    return a[by + dy : a.shape[0] - by + dy, by + dx : a.shape[1] - by + dx]


def _smoothed(planes: list[np.ndarray], sigma: np.ndarray, edge: np.ndarray, taps: Sequence[tuple[int, int]], cross: bool, slope: float, scales: Sequence[float]) -> tuple[list[np.ndarray], int]:
    """One step, and the samples that it takes off each side."""
    reach, wide = max(max(map(abs, t)) for t in taps), int(cross)
    by = reach + wide
    own, flag = _inner(sigma, by), _inner(edge, by)
    total, sums = np.zeros_like(own), [np.zeros_like(own) for _ in planes]
    for dx, dy in taps:
        # Differences to the samples beside, then their sum over the patch.
        apart = sum(s * np.abs(_inner(p, reach) - _inner(p, reach, dx, dy)) for p, s in zip(planes, scales, strict=True))
        distance = sum(_inner(apart, wide, a, b) for a, b in CROSS) if cross else apart
        distance = distance * np.where(flag > 0, EDGE_SCALE, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(distance == 0, 1.0, np.maximum(0.0, 1.0 - distance * (slope * 4.0 * (1.0 - np.sqrt(0.5)) / own)))
        total = total + weight
        sums = [s + weight * _inner(p, by, dx, dy) for s, p in zip(sums, planes, strict=True)]
    return [np.where(own < LEAST_SIGMA, _inner(p, by), s / total) for s, p in zip(sums, planes, strict=True)], by


def edge_preserving(df: DataFrame, planes: Sequence[str], sigma: str, rounds: int = 3, scales: Sequence[float] = PLANE_SCALES, side: int = TILE) -> DataFrame:
    """image, x, y and planes, each sample the mean of its neighbours, weighted by how alike the patches around them are.

    rounds 1 is the step of four neighbours with patches of five, 2 adds one without patches, 3 begins with twelve neighbours; 0
    leaves all as it is. A weight falls with the patches' distance, over the planes by scales, the faster the smaller a sample's sigma, and
    more slowly at the edge of a block of 8; below LEAST_SIGMA a sample stays. Images mirror at the border. A null sample
    makes those null that it reaches.
    """
    steps = [(CROSS, True, SLOPE), (CROSS, False, SLOPE * THIRD_SCALE)][: min(rounds, 2)]
    steps = [(DIAMOND, True, SLOPE * FIRST_SCALE), *steps] if rounds > 2 else steps
    if not steps:
        return df.select("image", "x", "y", *[F.col(p).cast("double").alias(p) for p in planes])
    margin = sum(max(max(map(abs, t)) for t in taps) + int(cross) for taps, cross, _ in steps)
    rim = lambda c: F.pmod(F.col(c), F.lit(8)).isin(0, 7)

    def compute(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        now, s, e = [held[p] for p in planes], held["_sigma"], held["_edge"]
        for taps, cross, slope in steps:
            now, by = _smoothed(now, s, e, taps, cross, slope, scales)
            s, e = _inner(s, by), _inner(e, by)
        return dict(zip(planes, now, strict=True))

    rows = df.select("image", "x", "y", *planes, F.col(sigma).alias("_sigma"), (rim("x") | rim("y")).cast("double").alias("_edge"))
    return tiled(rows, [*planes, "_sigma", "_edge"], margin, compute, planes, side=side)


def phase_weights(weights: Sequence[float], factor: int) -> np.ndarray:
    """factor x factor x 5 x 5 (output row and column, window row and column) of a table's upper triangle.

    The table is symmetric over positions 5 k + i of the first half of the phases; the second half mirrors the window.
    """
    n = 5 * factor // 2
    if len(weights) != n * (n + 1) // 2:
        raise ValueError(f"{n * (n + 1) // 2} weights are needed")
    full = np.zeros((n, n))
    full[np.triu_indices(n)] = weights
    full = full + np.triu(full, 1).T
    place = np.array([[5 * k + i if k < factor // 2 else 5 * (factor - 1 - k) + 4 - i for i in range(5)] for k in range(factor)])
    return full[place[:, None, :, None], place[None, :, None, :]]


def upsample(df: DataFrame, factor: int, weights: Sequence[float] | None = None, side: int = TILE) -> DataFrame:
    """image, x, y, v of factor (2, 4 or 8) times the size: each output phase has its own 5 x 5 kernel, and no value leaves the window's range.

    weights is the table of `phase_weights`, by default UP2 or UP4; 8 needs one. Images mirror at the border. Larger factors
    are steps one after the other; cut the result to its size with `raster.crop`.
    """
    if factor not in (2, 4, 8):
        raise ValueError("the factor is 2, 4 or 8")
    table = weights if weights is not None else {2: UP2, 4: UP4}.get(factor)
    if table is None:
        raise ValueError("a factor of 8 needs weights")
    kernel = phase_weights(table, factor)

    def compute(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        window = np.lib.stride_tricks.sliding_window_view(held["v"], (5, 5))
        low, high = window.min(axis=(2, 3)), window.max(axis=(2, 3))
        out = np.empty((low.shape[0] * factor, low.shape[1] * factor))
        for a in range(factor):
            for b in range(factor):
                out[a::factor, b::factor] = np.clip(np.einsum("yxij,ij->yx", window, kernel[a, b]), low, high)
        return {"v": out}

    return tiled(df, ["v"], 2, compute, ["v"], factor, side)
