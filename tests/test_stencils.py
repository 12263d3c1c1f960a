"""Tiled stencils against plain loops over whole images, whatever the tiles."""

import math

import numpy as np
import pytest

from tessera.operators import stencils


def _at(k, n):
    k %= 2 * n
    return k if k < n else 2 * n - 1 - k


def _step(planes, sigma, taps, cross, slope):
    h, w = sigma.shape
    out = [p.copy() for p in planes]
    get = lambda p, x, y: p[_at(y, h), _at(x, w)]
    for y in range(h):
        for x in range(w):
            if sigma[y, x] < 0.3:
                continue
            total, sums = 0.0, [0.0] * len(planes)
            for dx, dy in taps:
                d = sum(s * abs(get(p, x + ix, y + iy) - get(p, x + dx + ix, y + dy + iy)) for p, s in zip(planes, stencils.PLANE_SCALES, strict=True) for ix, iy in (stencils.CROSS if cross else ((0, 0),)))
                d *= 2 / 3 if x % 8 in (0, 7) or y % 8 in (0, 7) else 1
                g = 1.0 if d == 0 else max(0.0, 1 - d * slope * 4 * (1 - math.sqrt(0.5)) / sigma[y, x])
                total += g
                sums = [a + g * get(p, x + dx, y + dy) for a, p in zip(sums, planes, strict=True)]
            for p, a in zip(out, sums, strict=True):
                p[y, x] = a / total
    return out


def _images():
    rng = np.random.default_rng(8)
    return {n: (rng.uniform(0, 0.05, (3, h, w)), rng.choice([0.1, 0.5, 4.0], (h, w))) for n, (w, h) in {"a": (11, 9), "b": (1, 1), "c": (2, 7), "d": (20, 3)}.items()}


def _rows(images):
    return [(n, x, y, *[float(v) for v in p[:, y, x]], float(s[y, x])) for n, (p, s) in images.items() for y in range(s.shape[0]) for x in range(s.shape[1])]


@pytest.mark.parametrize(("rounds", "side"), [(1, 4), (2, 256), (3, 4), (3, 1)])
def test_edge_preserving_whatever_the_tiles(spark, rounds, side):
    images = _images()
    df = spark.createDataFrame(_rows(images), "image string, x int, y int, a double, b double, c double, s double").withColumnRenamed("s", "sigma").repartition(3)
    got = {(r.image, r.x, r.y): (r.a, r.b, r.c) for r in stencils.edge_preserving(df, ["a", "b", "c"], "sigma", rounds, side=side).collect()}
    steps = ([(stencils.DIAMOND, True, 1.65 * 0.9)] if rounds > 2 else []) + [(stencils.CROSS, True, 1.65), (stencils.CROSS, False, 1.65 * 6.5)][: min(rounds, 2)]
    assert len(got) == len(_rows(images))
    for n, (planes, sigma) in images.items():
        now = list(planes)
        for taps, cross, slope in steps:
            now = _step(now, sigma, taps, cross, slope)
        for y in range(sigma.shape[0]):
            for x in range(sigma.shape[1]):
                assert got[n, x, y] == pytest.approx([p[y, x] for p in now], abs=1e-12)


def test_no_rounds_and_odd_rows(spark):
    df = spark.createDataFrame([("i", 0, 0, 1.0, 1.0), ("i", 1, 0, None, 1.0), (None, 0, 0, 1.0, 1.0), ("i", None, 0, 1.0, 1.0)], "image string, x int, y int, v double, s double")
    assert stencils.edge_preserving(df, ["v"], "s", 0).count() == 4
    assert [(r.x, r.v) for r in stencils.edge_preserving(df, ["v"], "s", 1, [1.0]).orderBy("x").collect()] == [(0, None), (1, None)]
    assert stencils.edge_preserving(df.limit(0), ["v"], "s", 1, [1.0]).count() == 0 and stencils.upsample(df.limit(0), 2).count() == 0


@pytest.mark.parametrize(("factor", "side"), [(2, 4), (2, 256), (4, 3), (8, 5)])
def test_upsampling_by_the_index_rule(spark, factor, side):
    rng = np.random.default_rng(factor)
    n = 5 * factor // 2
    table = {2: stencils.UP2, 4: stencils.UP4}.get(factor) or rng.uniform(-0.1, 0.2, n * (n + 1) // 2).tolist()
    images = _images()
    rows = [(i, x, y, float(p[0, y, x])) for i, (p, s) in images.items() for y in range(s.shape[0]) for x in range(s.shape[1])]
    got = {(r.image, r.x, r.y): r.v for r in stencils.upsample(spark.createDataFrame(rows, "image string, x int, y int, v double"), factor, table, side).collect()}
    assert len(got) == factor * factor * len(rows)
    for (i, x, y), v in got.items():
        p = images[i][0][0]
        px, kx, py, ky = x // factor, x % factor, y // factor, y % factor
        acc, window = 0.0, []
        for iy in range(5):
            for ix in range(5):
                s = p[_at(py + iy - 2, p.shape[0]), _at(px + ix - 2, p.shape[1])]
                j = iy + 5 * ky if ky < factor // 2 else 4 - iy + 5 * (factor - 1 - ky)
                k = ix + 5 * kx if kx < factor // 2 else 4 - ix + 5 * (factor - 1 - kx)
                lo, hi = min(j, k), max(j, k)
                acc += s * table[n * lo - lo * (lo - 1) // 2 + hi - lo]
                window.append(s)
        assert v == pytest.approx(min(max(acc, min(window)), max(window)), abs=1e-12)


def test_weights_of_each_phase_sum_to_one():
    for table, factor in ((stencils.UP2, 2), (stencils.UP4, 4)):
        assert np.allclose(stencils.phase_weights(table, factor).sum(axis=(2, 3)), 1.0, atol=1e-6)
    with pytest.raises(ValueError):
        stencils.phase_weights(stencils.UP2, 4)


def test_factors_that_are_not_there_raise(spark):
    df = spark.createDataFrame([], "image string, x int, y int, v double")
    for factor in (3, 8):
        with pytest.raises(ValueError):
            stencils.upsample(df, factor)
