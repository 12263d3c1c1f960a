"""Rungs and scales."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import ladder


def _every():
    """Scales of all rungs up to the tenth factor, by walking the ladder."""
    out = []
    for k in range(1, 11):
        out += [g * k for g in range((k - 1) * ladder.MOST_SCALE // k + 1, ladder.MOST_SCALE + 1)]
    return out


def test_rungs_and_scales_are_inverse(spark):
    scales = _every()
    assert all(a < b for a, b in zip(scales, scales[1:], strict=False))
    rungs = sorted({*range(0, len(scales), 997), 0, 1, 73_727, 73_728, 73_729, 110_591, 110_592, len(scales) - 1})
    df = spark.createDataFrame([(r,) for r in [*rungs, -4, 10**9, None]], "r long").select("r", ladder.effective_scale(F.col("r")).alias("s"))
    got = {r.r: (r.s, r.back) for r in df.withColumn("back", ladder.rung_for_scale(F.col("s"))).collect()}
    assert {r: got[r] for r in rungs} == {r: (scales[r], r) for r in rungs}
    assert got[-4] == (1, 0) and got[10**9] == (ladder.MOST_SCALE * ladder.MOST_FACTOR, ladder.RUNGS - 1) and got[None] == (None, None)


def test_scales_between_and_odd_ones(spark):
    from bisect import bisect_right

    scales = _every()
    between = [1.4, 1.5, 73_728.6, 73_729.0, 73_730.0, 2 * 73_728 - 1.0, 2 * 73_728 + 1.0, 500_001.0, 700_000.4]
    odd = [0.0, -3.0, 1e30, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in between + odd], "v double")
    got = [r.r for r in df.select(ladder.rung_for_scale(F.col("v")).alias("r")).collect()]
    assert got[: len(between)] == [bisect_right(scales, int(v + 0.5)) - 1 for v in between]
    assert got[len(between) :] == [0, 0, ladder.RUNGS - 1, 0, 0, None]


def test_bands_and_unions(spark):
    t = spark.createDataFrame([(50.0,), (99.9,)], "t double")
    assert [r.b for r in t.select(ladder.met_band(F.col("t"), 0.05, 2.0).alias("b")).collect()] == pytest.approx([5.0, 1.0])
    out = ladder.curve_union({"a": t, "b": t.withColumn("u", F.lit(1)), "c": t.limit(0)})
    assert sorted((r.source, r.t, r.u) for r in out.collect()) == [("a", 50.0, None), ("a", 99.9, None), ("b", 50.0, 1), ("b", 99.9, 1)]
    with pytest.raises(ValueError):
        ladder.curve_union({})
