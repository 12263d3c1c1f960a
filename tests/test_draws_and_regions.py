"""Draws against plain 64-bit loops, sketches against exact order statistics, covers against marked pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries_held_out as q
from tessera.functions import draws
from tessera.operators import sketches
from tessera.plans import regions

DATA = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mix(z):
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M
    z = (z ^ z >> 27) * 0x94D049BB133111EB & M
    return z ^ z >> 31


def lanes(seed0, seed1, n):
    states = []
    for seed in (seed0, seed1):
        z, own = mix(seed + 0x9E3779B97F4A7C15 & M), []
        for _ in range(8):
            own.append(z)
            z = mix(z)
        states.append(own)
    out = []
    for _ in range(n):
        out.append([a + b & M for a, b in zip(*states, strict=True)])
        for k in range(8):
            a, b = states[0][k], states[1][k]
            x = a ^ a << 23 & M
            states[0][k], states[1][k] = b, x ^ b ^ x >> 18 ^ b >> 5
    return out


def test_arithmetic_wraps(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), (1 << 63) - 1, (200, 2))] + [(-1, -1), (-(1 << 63), -(1 << 63)), ((1 << 63) - 1, 1), (0, 0)]
    factor = 0xBF58476D1CE4E5B9
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", draws.wrapping_add(F.col("a"), F.col("b")), draws.wrapping_mul(F.col("a"), factor), draws.split_mix(F.col("a"))).collect()
    assert [(r[2], r[3], r[4]) for r in got] == [(draws.signed(a + b), draws.signed((a & M) * factor), draws.signed(mix(a & M))) for a, b in pairs]


def test_lanes_jump_to_every_part(spark):
    seeds = [(5, 0, 1), (M, 77, 64), (123456789, 1 << 40, 65), (9, 9, 700), (1, 1, 0), (None, 1, 3)]
    df = spark.createDataFrame([(None if a is None else draws.signed(a), draws.signed(b), n) for a, b, n in seeds], "a long, b long, n long").repartition(3)
    got = {(r.a, r.b, r.lane, r.batch): r.draw for r in draws.lane_draws(df, "a", "b", "n").collect()}
    want = {(draws.signed(a), draws.signed(b), lane, k): draws.signed(v) for a, b, n in seeds if a is not None for k, batch in enumerate(lanes(a, b, n)) for lane, v in enumerate(batch)}
    assert got == want


def test_noise_of_the_tables(spark):
    rows = q.pixel_noise(spark, DATA).collect()
    groups, got = {}, {(r.part, r.channel, r.x, r.y): r.v for r in rows}
    for part in {r.part for r in rows}:
        groups[part] = ((part % 50) * 32, (part % 7) * 8, 5 + part % 17, 1 + part % 5)
    want = {}
    for part, (x0, y0, width, height) in groups.items():
        across = -(-width // 16)
        stream = iter(lanes((3 << 32) + 1, (x0 << 32) + y0, across * height * 3))
        for channel in range(3):
            for y in range(height):
                for left in range(0, width, 16):
                    bits = [h for lane in next(stream) for h in (lane & 0xFFFFFFFF, lane >> 32)]
                    for k in range(min(16, width - left)):
                        want[part, channel, x0 + left + k, y0 + y] = 1 + (bits[k] >> 9) / 2**23
    assert len(got) == len(rows) and got == want and len(groups) > 3


@pytest.mark.parametrize("masses", [[4096, 0], [1024] * 4, [4093, 1, 1, 1], [0, 0, 4096, 0], [7, 4000, 9, 80, 0, 0, 0, 0], [2048, 2048]])
def test_alias_tables_recover_masses(spark, masses):
    df = spark.createDataFrame([(masses,)], "m array<long>").withColumn("t", draws.alias_table(F.col("m")))
    rows = df.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda s: draws.alias_symbol(F.col("t"), s))).alias("e")).select("e.*").collect()
    offsets = {}
    for r in rows:
        offsets.setdefault(r.symbol, []).append(r.offset)
    assert {k: sorted(v) for k, v in offsets.items()} == {k: list(range(m)) for k, m in enumerate(masses) if m}


def test_alias_tables_of_a_wrong_sum_raise(spark):
    with pytest.raises(Exception, match="sum to the whole"):
        spark.createDataFrame([([1, 2],)], "m array<long>").select(draws.alias_table(F.col("m"))).collect()


def test_sketches_are_within_half_a_bin(spark):
    rng = np.random.default_rng(3)
    values = {g: rng.normal(m, s, n) for g, (m, s, n) in {"a": (0, 3, 900), "b": (-20, 1, 1), "c": (5, 0.01, 77)}.items()}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame([*rows, ("a", None), ("n", float("nan")), (None, 1.0)], "g string, v double")
    parts = [sketches.log_sketch(df.where(F.pmod(F.hash("v"), F.lit(3)) == k) if k < 2 else df.where(F.pmod(F.hash("v"), F.lit(3)) == 2), ["g"], F.col("v")) for k in range(3)]
    got = {r.g: r for r in sketches.sketch_quantiles(sketches.merged(parts, ["g"]), ["g"], {"lo": 0.1, "mid": 0.5, "hi": 0.99}).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, vs in values.items():
        for name, p in (("lo", 0.1), ("mid", 0.5), ("hi", 0.99)):
            assert abs(got[g][name] - sorted(vs)[int(min(p * len(vs), len(vs) - 1))]) <= sketches.WIDTH / 2 + 1e-9
    ends = spark.createDataFrame([(1, -1e9), (2, 1e9)], "g int, v double")
    assert [r.q for r in sketches.sketch_quantiles(sketches.log_sketch(ends, ["g"], F.col("v")), ["g"], {"q": 0.5}).orderBy("g").collect()] == [-46 + 0.0625, -46 + 511.5 * 0.125]


def test_covers_by_marked_pixels(spark):
    made, leaves = q.decided_regions(spark, DATA)
    nodes = {}
    for r in made.collect():
        nodes.setdefault(r.image, {})[r.path] = r
    paths = [a + b + c for a in "0123" for b in "0123" for c in "0123"]

    def region(image, leaf, rule):
        return next((leaf[:n] for n in range(3) if nodes[image][leaf[:n]][rule]), leaf)

    covers = {rule: regions.cover(made, leaves, ["image"], "path", rule) for rule in ("merged", "chosen")}
    for rule, df in covers.items():
        assert {(r.image, r.path) for r in df.collect()} == {(i, region(i, p, rule)) for i in nodes for p in paths}
    got = {r.image: (r.same, r.area) for r in regions.covered_agreement(covers["merged"], covers["chosen"], ["image"]).collect()}
    for i in nodes:
        assert got[i] == (pytest.approx(sum(region(i, p, "merged") == region(i, p, "chosen") for p in paths) / 64), pytest.approx(1.0))
    assert any(s < 1 for s, _ in got.values())


def test_regions_without_rows_and_uneven_trees(spark):
    leaves = spark.createDataFrame([(None, "0", 3.0), (None, "10", 1.0), (None, "11", None), ("x", "", 2.0)], "g string, path string, cost double")
    singles = spark.createDataFrame([(None, "", 3.5), (None, "1", None)], "g string, path string, single double")
    rule = lambda split, whole: whole < split
    got = {(r.g, r.path): (r.split_cost, r.merged, r.chosen, r.cost, r.regret) for r in regions.region_decisions(leaves, singles, ["g"], "path", "cost", "single", rule).collect()}
    assert got == {(None, "1"): (1.0, False, False, 1.0, 0.0), (None, ""): (4.0, True, True, 3.5, 0.0)}
    assert regions.region_decisions(leaves.limit(0), singles, ["g"], "path", "cost", "single", rule).count() == 0
    assert math.isclose(2.0, leaves.where("g = 'x'").first().cost)
