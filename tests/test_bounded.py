"""Costs given up early against a loop over candidates, and plain factors against every choice."""

import numpy as np
from pyspark.sql import functions as F

from tessera.plans import bounded


def _loop(rows):
    """Candidates (name, bounds, costs) of one group, the lowest bound first."""
    cut, out = None, {}
    for name, bounds, costs in sorted(rows, key=lambda r: (sum(r[1]), r[0])):
        done = next((k for k in range(len(costs)) if cut is not None and sum(costs[:k]) + sum(bounds[k:]) >= cut), len(costs))
        total = sum(costs)
        out[name] = (done, total if done == len(costs) and (cut is None or total < cut) else None)
        cut = total if cut is None else min(cut, total)
    return out


def test_same_as_a_loop_and_the_least_stays(spark):
    rng = np.random.default_rng(9)
    groups = {}
    for g in range(40):
        groups[g] = []
        for k in range(int(rng.integers(1, 12))):
            costs = rng.integers(0, 40, 3).astype(float)
            groups[g].append((k, [float(np.floor(c * f)) for c, f in zip(costs, rng.uniform(0, 1, 3), strict=True)], costs.tolist()))
    rows = [(g, k, *b, *c) for g, own in groups.items() for k, b, c in own]
    df = spark.createDataFrame([*rows, (None, 0, None, 1.0, 2.0, 3.0, None, 2.0)], "g int, k int, b0 double, b1 double, b2 double, c0 double, c1 double, c2 double").repartition(3)
    got = bounded.bounded_costs(df, ["g"], ["k"], [("b0", "c0"), ("b1", "c1"), ("b2", "c2")])
    seen = {}
    for r in got.collect():
        seen.setdefault(r.g, {})[r.k] = (r.parts_done, r.cost)
    assert {g: v for g, v in seen.items() if g is not None} == {g: _loop(own) for g, own in groups.items()}
    assert seen[None] == {0: (3, 5.0)}
    sums = {r.g: r for r in bounded.bounded_summary(got, ["g"], 3).collect()}
    assert all(sums[g].best == min(sum(c) for _, _, c in own) and not sums[g].unsafe for g, own in groups.items())
    assert sum(r.skipped for r in sums.values()) > 0 and sums[None].unsafe == 1
    assert bounded.bounded_costs(df.where(F.lit(False)), ["g"], ["k"], [("b0", "c0")]).count() == 0
