"""Reductions of many groups against a plain loop for each, and median cut against one box after the other."""

import math

import numpy as np
import pytest

from tessera import queries_held_out as q
from tessera.operators import reduction

DATA = "/root/testdata/sf0.001"


def key(bits, loss):
    return bits * 2**20 // max(1, int(max(loss, 0.0) * 2**24)) if bits > 0 else 0


def plain(chains, room, initial=8, least=1, most=512, share=0.0, floor=0.0, max_rounds=16, max_tries=32):
    """One group: chains of (bits, loss), from the front."""
    at, batch = dict.fromkeys(chains, 0), max(initial, 1)
    applied = saved = rounds = tries = back = 0
    lost = 0.0
    while rounds < max_rounds and tries < max_tries:
        open_ = sorted(((-key(*chains[c][k]), c) for c, k in at.items() if k < len(chains[c])), key=lambda e: (e[0], (e[1] is not None, e[1])))
        if not open_:
            break
        bound = math.floor(-open_[0][0] * floor)
        open_ = [c for k, c in open_ if chains[c][at[c]][0] > 0 and -k >= bound]
        if not open_:
            break
        if rounds == 0 and share > 0:
            batch = max(1, min(max(int(len(open_) * share), initial), most))
        hit = False
        while tries < max_tries:
            some = open_[:batch]
            cost = lost + sum(chains[c][at[c]][1] for c in some)
            tries += 1
            if cost <= room:
                rounds, applied, lost, hit = rounds + 1, applied + len(some), cost, True
                for c in some:
                    saved += chains[c][at[c]][0]
                    at[c] += 1
                batch = min(batch * 2, max(most, 1))
                break
            back += len(some)
            if batch <= max(least, 1):
                break
            batch = max(batch // 2, max(least, 1))
        if not hit:
            break
    return applied, saved, round(lost, 6), rounds, tries, back


def _got(df, by):
    return {r[by]: (r.applied, r.bits_saved, round(r.lost, 6), r.rounds, r.tries, r.rolled_back) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"initial": 4, "least": 2, "most": 16, "share": 0.3, "floor": 0.2, "max_rounds": 3, "max_tries": 6}])
def test_groups_advance_as_in_a_loop(spark, options):
    rng = np.random.default_rng(2)
    rows, groups = [], [(None, 3.0), ("none", 1.0), ("zero", 0.0)]
    groups += [(f"g{k}", float(rng.uniform(0, 6))) for k in range(12)]
    for g, _ in groups:
        if g != "none":
            rows += [(g, int(c), int(k), int(rng.integers(-3, 40)), float(rng.integers(1, 65)) / 64) for c in range(int(rng.integers(1, 14))) for k in range(int(rng.integers(1, 9)))]
    rows += [("zero", 99, 0, None, 0.5), ("zero", 98, 0, 5, None), ("stranger", 1, 1, 5, 0.5), ("g0", None, 0, 7, 0.25)]
    edits = spark.createDataFrame(rows, "g string, c int, k int, bits int, loss double").repartition(3)
    got = _got(reduction.terminal_reduction(edits, spark.createDataFrame(groups, "g string, room double"), ["g"], ["c"], "k", "bits", "loss", "room", **options), "g")
    want = {}
    for g, room in groups:
        chains = {}
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            chains.setdefault(r[1], []).append((r[3] or 0, r[4] or 0.0))
        want[g] = plain(chains, room, **options)
    assert got == want


def test_reduction_of_the_tables(spark):
    edits, groups = q.removals(spark, DATA)
    chains = {}
    for r in sorted(edits.collect(), key=lambda r: r.place):
        chains.setdefault(r.l_suppkey, {}).setdefault(r.chain, []).append((r.bits, r.loss))
    want = {g.l_suppkey: plain(chains.get(g.l_suppkey, {}), g.room, **q.REDUCTION) for g in groups.collect()}
    got = _got(q.reduce_terminal(spark, DATA), "l_suppkey")
    assert got == want and any(w[3] > 1 for w in want.values())


def cut(colours, k):
    """One group: {(r, g, b): weight} to its palette, box after box."""
    if len(colours) <= k:
        return {c: c for c in colours}
    boxes = [list(colours.items())]
    spans = lambda b: [max(c[a] for c, _ in b) - min(c[a] for c, _ in b) for a in range(3)]
    while len(boxes) < k:
        able = [i for i, b in enumerate(boxes) if len(b) > 1]
        if not able:
            break
        i = max(able, key=lambda i: (sum(spans(boxes[i])), -i))
        s = spans(boxes[i])
        axis = s.index(max(s))
        box = sorted(boxes[i], key=lambda e: (e[0][axis], e[0]))
        half, run, split = sum(w for _, w in box) // 2, 0, 1
        for j, (_, w) in enumerate(box):
            run += w
            if run >= half:
                split = j + 1
                break
        split = max(1, min(split, len(box) - 1))
        boxes[i] = box[:split]
        boxes.append(box[split:])
    entries = []
    for b in boxes:
        w = sum(x for _, x in b)
        entries.append(tuple((sum(c[a] * x for c, x in b) + w // 2) // w for a in range(3)))
    return {c: min(enumerate(entries), key=lambda e: (sum((c[a] - e[1][a]) ** 2 for a in range(3)), e[0]))[1] for c in colours}


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_boxes_are_cut_in_order(spark, k):
    rng = np.random.default_rng(k)
    groups = {"few": {(1, 2, 3): 4, (1, 2, 4): 1}, "grey": {(v, v, v): 1 for v in range(0, 256, 5)}, None: {(v, 0, 0): 1 if v else 1000 for v in range(9)}}
    for n in range(6):
        groups[f"g{n}"] = {tuple(int(x) for x in rng.integers(0, 1 + 40 * (n + 1), 3)): int(rng.integers(1, 50)) for _ in range(70)}
    rows = [(g, *c, w) for g, cs in groups.items() for c, w in cs.items()]
    colours = spark.createDataFrame([*rows, ("few", None, 1, 1, 3)], "p string, r int, g int, b int, n int").repartition(3)
    got = reduction.remapped(colours.dropna(subset=["r"]), reduction.median_cut(colours, ["p"], "n", k), ["p"]).collect()
    assert {(r.p, r.r, r.g, r.b): (r.p_r, r.p_g, r.p_b) for r in got} == {(g, *c): e for g, cs in groups.items() for c, e in cut(cs, max(k, 2)).items()}


def test_no_colours(spark):
    assert reduction.median_cut(spark.createDataFrame([], "p string, r int, g int, b int, n int"), ["p"], "n", 4).count() == 0


def test_palettes_of_the_tables(spark):
    pixels, counts = q.colour_counts(spark, DATA)
    groups = {}
    for r in counts.collect():
        groups.setdefault(r.picture, {})[r.r, r.g, r.b] = r.n
    want = {p: cut(c, 12) for p, c in groups.items()}
    got = q.raster_median_cut(spark, DATA).collect()
    assert len(got) == pixels.count()
    assert all(want[r.picture][r.r, r.g, r.b] == (r.p_r, r.p_g, r.p_b) for r in got)
