"""Fits without a part against refits of the other rows, and routes against a plain statement of the rule."""

import math

import numpy as np
import pytest

from tessera import queries_held_out as q
from tessera.operators import models, training

DATA = "/root/testdata/sf0.001"


def _ridge(x, y, w, penalty=1e-3):
    a = np.c_[np.ones(len(x)), x]
    return np.linalg.solve((a * w[:, None]).T @ a + np.diag([0.0] + [penalty] * x.shape[1]), (a * w[:, None]).T @ y)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for k in range(240):
        f = None if k % 11 == 0 else ("big" if k % 3 == 0 else f"f{k % 5}")
        x = rng.standard_normal(2)
        out.append((f, float(x[0]), float(x[1]), float(2 + x[0] - 3 * x[1] + 0.3 * rng.standard_normal()), float(rng.uniform(0.5, 2))))
    return out


def test_fits_without_a_family_are_refits(spark, rows):
    df = spark.createDataFrame([*rows, ("big", None, 1.0, 2.0, 1.0), ("f1", 1.0, 1.0, None, 1.0)], "f string, a double, b double, y double, w double")
    got = {r.f: (r.n, r.w) for r in training.held_out_ridge(df, "f", ["a", "b"], "y", "w").collect()}
    assert set(got) == {r[0] for r in rows}
    for f, (n, w) in got.items():
        rest = [r for r in rows if r[0] != f]
        m = np.array([r[1:] for r in rest])
        assert n == len(rest)
        assert np.allclose(w, _ridge(m[:, :2], m[:, 2], m[:, 3]), atol=1e-9)


def test_one_family_has_no_fit(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0)], "f string, x double, y double")
    assert [tuple(r) for r in training.held_out_ridge(df, "f", ["x"], "y").collect()] == [("a", 0, None)]
    assert training.held_out_ridge(df.limit(0), "f", ["x"], "y").count() == 0
    assert training.quantile_fits(df, ["x"], "y", {"m": 0.5}, "f").count() == 0


def test_quantile_fits_without_a_part_are_refits(spark, rows):
    df = spark.createDataFrame(rows, "f string, a double, b double, y double, w double")
    quantiles = {"low": 0.1, "high": 0.9}
    got = {(r.f, r["quantile"]): r.w for r in training.quantile_fits(df, ["a", "b"], "y", quantiles, "f", "w", rounds=5).collect()}
    assert len(got) == 2 * len({r[0] for r in rows})
    for (f, name), w in got.items():
        m = np.array([r[1:] for r in rows if r[0] != f])
        assert np.allclose(w, models.fit_quantile(m[:, :2], m[:, 2], quantiles[name], m[:, 3], rounds=5), atol=1e-7)
    alone = {r["quantile"]: r.w for r in training.quantile_fits(df, ["a", "b"], "y", quantiles, weight="w", rounds=5).collect()}
    m = np.array([r[1:] for r in rows])
    assert np.allclose(alone["low"], models.fit_quantile(m[:, :2], m[:, 2], 0.1, m[:, 3], rounds=5), atol=1e-7)


def test_too_many_parts_raise(spark):
    df = spark.range(100).selectExpr("id", "double(id) AS x", "double(id) AS y")
    with pytest.raises(ValueError):
        training.quantile_fits(df, ["x"], "y", {"m": 0.5}, "id")


def _loss(s):
    return math.log(max(100.0 - s, 1e-3))


def _score(curve, s):
    if s <= curve[0][0]:
        return curve[0][1]
    if s >= curve[-1][0]:
        return curve[-1][1]
    (s0, v0), (s1, v1) = next((a, b) for a, b in zip(curve, curve[1:], strict=False) if a[0] <= s <= b[0])
    t = (math.log(s) - math.log(s0)) / (math.log(s1) - math.log(s0))
    return 100.0 - math.exp(_loss(v0) + t * (_loss(v1) - _loss(v0)))


def _ratio(near, own, scale):
    p = sorted((n["scale"], n["size"]) for n in near if n["size"])
    if len(p) < 2 or not own:
        return None
    x, xs, ys = math.log(scale), [math.log(a) for a, _ in p], [math.log(b) for _, b in p]
    i = 0 if x <= xs[0] else len(xs) - 2 if x >= xs[-1] else next(j for j in range(len(xs) - 1) if xs[j] <= x <= xs[j + 1])
    return math.exp(ys[i] + (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) * (x - xs[i])) / own


def test_routes_of_the_tables_follow_the_rule(spark):
    cases = q.label_cases(spark, DATA)
    every = [r.asDict() for r in cases.where("state <> 'censored'").collect()]
    got = {(r.user_id, r.target): r for r in q.train_held_out_routes(spark, DATA).collect()}
    assert len(got) == len(every) > 30
    clamp = lambda v: min(max(v, 0.0), 16.0)
    seen = set()
    for part in {r["family"] for r in every}:
        rest = [r for r in every if r["family"] != part]
        count = {f: sum(r["family"] == f for r in rest) for f in {r["family"] for r in rest}}
        x = np.array([[r["z0"], r["z1"], r["zt"]] for r in rest])
        w = np.array([1 / count[r["family"]] for r in rest])
        y = np.array([math.log(r["crossing"]) for r in rest])
        fit = {n: models.fit_quantile(x, y, tau, w, rounds=q._ROUNDS) for n, tau in q._QUANTILES.items()}
        known = [k for k, r in enumerate(rest) if r["beta"]]
        beta = _ridge(x[known], np.array([math.log(rest[k]["beta"]) for k in known]), np.ones(len(known)))
        lo, hi = x.min(axis=0), x.max(axis=0)
        for r in (r for r in every if r["family"] == part):
            z = np.array([r["z0"], r["z1"], r["zt"]])
            ln = {n: clamp(b[0] + b[1:] @ z) for n, b in fit.items()}
            b = min(max(math.exp(beta[0] + beta[1:] @ z), 0.2), 3.0)
            first, curve = math.exp(ln["candidate"]), [(p["scale"], p["score"]) for p in r["curve"]]
            ok, shown = first >= r["crossing"], _score(curve, first)
            far = bool(((z < lo - 0.25 * np.maximum(hi - lo, 1e-6)) | (z > hi + 0.25 * np.maximum(hi - lo, 1e-6))).any())
            to = math.exp(clamp(ln["candidate"] + (_loss(shown) - _loss(r["target"] + 0.25)) / b))
            if far or ln["upper"] - ln["lower"] > 0.405465:
                want = ("fallback_preflight", 4, 1.0)
            elif ok and shown - r["target"] > 1.0:
                want = ("tightened", 2, _ratio(r["neighbours"], r["label_bytes"], to)) if to >= r["crossing"] else ("tighten_kept_first", 2, _ratio(r["neighbours"], r["label_bytes"], first))
            elif ok:
                want = ("one_shot", 1, _ratio(r["neighbours"], r["label_bytes"], first))
            else:
                want = ("corrected", 2, _ratio(r["neighbours"], r["label_bytes"], to)) if to >= r["crossing"] else ("fallback_exact", 6, 1.0)
            has = got[r["user_id"], r["target"]]
            assert (has.route, has.work, has.success) == (*want[:2], ok)
            assert has.error == pytest.approx(ln["median"] - math.log(r["crossing"]), abs=2e-5)
            assert has.observed == pytest.approx(shown, abs=2e-4)
            assert (has.ratio is None) == (want[2] is None) and (has.ratio is None or has.ratio == pytest.approx(want[2], rel=1e-4))
            seen.add(has.route)
    assert seen
    whole = q.train_route_summary(spark, DATA).collect()[0]
    errors = sorted(abs(r.error) for r in got.values())
    assert whole["rows"] == len(errors)
    assert whole.p90_abs == pytest.approx(errors[min(int(0.9 * (len(errors) - 1) + 0.9999), len(errors) - 1)], abs=2e-5)


def test_routes_reach_every_branch(spark):
    curve = [{"scale": 10.0, "score": 10.0}, {"scale": 100.0, "score": 30.0}, {"scale": 1000.0, "score": 60.0}]
    near = [{"scale": 90.0, "rung": 1, "score": 1.0, "size": 900.0}, {"scale": 110.0, "rung": 1, "score": 1.0, "size": 1000.0}]
    base = dict(target=30.0, crossing=100.0, neighbours=near, label_bytes=1000.0, curve=curve, outside=False, ln_median=math.log(100), ln_lower=1.0, ln_upper=1.2, ln_beta=0.0)
    cases = [
        base | {"ln_candidate": math.log(101)}, base | {"ln_candidate": math.log(900), "ln_beta": math.log(3)}, base | {"ln_candidate": math.log(900), "ln_beta": math.log(0.2)}, base | {"ln_candidate": math.log(99), "ln_beta": math.log(0.2)},
        base | {"ln_candidate": math.log(99), "ln_beta": math.log(3)}, base | {"ln_candidate": math.log(60), "outside": True}, base | {"ln_candidate": math.log(101), "ln_upper": 2.0}, base | {"ln_candidate": math.log(101), "curve": None},
    ]
    near_type = "array<struct<scale: double, rung: int, score: double, size: double>>"
    schema = f"target double, crossing double, neighbours {near_type}, label_bytes double, curve array<struct<scale: double, score: double>>, outside boolean, ln_median double, ln_lower double, ln_upper double, ln_beta double, ln_candidate double"
    order = [c.split()[0] for c in schema.replace("struct<scale: double, rung: int, score: double, size: double>", "s").replace("struct<scale: double, score: double>", "s").split(", ")]
    got = training.routes(spark.createDataFrame([tuple(c[n] for n in order) for c in cases], schema)).collect()
    assert [r.route for r in got] == ["one_shot", "tightened", "tighten_kept_first", "corrected", "fallback_exact", "fallback_preflight", "fallback_preflight", None]
    assert [r.work for r in got] == [1, 2, 2, 2, 6, 4, 4, None]


def test_train_table_of_the_tables(spark):
    cases = [r.asDict() for r in q.label_cases(spark, DATA).collect()]
    got = {r.target: r for r in q.train_table(spark, DATA).collect()}
    assert set(got) == {10.0, 20.0, 35.0}
    open_ = [r for r in cases if r["state"] != "censored"]
    count = {f: sum(r["family"] == f for r in open_) for f in {r["family"] for r in open_}}
    x = np.array([[r["z0"], r["z1"], r["zt"], r["zt"] * r["z0"]] for r in open_])
    w = np.array([1 / count[r["family"]] for r in open_])
    b = models.fit_quantile(x, np.array([math.log(r["crossing"]) for r in open_]), 0.9, w, rounds=q._ROUNDS)
    for t, r in got.items():
        xt = _loss(t) - 3.0
        assert r.candidate == pytest.approx([b[0] + b[3] * xt, b[1] + b[4] * xt, b[2]], abs=1e-4)
        assert (r["rows"], r.censored) == (sum(c["target"] == t for c in open_), sum(c["target"] == t and c["state"] == "censored" for c in cases))
        assert len(r.saturation) == 3 and len(r.beta) == 3
