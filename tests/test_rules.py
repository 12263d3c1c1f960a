"""Operators against plain statements of their rules, and functions that no query reaches."""

import collections
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, pixel, text
from tessera.operators import corpus, curves, entropy, metrics, models, order, raster, reports, sequences, stats, trees
from tessera.sources import files, records
from tessera.streaming import bursts


def test_prefix_sums_of_hot_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {r.k: (r.s, r.s_all, r.i) for r in order.row_numbers(order.prefix_sums(df, ["g"], [F.desc("k")], {"s": F.col("v")}), ["g"], [F.desc("k")], "i").collect()}
    for g in ("hot", "a", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        total, before = sum(r[2] for r in own), 0
        for i, r in enumerate(own):
            assert got[r[1]] == (before, total, i + 1)
            before += r[2]
    last = {r.k: r.before_v for r in order.previous(df, ["g"], ["k"], ["v"]).collect()}
    for g in ("hot", "a", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        assert [last[r[1]] for r in own] == [None, *[r[2] for r in own[:-1]]]
    assert order.prefix_sums(df.limit(0), [], [F.col("k")], {"s": F.col("v")}).count() == 0


def test_order_statistics_with_ties_nulls_and_nan(spark):
    rows = [("a", v) for v in [3.0, 1.0, 1.0, 2.0, float("nan")]] + [("a", None), ("b", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r[1:] for r in stats.summary(df, ["g"], "v").collect()}
    assert got == {"a": (1.0, 1.5, 3.0, 3.0, 3.0), "b": (None,) * 5, None: (5.0,) * 5}
    with pytest.raises(Exception, match="without values"):
        stats.summary(df, ["g"], "v", strict=True).collect()
    assert stats.linear_quantiles(df.where("g = 'b'"), ["g"], "v", [0.5], 0.0).first().q50 == 0.0


def test_inversions_like_all_pairs(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(12), rng.choice([1.0, 2.0, 3.5, -1.0])) for g in range(4) for _ in range(30)] + [(9, 1, 2.0), (8, 1, None)]
    got = {r.g: r.pairs for r in curves.non_monotone_pairs(spark.createDataFrame(rows, "g int, x int, y double"), ["g"], "x", "y").collect()}
    want = {g: sum(a[1] < b[1] and b[2] < a[2] for a, b in itertools.permutations([r for r in rows if r[0] == g], 2)) for g in (0, 1, 2, 3, 9)}
    assert got == want


def test_self_correcting_guess_place_by_place():
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (3, 5, 7))
    log2 = lambda n: n.bit_length() - 1
    for image in v.tolist():
        h, w = len(image), len(image[0])
        te, err, want = {}, {}, []
        for y, x in itertools.product(range(h), range(w)):
            at = lambda b, a, image=image, w=w: image[b][a] if 0 <= b and 0 <= a < w else None
            west = at(y, x - 1) if x else (at(y - 1, x) or 0)
            north = at(y - 1, x) if y else west
            nw, ne, nn = (at(y - 1, x - 1) if x and y else west), (at(y - 1, x + 1) if y and x + 1 < w else north), (at(y - 2, x) if y > 1 else north)
            tw, tn = te.get((y, x - 1), 0), te.get((y - 1, x), 0)
            tnw, tne = te.get((y - 1, x - 1), tn), te.get((y - 1, x + 1), tn)
            subs = [8 * (west + ne - north), 8 * north - ((tw + tn + tne) * 16 >> 5), 8 * west - ((tw + tn + tnw) * 10 >> 5), 8 * north - ((tnw + tn + tne) * 7 >> 5)]
            weights = []
            for i, most in enumerate((13, 12, 12, 12)):
                e = lambda b, a, i=i, err=err: err[b, a][i] if (b, a) in err else None
                n_ = e(y - 1, x) or 0
                total = n_ + (e(y, x - 1) or 0) + (n_ if e(y - 1, x - 1) is None else e(y - 1, x - 1)) + (e(y, x - 2) or 0) + (n_ if e(y - 1, x + 1) is None else e(y - 1, x + 1))
                total += (e(y, x - 1) or 0) if x == w - 1 else 0
                shift = max(log2(total + 1) - 5, 0)
                weights.append(4 + (most * ((1 << 24) // ((total >> shift) + 1)) >> shift))
            down = max(log2(sum(weights)) - 4, 0)
            weights = [k >> down for k in weights]
            share = sum(weights)
            guess = ((share >> 1) - 1 + sum(a * b for a, b in zip(subs, weights, strict=True))) * ((1 << 24) // share) >> 24
            if ((tn ^ tw) | (tn ^ tnw)) <= 0:
                guess = min(max(guess, 8 * min(west, north, ne)), 8 * max(west, north, ne))
            te[y, x] = guess - 8 * image[y][x]
            err[y, x] = [abs(s - 8 * image[y][x]) + 3 >> 3 for s in subs]
            want.append(guess)
        assert sequences.weighted_guesses(np.array([image]))[0].ravel().tolist() == want


def test_self_correcting_of_mixed_shapes(spark):
    rows = [(i, x, y, (x * 7 + y * 3 + i) % 11) for i, (w, h) in enumerate([(4, 3), (2, 5), (4, 3)]) for y in range(h) for x in range(w)]
    out = sequences.self_correcting(spark.createDataFrame(rows, "image int, x int, y int, v bigint"))
    assert sorted((r.image, r.x, r.y, r.v) for r in out.collect()) == sorted(rows)


def test_blur_keeps_constants_inside_and_is_zero_padded(spark):
    df = spark.createDataFrame([(0, x, y, 1.0) for x in range(12) for y in range(12)], "image int, x int, y int, v double")
    got = {(r.x, r.y): r.v for r in sequences.blur(df).collect()}
    assert got[6, 6] == pytest.approx(1.0) and got[0, 0] == pytest.approx(((1 + sequences.blur_taps()[0]) / 2) ** 2)


def test_histograms_are_normalised_by_remainders(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate([1, 1, 10_000, 3])] + [("b", 5, 7)] + [("c", k, 1 if k else 10**9) for k in range(3000)] + [("z", 0, 0)], "c string, v int, n bigint")
    rows = entropy.normalised(df, ["c"], "v").collect()
    per = collections.defaultdict(dict)
    for r in rows:
        per[r.c][r.v] = r.p
    assert per["b"] == {5: 4096} and "z" not in per
    for own in per.values():
        assert sum(own.values()) == 4096 and min(own.values()) >= 1
    assert per["c"][0] == 4096 - 2999 and per["a"][2] == 4093
    with pytest.raises(Exception, match="units of probability"):
        entropy.normalised(spark.range(5000).select(F.lit("q").alias("c"), F.col("id").alias("v"), F.lit(1).alias("n")), ["c"], "v").collect()


def test_clusters_like_trying_all_pairs(spark):
    rng = random.Random(8)
    table = {c: [rng.choice([0, 1, 5, 40]) + (c % 3 == k % 3) * 60 for k in range(6)] for c in range(12)}
    df = spark.createDataFrame([(c, k, n) for c, r in table.items() for k, n in enumerate(r) if n], "c int, v int, n bigint")
    cost = lambda r: sum(r) * math.log2(sum(r)) - sum(n * math.log2(n) for n in r if n)
    rows, names = [list(map(float, r)) for r in table.values()], [[c] for c in table]
    while len(rows) > 1:
        best = max((round(cost(rows[i]) + cost(rows[j]) + 6 - cost([a + b for a, b in zip(rows[i], rows[j], strict=True)]), 9), -i, -j) for i in range(len(rows)) for j in range(i + 1, len(rows)))
        if best[0] <= 0 and len(rows) <= 4:
            break
        i, j = -best[1], -best[2]
        rows[i], names[i] = [a + b for a, b in zip(rows[i], rows[j], strict=True)], names[i] + names[j]
        del rows[j], names[j]
    got = {r.c: r.cluster for r in entropy.cluster(df, "c", "v", 4).collect()}
    assert got == {c: k for k, own in enumerate(names) for c in own}
    assert entropy.cluster(df.limit(0), "c", "v").count() == 0


def test_logistic_like_small_steps(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    weight = rng.uniform(0.5, 2, 300)
    rows = [("a", *map(float, r), float(t), float(k)) for r, t, k in zip(x, y, weight, strict=True)] + [("one", 1.0, 2.0, 1.0, 1.0)] * 3 + [(None, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, p double, q double, y double, k double")
    got = {r.g: r.w for r in models.logistic(df, ["g"], ["p", "q"], "y", "k").collect()}
    assert got["one"] == [6.0, 0.0, 0.0] and got[None] == [-6.0, 0.0, 0.0]
    w, a = np.zeros(3), np.c_[np.ones(300), x]
    for _ in range(4000):
        g = a.T @ (weight / weight.sum() * (1 / (1 + np.exp(-a @ w)) - y)) + 1e-3 / weight.sum() * np.r_[0, w[1:]]
        w -= 0.5 * g
    assert got["a"] == pytest.approx(w, abs=1e-3)


def test_bd_rate_is_the_fits_and_takes_the_last_of_a_quality(spark):
    rng = np.random.default_rng(4)
    rows = [("i", arm, k, float(np.exp(3 + q / 30 + rng.normal(0, 0.05) + (arm == "t") * 0.2)), float(q)) for k, (arm, q) in enumerate(itertools.product("rt", (30, 41, 52, 63, 77, 85)))]
    again = [("i", "r", -1, 999.0, 30.0), ("i", "r", 99, 20.5, 30.0), ("i", "t", 5, 0.0, 10.0)]
    df = spark.createDataFrame(rows + again, "i string, arm string, k int, rate double, q double")
    got = {curves.bd_rate(d, ["i"], "arm", "r", "t", "rate", "q", ["k"]).first().bd_rate for d in (df, df.orderBy(F.desc("k")), df.repartition(3))}
    assert len({round(g, 9) for g in got}) == 1
    last = {arm: {} for arm in "rt"}
    for _, arm, _, rate, q in sorted(rows + again, key=lambda r: r[2]):
        if rate > 0:
            last[arm][q] = rate
    area = []
    for arm in "rt":
        whole = np.polynomial.Polynomial.fit(list(last[arm]), np.log10(list(last[arm].values())), 3).integ()
        area.append((whole(85) - whole(30)) / 55)
    assert got.pop() == pytest.approx((10 ** (area[1] - area[0]) - 1) * 100, rel=1e-6)


def test_quantile_grouped_and_cross_validation(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{k % 2}", k % 5, float(a), float(3 * a + rng.normal())) for k, a in enumerate(rng.uniform(0, 5, 200))]
    df = spark.createDataFrame(rows, "g string, fold int, x double, y double")
    got = {r.g: r.w for r in models.grouped_fit(df, ["g"], ["x"], "y", lambda x, y: models.fit_quantile(x, y, 0.5)).collect()}
    for g, w in got.items():
        own = np.array(sorted((r[2], r[3]) for r in rows if r[0] == g))
        assert w == pytest.approx(models.fit_quantile(own[:, :1], own[:, 1], 0.5))
    cv = {r.fold: r.rmse for r in models.cross_validated(df, "fold", 5, ["x"], "y").collect()}
    for f in range(5):
        train, held = (np.array([[1, r[2], r[3]] for r in rows if (r[1] == f) == k]) for k in (False, True))
        w = np.linalg.solve(train[:, :2].T @ train[:, :2] + np.diag([0, 1e-3]), train[:, :2].T @ train[:, 2])
        assert cv[f] == pytest.approx(np.sqrt(np.mean((held[:, 2] - held[:, :2] @ w) ** 2)))


def test_bootstrap_needs_three_pairs_and_separates(spark):
    rows = [("fast", k, 0.8 + k / 100) for k in range(9)] + [("slow", k, 1.3) for k in range(3)] + [("few", k, 0.5) for k in range(2)]
    got = {r.c: r for r in models.bootstrap(spark.createDataFrame(rows, "c string, k int, r double"), ["c"], "r", ["k"], 200).collect()}
    assert (got["fast"].verdict, got["slow"].verdict, got["few"].verdict) == ("FASTER", "SLOWER", "INCONCLUSIVE")
    assert got["few"].low is None and got["fast"].low <= got["fast"].ratio <= got["fast"].high and got["slow"].high == 1.3


def test_list_codes(spark):
    rng = random.Random(6)
    rows = [(rng.sample(range(9), 9), [rng.randrange(8) for _ in range(rng.randrange(20))], bytearray(rng.randbytes(n))) for n in (0, 1, 2, 7, 8, 30)]
    df = spark.createDataFrame(rows, "o array<int>, m array<int>, b binary")
    out = df.select("*", arrays.from_lehmer(arrays.lehmer(F.col("o"))).alias("o2"), arrays.move_to_front(F.col("m"), 8).alias("f"), arrays.from_move_to_front(arrays.move_to_front(F.col("m"), 8), 8).alias("m2"), *[arrays.byte_shuffle(F.col("b"), w).alias(f"b{w}") for w in (1, 2, 3)]).collect()
    for r in out:
        assert r.o2 == r.o and r.m2 == r.m
        table, want = list(range(8)), []
        for v in r.m:
            want.append(table.index(v))
            table.insert(0, table.pop(table.index(v)))
        assert r.f == want
        for w in (1, 2, 3):
            n, k = len(r.b), -(-len(r.b) // w)
            lines, at = [], 0
            for i in range(w):
                size = n // w + (i < n % w)
                lines.append(bytes(r.b[at : at + size]))
                at += size
            assert bytes(r[f"b{w}"]) == b"".join(line[c : c + 1] for c in range(k) for line in lines)
    h = spark.createDataFrame([(list(b"hello"),), ([],)], "v array<int>").select(arrays.fnv1a64(F.col("v"))).collect()
    assert [x[0] for x in h] == ["a430d84680aabd0b", "cbf29ce484222325"]
    assert arrays.zigzag()[:8] == [0, 1, 8, 16, 9, 2, 3, 10] and sorted(arrays.zigzag(4)) == list(range(16))


def test_score_remap_and_scalars(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (30.0,)], "v double")
    got = [r[0] for r in df.select(pixel.score_remap(F.col("v"))).collect()]
    y = lambda v: 6.248496625763138e-5 * v**3 + 2.326765642916932 * v - 0.020884521182843837 * v**2
    want = [100 - 10 * y(0.9562382616834844 * v) ** 0.6276336467831387 if v > 0 else 100.0 for v in (0.0, 1.0, -2.0, 30.0)]
    assert got == pytest.approx(want)
    one = spark.createDataFrame([(2.5, -1, 300, 128, 7, (1 << 60) + 6, -7)], "v double, q int, s int, a int, i int, big long, neg long")
    r = one.select(
        pixel.quantize_sample(F.col("v"), 255).alias("top"), pixel.bias_adjust(F.col("q"), 0.9, 0.1).alias("b1"), pixel.bias_adjust(F.col("i"), 0.9, 0.14).alias("b7"), pixel.residual_bits(F.col("i")).alias("bits"), pixel.composite8(F.lit(200), F.lit(100), F.col("a")).alias("c8"),
        pixel.mirror(F.lit(-2), F.lit(5)).alias("m"), pixel.mirror(F.lit(6), F.lit(5)).alias("m6"), pixel.luma(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("l"), pixel.truncated(F.col("big"), 12).alias("t"), pixel.truncated(F.col("neg"), 2).alias("tn"),
        pixel.mannos_sakrison(F.lit(8.0)).alias("csf"), pixel.radial_frequency(F.lit(3.0), F.lit(4.0), 8).alias("rf"), F.array(*pixel.ycbcr_to_rgb(F.lit(0.5), F.lit(0.0), F.lit(0.1))).alias("rgb"),
    ).first()
    assert (r.top, r.b1, r.bits, r.m, r.m6, r.t, r.tn) == (255, -0.9, 4, 1, 3, ((1 << 60) + 6) // 12, -3)
    assert r.b7 == pytest.approx(7 - 0.02) and r.c8 == (200 * 128 + 100 * 127 + 127) // 255 and r.l == pytest.approx(1.0) and r.rf == pytest.approx(5 / 8 / math.sqrt(2))
    assert r.csf == pytest.approx(2.6 * (0.0192 + 0.114 * 8) * math.exp(-((0.114 * 8) ** 1.1))) and r.rgb == pytest.approx([0.6402, 0.4285864, 0.5])


def test_report_lines_and_names(spark):
    line = "rate_diag=a=1 b=2.5 c=x\nother=a=9\nrate_amp=z=-3\nrate_diag=a=4\nplain"
    row = spark.createDataFrame([(line, "score psnr_db=inf butteraugli=1.5e0", "C:\\pics\\DSC_0042.JPG", ".TIF", "MetAdjacentRungs")], "l string, m string, p string, e string, n string")
    got = row.select(text.named_counters(F.col("l"), ["rate_diag", "rate_amp"]).alias("c"), text.metrics(F.col("m")).alias("m"), text.capture_stem(F.col("p")).alias("s"), text.format_of(F.col("e")).alias("f"), text.status_token(F.col("n")).alias("t"), text.quality_line(F.col("m")).alias("q")).first()
    assert got.c == {"rate_diag": {"a": "4"}, "rate_amp": {"z": "-3"}} and got.m.asDict() == {"psnr_db": "inf", "ssimulacra2": None, "butteraugli": "1.5e0", "butteraugli_pnorm3": None}
    assert (got.s, got.f, got.t, got.q) == ("DSC_0042", "tiff", "met_adjacent_rungs", None)
    sizes = spark.createDataFrame([(8, 8), (100, 100), (1000, 1000), (3000, 2000), (9000, 9000)], "w int, h int").select(text.size_bucket(F.col("w"), F.col("h"))).collect()
    assert [r[0] for r in sizes] == ["tiny", "small", "medium", "large", "xlarge"]
    assert row.select(text.family_key(F.lit("a\\b"), F.lit("X copy.png"))).first()[0] == "a/b/x" and row.where(text.valid_score(F.lit(101.0))).count() == 0


def test_boxes_and_sections(spark):
    b = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    data = files.CONTAINER + b(b"ftyp", b"jxl \0\0\0\0jxl ") + b(b"Exif", b"\0\0\0\0II*") + b(b"brob", b"xml zz") + b(b"jxlp", (1 << 31 | 1).to_bytes(4, "big") + b"two") + b(b"jxlp", (0).to_bytes(4, "big") + b"one")
    rows = files.boxes(spark.createDataFrame([("f", bytearray(data))], "path string, content binary"))
    assert files.valid_containers(rows).first().valid and files.level(rows).first().level == 5
    assert bytes(files.codestreams(rows).first().content) == b"onetwo"
    meta = {r.type: (r.type_inside, bytes(r.body)) for r in files.metadata(rows).collect()}
    assert meta == {"Exif": (None, b"II*"), "brob": ("xml ", b"zz")}
    slices = spark.createDataFrame([(bytearray(b"abcdef"), 2, 3), (bytearray(b"abc"), 2, 3)], "c binary, o long, n long").select(files.section_slice(F.col("c"), F.col("o"), F.col("n"))).collect()
    assert bytes(slices[0][0]) == b"cde" and slices[1][0] is None


def test_record_files(spark, tmp_path):
    path = str(tmp_path / "kinds.jsonl")
    with open(path, "w") as f:
        for k, v in (("point", 1.5), ("point", float("nan")), ("note", 2.0)):
            f.write(json.dumps({"kind": k, "score": v}) + "\n")
    assert [r.score for r in records.read_kinds(spark, path, "kind string, score double", "point", "score").collect()] == [1.5]
    for name, ids in (("good", ["a", "b"]), ("bad", ["a", "a"])):
        with open(tmp_path / f"{name}.json", "w") as f:
            json.dump({"schema": "m/1", "images": [{"id": i, "path": i, "sha256": "0", "strata": ["x"], "split": "train", "family_id": i} for i in ids]}, f)
    assert records.manifest(spark, str(tmp_path / "good.json")).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        records.manifest(spark, str(tmp_path / "bad.json"))
    atom = {"kind": "atom", "mean_xyb": [0.0], "variance_xyb": [0.0]}
    for name, cells in (("whole", [(0, 0), (1, 0)]), ("short", [(0, 0)])):
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            f.write(json.dumps({"kind": "header", "width": 16, "height": 8, "grid_width": 2, "grid_height": 1}) + "\n")
            f.writelines(json.dumps(atom | {"x": x, "y": y}) + "\n" for x, y in cells)
    assert records.atlas(spark, str(tmp_path / "whole.jsonl")).count() == 2
    with pytest.raises(ValueError, match="each atom once"):
        records.atlas(spark, str(tmp_path / "short.jsonl"))
    small = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "k int, s string, v double")
    records.tsv(small, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2
    assert records.markdown(small.orderBy("k")).splitlines() == ["| k | s | v |", "| --- | --- | --- |", "| 1 | a | 0.5 |", "| 2 |  |  |"]
    assert {r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path), "*.json").collect()} == {"good.json", "bad.json"}


def test_small_relational_helpers(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", None, 2), ("b", "y", 3)], "g string, v string, n int")
    assert {r.g: r.counts for r in stats.distribution_map(df, ["g"], "v").collect()} == {"a": {"x": 2, "null": 1}, "b": {"y": 1}}
    assert [tuple(r) for r in corpus.unknown(df, df.where("g = 'a'"), ["g"]).collect()] == [("b",)]
    assert corpus.only(df, df.where("g = 'b'").select("g"), ["g"]).count() == 1
    with pytest.raises(Exception, match="unknown: q"):
        corpus.only(df, spark.createDataFrame([("q",)], "g string"), ["g"]).collect()
    a, b = (spark.createDataFrame(r, "c string, v int, n bigint") for r in ([("x", 1, 2)], [("x", 1, 3), ("x", 2, 1)]))
    assert {(r.v, r.n) for r in entropy.merge_census(a, b, ["c"], "v").collect()} == {(1, 5), (2, 1)}
    shape = lambda w: spark.createDataFrame([(1, w, None)], "i int, w int, h int")
    assert metrics.same_shape(shape(2), shape(2), ["i"], ["w", "h"]).first().same_shape and not metrics.same_shape(shape(2), shape(3), ["i"], ["w", "h"]).first().same_shape
    assert raster.flat_share(spark.createDataFrame([(1, 1e-6), (1, 1.0)], "image int, variance double")).first().flat_fraction == 0.5
    grid = spark.range(1).select(corpus.geometric_grid(10, 100, 2.0).alias("g"), corpus.refine_scales(F.lit(10), F.lit(40), 3).alias("r"), corpus.refine_scales(F.lit(10), F.lit(11), 3).alias("none")).first()
    assert grid.g == [10, 20, 40, 80, 100] and grid.r == [14, 20, 28] and grid.none == []
    assert corpus.value_lattice(3) == [1, 2, 3, 4, 5, 6] and corpus.value_lattice(10, True) == [20, 14, 10, 7, 5] and corpus.value_lattice(10, True, True) == [20, 14, 10]
    passes = spark.createDataFrame([(0, 1, 2), (0, 3, 0), (1, -1, 1)], "k int, q int, s int")
    assert {r.k: r.coefficient for r in bursts.progressive(passes, ["k"], "q", "s").collect()} == {0: 7, 1: -2}
    assert reports.schedule(10, 3) == reports.schedule(10, 3) and sorted(collections.Counter(reports.schedule(10, 3)).values()) == [5, 5]
    with pytest.raises(ValueError, match="no such child"):
        trees.traverse([trees.Node(0, 1, 0, 0)])
