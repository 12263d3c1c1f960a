"""Small golden cases and inverses."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import pixel, text
from tessera.operators import corpus, curves, entropy, models, raster, sequences, stats
from tessera.sources import files, records
from tessera.streaming import bursts


def test_floor_index_quantile(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2, 3)], "g string, v double")
    assert tuple(stats.floor_index_quantiles(df, ["g"], "v", [0.0, 0.5, 0.9, 1.0]).first()) == ("a", 1.0, 3.0, 4.0, 5.0)
    assert stats.floor_index_quantiles(df.where("v > 9"), ["g"], "v", [0.5]).count() == 0


def test_tie_rank_and_singletons(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 7.0)], "g string, v double")
    got = sorted(tuple(r) for r in stats.tie_rank(df, ["g"], "v", "r").collect())
    assert got == [("a", 1.0, 0.25), ("a", 1.0, 0.25), ("a", 2.0, 1.0), ("b", 7.0, 0.0)]


def test_geometric_mean_ignores_what_is_not_positive(spark):
    df = spark.createDataFrame([(2.0,), (8.0,), (0.0,), (-1.0,), (None,)], "v double")
    assert df.agg(stats.geometric_mean("v")).first()[0] == pytest.approx(4.0)
    assert df.where("v < 0").agg(stats.geometric_mean("v"), stats.geometric_mean("v", 0.0)).first()[:] == (None, 0.0)


def test_edges_strictly_increase(spark):
    edges = stats.bucket_edges(spark.createDataFrame([(1.0,)] * 9, "v double"), "v")
    assert all(a < b for a, b in zip(edges, edges[1:], strict=False))


def test_crossing_takes_the_first_point_in_order(spark):
    rows = [("a", 1, 50.0), ("a", 2, 80.0), ("a", 3, 60.0), ("b", 1, 90.0), ("c", 1, 10.0)]
    out = curves.crossing_state(spark.createDataFrame(rows, "k string, x int, s double"), ["k"], ["x"], "s", 70.0).orderBy("k").collect()
    assert [(r.state, r.x, r.below_x) for r in out] == [("crossed", 2, 1), ("floor", 1, None), ("censored", None, None)]


def test_bd_rate_of_a_constant_ratio(spark):
    rows = [("i", arm, math.exp(q / 20) * (1.25 if arm == "t" else 1.0), float(q)) for arm in "rt" for q in (30, 50, 60, 80, 90)]
    df = spark.createDataFrame(rows + [("j", "r", 1.0, 1.0)], "i string, arm string, rate double, q double")
    got = {r.i: r.bd_rate for r in curves.bd_rate(df, ["i"], "arm", "r", "t", "rate", "q").collect()}
    assert got["i"] == pytest.approx(25.0)
    assert got["j"] is None or math.isnan(got["j"])


def test_bursts_chain_and_unstamped_rows_stay_alone(spark):
    rows = [(1, 0), (2, 10), (3, 20), (4, 31), (5, None), (6, None)]
    df = spark.createDataFrame(rows, "id int, s int").withColumn("t", F.timestamp_seconds("s"))
    got = {r.id: r.family for r in corpus.fold_bursts(df, [], "t", "id", 10.0).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_streaming_sessions_agree_with_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 10), ("a", 21), ("b", 5), ("a", 100_000)]
    df = spark.createDataFrame(rows, "k string, s int").select("k", F.timestamp_seconds("s").alias("t"))
    batch = {(r.k, r.n) for r in bursts.sessions(df, "k", "t", 10).collect()}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = bursts.sessions(stream, "k", "t", 10, "1 minute").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r.k, r.n) for r in spark.table("sessions").collect()}
    assert ("a", 2) in closed and closed <= batch


def test_append_once_skips_written_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    df.write.parquet(str(tmp_path / "in"))
    for run in ("a", "b"):
        q = bursts.append_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), "id", str(tmp_path / run))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_file_names(spark):
    names = ["20240131_235959-small (1).JPG", "20241399_000000.png", "plain", "img-1600x900.png", "img_hd", "copy.png", "a.b copy COPY hd.tar.gz", ".hidden", "IMG_20240131_235959.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(text.stem(F.col("n")).alias("s"), text.capture_date(F.col("n")).alias("d")).collect()
    assert [(r.s, r.d) for r in got] == [("20240131_235959", "2024-01-31"), ("20241399_000000", "unstamped"), ("plain", "unstamped"), ("img", "unstamped"), ("img", "unstamped"), ("copy.png", "unstamped"), ("a.b copy copy hd.tar", "unstamped"), (".hidden", "unstamped"), ("img_20240131_235959", "unstamped")]
    kv = spark.createDataFrame([("a=1 b=x=y c",)], "l string").select(text.key_values(F.col("l"))).first()[0]
    assert kv == {"a": "1", "b": "x=y"}
    f = spark.createDataFrame([("1, 2.5",), ("1,-2",), ("1,x",)], "l string").select(text.csv_floats(F.col("l"))).collect()
    assert [r[0] for r in f] == [[1.0, 2.5], None, None]


def test_rct_kinds_and_inverse(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(-300, 300) for _ in range(3)) for _ in range(50)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    back = pixel.rct_inverse(*pixel.rct_forward(F.col("r"), F.col("g"), F.col("b")))
    assert df.select(*back).collect() == df.collect()
    kinds = [pixel.rct_inverse_any(k, F.col("r"), F.col("g"), F.col("b")) for k in range(42)]
    assert all(len(k) == 3 and all(c is not None for c in k) for k in kinds)
    assert df.select(*kinds[0]).collect() == df.collect()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-500, 500), min_size=1, max_size=24))
def test_expected_residual_keeps_samples_between(values):
    for a, b, c in zip(values, values[1:], values[2:], strict=False):
        t = raster.expected_residual(a, b, c)
        if a >= b >= c:
            assert 0 <= t <= max(0, 2 * (a - b) + 1)
        elif a <= b <= c:
            assert -(2 * (b - a) + 1) <= t <= 0
        else:
            assert t == 0


def test_squeeze_inverts_at_odd_widths(spark):
    rng = random.Random(2)
    rows = [(i, x, y, rng.randrange(-99, 99)) for i in range(3) for y in range(3) for x in range(5 + i)]
    df = spark.createDataFrame(rows, "image int, x int, y int, v bigint")
    assert sorted(tuple(r) for r in raster.unsqueeze_rows(raster.squeeze_rows(df)).select("image", "x", "y", "v").collect()) == sorted(rows)


def test_orientations_are_permutations(spark):
    df = spark.range(12).select((F.col("id") % 4).cast("int").alias("x"), F.floor(F.col("id") / 4).cast("int").alias("y"))
    for o in range(1, 9):
        w, h = F.lit(4), F.lit(3)
        got = {tuple(r) for r in df.select(*pixel.orient(F.lit(o), F.col("x"), F.col("y"), w, h)).collect()}
        assert got == ({(x, y) for x in range(4) for y in range(3)} if o < 5 else {(y, x) for x in range(4) for y in range(3)})


def test_pack_and_hybrid_are_inverse(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37 - 90_000).alias("v"), F.col("id").alias("u"))
    assert df.where(pixel.unpack_signed(pixel.pack_signed(F.col("v"))) != F.col("v")).count() == 0
    for split, msb, lsb in ((4, 2, 0), (4, 1, 1), (0, 0, 0)):
        token, _, extra = pixel.hybrid_token(F.col("u"), split, msb, lsb)
        assert df.where(pixel.hybrid_value(token, extra, split, msb, lsb) != F.col("u")).count() == 0


def test_huffman_codes_are_prefix_free(spark):
    df = spark.createDataFrame([("a", k, 2**k) for k in range(12)] + [("b", 0, 5)], "c string, v int, n bigint")
    rows = entropy.canonical_codes(entropy.huffman_lengths(df, ["c"], "v", 6), ["c"], "v").collect()
    codes = [format(r.code, f"0{r.length}b") for r in rows if r.c == "a"]
    assert len(codes) == 12 and max(map(len, codes)) <= 6
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert sum(2.0 ** -len(c) for c in codes) == 1.0


def test_normalised_counts_sum_up(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate([1, 1, 10_000, 3])], "c string, v int, n bigint")
    rows = entropy.normalised(df, ["c"], "v").collect()
    assert sum(r.p for r in rows) == 4096 and min(r.p for r in rows) >= 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=6))
def test_lz77_round_trip(a, b):
    data = a + b * 20 + a
    assert sequences.lz77_bytes(sequences.lz77_tokens(data)) == data


def test_quantile_fit_covers_and_follows_weights():
    x = np.linspace(0, 1, 200)[:, None]
    y = x[:, 0] * 3 + np.tile([0.0, 1.0], 100)
    assert (y <= np.c_[np.ones(200), x] @ models.fit_quantile(x, y, 0.9) + 0.05).mean() > 0.85
    low = models.fit_quantile(x, y, 0.5, np.tile([1.0, 1e-6], 100))
    assert np.allclose(low, [0, 3], atol=0.02)


def test_boxes_round_trip(spark):
    df = spark.createDataFrame([("f", bytearray(b"\xff\x0acode"))], "path string, content binary")
    wrapped = df.select("path", files.wrap(F.col("content"), 10).alias("content"))
    assert wrapped.select(files.sniff(F.col("content"))).first()[0] == "container"
    box_rows = files.boxes(wrapped)
    assert [r.type for r in box_rows.orderBy("position").collect()] == ["JXL ", "ftyp", "jxll", "jxlc"]
    assert files.valid_containers(box_rows).first().valid and files.level(box_rows).first().level == 10
    assert bytes(files.codestreams(box_rows).first().content) == b"\xff\x0acode"
    with pytest.raises(ValueError):
        files.parse_boxes(b"\0\0\0\x09abcd")


def test_pixmaps_and_arrays(spark):
    import io

    ppm = b"P6 # comment\n2\n1 255\n" + bytes([1, 2, 3, 4, 5, 6])
    df = spark.createDataFrame([("p", bytearray(ppm))], "path string, content binary")
    assert tuple(files.ppm_sizes(df).first()) == ("p", 2, 1, 255)
    assert [r.v for r in files.ppm_pixels(df).orderBy("y", "x", "c").collect()] == [1, 2, 3, 4, 5, 6]
    out = io.BytesIO()
    np.save(out, np.arange(12, dtype="<f4").reshape(1, 2, 2, 3))
    arrays = spark.createDataFrame([("n", bytearray(out.getvalue()))], "path string, content binary")
    assert files.npy_pixels(arrays).agg(F.sum("v")).first()[0] == 66.0


def test_records_keep_their_version_and_refuse_nan(spark, tmp_path):
    df = spark.createDataFrame([("v/1", 1.5), ("v/2", 2.5)], "schema string, score double")
    records.write(df, str(tmp_path / "r"))
    assert records.read(spark, str(tmp_path / "r"), "schema string, score double", ["v/1", "v/2"]).count() == 2
    with pytest.raises(Exception, match="unknown schema"):
        records.read(spark, str(tmp_path / "r"), "schema string, score double", ["v/1"]).collect()
    with pytest.raises(Exception, match="not finite"):
        records.write(df.withColumn("score", F.lit(float("nan"))), str(tmp_path / "n"))


def test_each_family_weighs_the_same(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "f string")
    assert {r.f: r.s for r in stats.family_weight(df, "f").groupBy("f").agg(F.sum("weight").alias("s")).collect()} == {"a": pytest.approx(1.0), "b": 1.0}
