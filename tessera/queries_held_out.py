"""Queries of training, reduction, palettes, summaries and larger stencils over the supplied tables, and their SQL.

events by user stand in for measured curves, users for images, embeddings for 8 x 8 images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import draws, ladder
from tessera.operators import labels, raster, reduction, sketches, stencils, training
from tessera.plans import bounded, regions
from tessera.sources import curves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Fits without a family. A system of two unknowns has a closed form.

@_query("""
WITH m AS (SELECT p_brand, count(*) n, sum(p_size)::DOUBLE x, sum(p_size * p_size)::DOUBLE xx, sum(p_retailprice) y, sum(p_size * p_retailprice) xy FROM part GROUP BY 1),
r AS (SELECT a.p_brand, sum(b.n)::BIGINT AS n, sum(b.x) x, sum(b.xx) + 1e-3 xx, sum(b.y) y, sum(b.xy) xy FROM m a JOIN m b ON a.p_brand <> b.p_brand GROUP BY 1)
SELECT p_brand, n, round((y * xx - x * xy) / (n * xx - x * x), 6) AS constant, round((n * xy - x * y) / (n * xx - x * x), 8) + 0.0 AS slope FROM r
""")
def train_held_out_ridge(spark, d):
    fits = training.held_out_ridge(_t(spark, d, "part"), "p_brand", ["p_size"], "p_retailprice")
    return fits.select("p_brand", "n", F.round(F.col("w")[0], 6).alias("constant"), (F.round(F.col("w")[1], 8) + 0.0).alias("slope"))


_QUANTILES = {"lower": 0.10, "median": 0.50, "candidate": 0.90, "upper": 0.95}
_ROUNDS = 6


def label_cases(spark: SparkSession, d: str) -> DataFrame:
    """Labels of users' curves with two features of each user, a family and the curve; uncensored rows alone have a crossing."""
    from tessera.queries_more import _labels, _points

    points = _points(spark, d)
    curves = points.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("scale").cast("double").alias("scale"), "score"))).alias("curve"), F.avg("score").alias("m"), F.max("scale").alias("n"))
    rows = _labels(spark, d).join(curves, "user_id")
    return rows.select("*", (F.col("m") / 10 - 2).alias("z0"), (F.col("n") / 100 - 6.5).alias("z1"), (F.col("user_id") % 6).alias("family"), (labels.log_loss(F.col("target")) - 3.0).alias("zt"))


def held_out_routes(cases: DataFrame) -> DataFrame:
    """Every uncensored row under the fits of the other families."""
    rows = cases.where("state <> 'censored'").withColumns({"y": F.ln("crossing"), "lb": F.ln("beta")})
    names = ["z0", "z1", "zt"]
    sizes = rows.groupBy("family").agg((1.0 / F.count("*")).alias("weight"))
    rows = rows.join(sizes, "family")
    fits = training.quantile_fits(rows, names, "y", _QUANTILES, "family", "weight", rounds=_ROUNDS)
    return training.routes(training.held_out_scores(rows, "family", fits, training.held_out_ridge(rows, "family", names, "lb"), names))


@_query()
def train_held_out_routes(spark, d):
    out = held_out_routes(label_cases(spark, d))
    return out.select("user_id", "target", *[F.round(c, 6).alias(c) for c in ("error", "observed", "ratio")], "success", "fallback", "route", "work", "ok")


@_query()
def train_route_summary(spark, d):
    out = training.route_summary(held_out_routes(label_cases(spark, d)))
    return out.select("rows", *[F.round(c, 6).alias(c) for c in ("median_abs", "p90_abs", "p99_abs", "first_plan", "first_or_corrected", "fallback_rate", "byte_geomean", "expected_work")])


@_query()
def train_table(spark, d):
    out = training.train_table(label_cases(spark, d), ["z0", "z1"], [0], [10.0, 20.0, 35.0], "family", _QUANTILES, rounds=_ROUNDS)
    rounded = lambda w: F.transform(w, lambda v: F.round(v, 6))
    return out.select("target", "rows", "censored", *[rounded(F.col("models")[q]).alias(q) for q in (*_QUANTILES, "beta")], rounded(F.col("saturation")).alias("saturation"))


# Reductions. Line items stand in for coefficients that may be removed from the ends of chains.

REDUCTION = {"initial": 4, "least": 2, "most": 64, "share": 0.05, "floor": 0.001, "max_rounds": 5, "max_tries": 8}


def removals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, d, "lineitem").where("l_suppkey % 7 < 3")
    edits = rows.select("l_suppkey", (F.col("l_partkey") % 23).alias("chain"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("place"), (F.col("l_quantity") * 10 - 60).cast("long").alias("bits"), (F.col("l_extendedprice") / 1e6).alias("loss"))
    groups = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.pmod(F.col("s_suppkey"), F.lit(5)) * 0.4).alias("room"))
    return edits, groups


@_query()
def reduce_terminal(spark, d):
    edits, groups = removals(spark, d)
    out = reduction.terminal_reduction(edits, groups, ["l_suppkey"], ["chain"], "place", "bits", "loss", "room", **REDUCTION)
    return out.withColumn("lost", F.round("lost", 8))


def colour_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and distinct colours of pictures that some embeddings share."""
    from tessera.queries_more import _rgb

    pixels = _rgb(spark, d).select((F.col("image") % 9).alias("picture"), "image", "x", "y", "r", "g", "b")
    return pixels, pixels.groupBy("picture", "r", "g", "b").agg(F.count("*").alias("n"))


@_query()
def raster_median_cut(spark, d):
    pixels, colours = colour_counts(spark, d)
    return reduction.remapped(pixels, reduction.median_cut(colours, ["picture"], "n", 12), ["picture"])


# Stencils in tiles. Taps and patches are joins of the mirrored image with itself.

_PIX = "p AS (SELECT vec_id AS image, pos % 8 AS x, pos // 8 AS y, v FROM (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings))"
_AROUND = "(SELECT o AS {0}, CASE WHEN o < 0 THEN -1 - o WHEN o > 7 THEN 15 - o ELSE o END AS f{0} FROM range(-{1}, 8 + {1}) t(o)) m{0}"


def _step_sql(source: str, name: str, taps, cross: bool, slope: float) -> str:
    """One step over source(image, x, y, v, w, u, sigma, edge); a mirrored image is a list of 14 x 14 for each plane."""
    at = lambda ix, iy, tap: f"[(y + {3 + iy}) * 14 + x + {4 + ix}{' + dy * 14 + dx' if tap else ''}]"
    apart = " + ".join(f"{s} * abs(m{c}{at(ix, iy, False)} - m{c}{at(ix, iy, True)})" for c, s in zip("vwu", stencils.PLANE_SCALES, strict=True) for ix, iy in (stencils.CROSS if cross else ((0, 0),)))
    return f"""
{name}q AS (SELECT image, {", ".join(f"list({c} ORDER BY my.y, mx.x) AS m{c}" for c in "vwu")} FROM {source} p JOIN {_AROUND.format("x", 3)} ON mx.fx = p.x JOIN {_AROUND.format("y", 3)} ON my.fy = p.y GROUP BY image),
{name}d AS (SELECT p.*, dx, dy, {", ".join(f"m{c}{at(0, 0, True)} AS t{c}" for c in "vwu")}, {apart} AS d FROM {source} p JOIN {name}q USING (image), (VALUES {", ".join(map(str, taps))}) k(dx, dy)),
{name}w AS (SELECT *, CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE greatest(0, 1 - d * CASE WHEN edge THEN 2.0::DOUBLE / 3 ELSE 1 END * {slope}::DOUBLE * 4 * (1 - sqrt(0.5::DOUBLE)) / sigma) END AS g FROM {name}d),
{name} AS (SELECT image, x, y, {", ".join(f"CASE WHEN any_value(sigma) < 0.3 THEN any_value({c}) ELSE sum(g * t{c}) / sum(g) END AS {c}" for c in "vwu")}, any_value(sigma) AS sigma, any_value(edge) AS edge FROM {name}w GROUP BY image, x, y)"""


_EPF = f"""WITH {_PIX}, z AS (SELECT image, x, y, v, v * 2 AS w, v * v AS u, (image % 5) * 2.0::DOUBLE AS sigma, (x % 8 IN (0, 7) OR y % 8 IN (0, 7)) AS edge FROM p WHERE image % 10 < 7),
{_step_sql("z", "s0", stencils.DIAMOND, True, 1.65 * 0.9)},
{_step_sql("s0", "s1", stencils.CROSS, True, 1.65)},
{_step_sql("s1", "s2", stencils.CROSS, False, 1.65 * 6.5)}
SELECT image, x::INT AS x, y::INT AS y, {", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in "vwu")} FROM s2"""


@_query(_EPF)
def raster_edge_preserving(spark, d):
    rows = raster.from_blocks(_t(spark, d, "embeddings"), "vec_id", "embedding", 8, F.col("value").cast("double")).where("image % 10 < 7")
    rows = rows.withColumns({"w": F.col("v") * 2, "u": F.col("v") * F.col("v"), "sigma": (F.col("image") % 5) * 2.0})
    out = stencils.edge_preserving(rows, ["v", "w", "u"], "sigma", side=5)
    return out.select("image", "x", "y", *[(F.round(c, 7) + 0.0).alias(c) for c in "vwu"])


def _up_sql(factor: int, weights) -> str:
    kernel = stencils.phase_weights(weights, factor)
    rows = ", ".join(f"({a}, {b}, [{', '.join(repr(float(c)) for c in kernel[a, b].ravel())}]::DOUBLE[])" for a in range(factor) for b in range(factor))
    window = "[" + ", ".join(f"m[(y + {i}) * 12 + x + {j + 1}]" for i in range(5) for j in range(5)) + "]"
    return f"""WITH {_PIX}, k(a, b, c) AS (VALUES {rows}),
q AS (SELECT image, list(v ORDER BY my.y, mx.x) AS m FROM p JOIN {_AROUND.format("x", 2)} ON mx.fx = p.x JOIN {_AROUND.format("y", 2)} ON my.fy = p.y GROUP BY image),
n AS (SELECT image, x, y, {window} AS n FROM p JOIN q USING (image))
SELECT image, (x * {factor} + b)::INT AS x, (y * {factor} + a)::INT AS y, round(least(greatest(list_inner_product(n, c), list_min(n)), list_max(n)), 7) + 0.0 AS v FROM n, k"""


def _upsampled(spark, d, factor):
    rows = raster.from_blocks(_t(spark, d, "embeddings"), "vec_id", "embedding", 8, F.col("value").cast("double"))
    return stencils.upsample(rows, factor, side=5).withColumn("v", F.round("v", 7) + 0.0)


@_query(_up_sql(2, stencils.UP2))
def raster_upsample2(spark, d):
    return _upsampled(spark, d, 2)


@_query(_up_sql(4, stencils.UP4))
def raster_upsample4(spark, d):
    return _upsampled(spark, d, 4)


# Sketches


@_query("""
WITH b AS (SELECT l_returnflag, floor(greatest(least((ln(l_extendedprice * l_discount + 1e-30) + 46) / 0.125, 511), 0))::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM b)
SELECT l_returnflag, min(-46 + (bin + 0.5) * 0.125::DOUBLE) FILTER (seen > floor(least(0.5 * total, total - 1))) AS q50, min(-46 + (bin + 0.5) * 0.125::DOUBLE) FILTER (seen > floor(least(0.99::DOUBLE * total, total - 1))) AS q99 FROM c GROUP BY 1
""")
def stat_log_sketch(spark, d):
    rows = _t(spark, d, "lineitem")
    ln = F.ln(F.col("l_extendedprice") * F.col("l_discount") + 1e-30)
    halves = [sketches.log_sketch(rows.where(F.col("l_linenumber") % 2 == k), ["l_returnflag"], ln) for k in (0, 1)]
    return sketches.sketch_quantiles(sketches.merged(halves, ["l_returnflag"]), ["l_returnflag"], {"q50": 0.5, "q99": 0.99})


_COEFFICIENTS = "b AS (SELECT u, x, CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END * cos((2 * x + 1) * u * pi() / 16) / 8 AS c FROM range(8) t(u), range(8) s(x)), k AS (SELECT image, r.u AS col, q.u AS row, sum(v * r.c * q.c) AS v FROM p JOIN b r ON r.x = p.x JOIN b q ON q.x = p.y GROUP BY ALL)"


@_query(f"""WITH {_PIX}, {_COEFFICIENTS},
e AS (SELECT image, sum(v * v) FILTER (row + col > 0) AS y, sum(v * v) FILTER (row + col BETWEEN 1 AND 2) AS low, sum(v * v) FILTER (greatest(row, col) >= 4) AS high, sum(v * v) FILTER (row > col) AS r, sum(v * v) FILTER (col > row) AS c,
  sum(v * v / 4 + v * v * v * v) FILTER (row + col > 0) AS xb, count(*) FILTER (row + col > 0 AND abs(v) < 1e-3) AS n3, count(*) FILTER (row + col > 0 AND abs(v) < 1e-2) AS n2, max(v) FILTER (row + col = 0) AS dc FROM k GROUP BY image),
h AS (SELECT image % 4 AS picture, floor(greatest(least((ln(y + 1e-30) + 46) / 0.125, 511), 0))::INT AS bin, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY picture ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY picture) AS total FROM h),
q AS (SELECT picture, {", ".join(f"min(-46 + (bin + 0.5) * 0.125::DOUBLE) FILTER (seen > floor(least({q} * total, total - 1))) AS ln_ac_y_q{round(q * 100)}" for q in (0.5, 0.9, 0.99))} FROM s GROUP BY 1)
SELECT image % 4 AS picture, count(*) AS blocks, round(ln(sum(y) / count(*) + 1e-30), 7) AS ln_ac_y_mean, any_value(ln_ac_y_q50) AS ln_ac_y_q50, any_value(ln_ac_y_q90) AS ln_ac_y_q90, any_value(ln_ac_y_q99) AS ln_ac_y_q99, round(sum(high) / (sum(low) + 1e-30), 7) AS high_low_ratio,
round(abs(sum(r) - sum(c)) / (sum(r) + sum(c) + 1e-30), 7) AS directional_asymmetry, round(sum(xb) / (sum(y) + 1e-30), 7) AS chroma_ac_ratio, round(sum(n3) / (count(*) * 63), 9) AS near_zero_frac_1e3, round(sum(n2) / (count(*) * 63), 9) AS near_zero_frac_1e2, round(greatest(avg(dc * dc) - avg(dc) * avg(dc), 0), 9) AS dc_variance_y
FROM e JOIN q ON q.picture = e.image % 4 GROUP BY image % 4""")
def summary_transform(spark, d):
    basis = raster.dct_basis(8)
    rows = raster.separable(_t(spark, d, "embeddings").withColumn("picture", F.col("vec_id") % 4), "embedding", basis, basis, ["picture", "vec_id"])
    blocks = rows.select("picture", F.col("values").alias("y"), F.transform("values", lambda v: v / 2).alias("x"), F.transform("values", lambda v: v * v).alias("b"))
    out = sketches.transform_summary(sketches.transform_partials(blocks, ["picture"], "y", "x", "b"), ["picture"])
    seven = ("ln_ac_y_mean", "high_low_ratio", "directional_asymmetry", "chroma_ac_ratio")
    return out.withColumns({c: F.round(c, 7) for c in seven} | {c: F.round(c, 9) for c in ("near_zero_frac_1e3", "near_zero_frac_1e2", "dc_variance_y")})


# Seeded draws

_NOISE_SEED = (3 << 32) + 1


@_query()
def pixel_noise(spark, d):
    key = F.col("l_partkey")
    groups = _t(spark, d, "lineitem").where(key % 40 == 1).select(key).distinct().select(key.alias("part"), ((key % 50) * 32).alias("x0"), ((key % 7) * 8).alias("y0"), (5 + key % 17).alias("width"), (1 + key % 5).alias("height"))
    return draws.noise_field(groups, _NOISE_SEED).select("part", "channel", "x", "y", "v")


@_query("""
WITH c AS (SELECT p_brand, p_size % 16 AS symbol, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, sum(n) AS t FROM c GROUP BY 1),
m AS (SELECT t.p_brand, s.symbol, coalesce(n, 0) * 4096 // t AS mass FROM t CROSS JOIN range(16) s(symbol) LEFT JOIN c ON c.p_brand = t.p_brand AND c.symbol = s.symbol)
SELECT p_brand, symbol::INT AS symbol, (mass + CASE WHEN symbol = 0 THEN 4096 - sum(mass) OVER (PARTITION BY p_brand) ELSE 0 END)::BIGINT AS slots, (mass + CASE WHEN symbol = 0 THEN 4096 - sum(mass) OVER (PARTITION BY p_brand) ELSE 0 END)::BIGINT AS offsets FROM m
""")
def entropy_alias(spark, d):
    """Every slot of every brand's table: how many a symbol has, and how many different offsets."""
    counts = _t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("t"), *[F.count_if(F.col("p_size") % 16 == k).alias(f"c{k}") for k in range(16)])
    mass = F.array(*[F.floor(F.col(f"c{k}") * 4096 / F.col("t")) for k in range(16)])
    spare = 4096 - F.aggregate(mass, F.lit(0).cast("bigint"), lambda a, m: a + m)
    tables = counts.select("p_brand", F.transform(mass, lambda m, k: m + F.when(k == 0, spare).otherwise(0)).alias("mass")).withColumn("table", draws.alias_table(F.col("mass")))
    slots = tables.select("p_brand", "mass", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda s: draws.alias_symbol(F.col("table"), s))).alias("e"))
    seen = slots.groupBy("p_brand", F.col("e.symbol").alias("symbol")).agg(F.count("*").alias("slots"), F.countDistinct("e.offset").alias("offsets"))
    every = tables.select("p_brand", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("symbol"))
    return every.join(seen, ["p_brand", "symbol"], "left").na.fill(0, ["slots", "offsets"])


# Regions. A picture of 8 x 8 is three levels of parts.

_LEVEL = lambda name, below, side, cells: f"{name} AS (SELECT image, x // {side} AS x, y // {side} AS y, sum(cost) AS split_cost, 0.95::DOUBLE * sqrt(sum(e) * {cells}) AS single_cost, sum(e) AS e, least(sum(cost), 0.95::DOUBLE * sqrt(sum(e) * {cells})) AS cost FROM {below} GROUP BY ALL)"


@_query(f"""WITH {_PIX}, l3 AS (SELECT image, x, y, abs(v) AS cost, v * v AS e FROM p),
{_LEVEL("l2", "l3", 2, 4)}, {_LEVEL("l1", "l2", 2, 16)}, {_LEVEL("l0", "l1", 2, 64)},
a AS (SELECT 2 AS depth, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0)
SELECT image, depth, count(*) AS nodes, count(*) FILTER (single_cost < split_cost) AS merged, count(*) FILTER (single_cost < split_cost * 1.02) AS chosen, round(sum(CASE WHEN single_cost < split_cost * 1.02 THEN single_cost ELSE split_cost END - cost), 7) + 0.0 AS regret FROM a GROUP BY ALL""")
def plan_regions(spark, d):
    out = decided_regions(spark, d)[0]
    return out.groupBy("image", F.length("path").alias("depth")).agg(F.count("*").alias("nodes"), F.count_if("merged").alias("merged"), F.count_if("chosen").alias("chosen"), (F.round(F.sum("regret"), 7) + 0.0).alias("regret"))


def decided_regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pixels = raster.from_blocks(_t(spark, d, "embeddings"), "vec_id", "embedding", 8, F.col("value").cast("double"))
    digit = lambda k: (F.shiftright(F.col("y").cast("int"), k).bitwiseAND(F.lit(1)) * 2 + F.shiftright(F.col("x").cast("int"), k).bitwiseAND(F.lit(1))).cast("string")
    leaves = pixels.select("image", F.concat(digit(2), digit(1), digit(0)).alias("path"), F.abs("v").alias("cost"), (F.col("v") * F.col("v")).alias("e"))
    heads = leaves.select("image", F.explode(F.array(*[F.substring("path", 1, n) for n in range(3)])).alias("path"), "e")
    singles = heads.groupBy("image", "path").agg((0.95 * F.sqrt(F.sum("e") * F.pow(F.lit(4.0), 3 - F.length("path")))).alias("single"))
    return regions.region_decisions(leaves, singles, ["image"], "path", "cost", "single", lambda split, whole: whole < split * 1.02), leaves


@_query()
def plan_cover_agreement(spark, d):
    made, leaves = decided_regions(spark, d)
    both = [regions.cover(made, leaves, ["image"], "path", c) for c in ("merged", "chosen")]
    return regions.covered_agreement(*both, ["image"]).select("image", F.round("same", 9).alias("same"), F.round("area", 9).alias("area"))


# Files of curves, as Spark writes them, through the data source.

_CURVE_VERSION = "curve/1"


@_query("""
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rung, value / 5.0::DOUBLE AS score FROM events)
SELECT user_id::VARCHAR AS image_id, 'f' || user_id % 6 AS family_id, rung::INT AS rung, rung * 10.0::DOUBLE AS scale, score, CASE WHEN rung % 4 <> 0 THEN 1000 + 7 * rung END AS bytes FROM c WHERE user_id % 5 <> 3
""")
def src_curves(spark, d):
    from tessera.queries_more import _points
    from tessera.sources.shared import new_path

    point = F.struct("rung", F.col("scale").alias("effective_scale"), "score", F.col("bytes").cast("bigint").alias("bytes"))
    curves_ = _points(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    image = F.struct(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("f"), F.col("user_id") % 6).alias("family_id"))
    path = new_path(spark, "curves")
    curves_.select(F.to_json(F.struct(F.lit(_CURVE_VERSION).alias("schema"), image.alias("image"), "points")).alias("value")).write.text(path)
    return curves.read(spark, path, "curves", _CURVE_VERSION).where("image_id % 5 <> 3").select("image_id", "family_id", "rung", "scale", "score", "bytes")


_PARTS = [("b0", "c0"), ("b1", "c1"), ("b2", "c2")]


@_query("""
WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 0.75 AS b0, l_quantity AS c0, l_extendedprice / 4096 AS b1, l_extendedprice / 2048 AS c1, l_tax * 64 AS b2, l_tax * 128 AS c2 FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem)),
k AS (SELECT *, 0.5 + b0 + b1 + b2 AS s0, 0.5 + c0 + b1 + b2 AS s1, 0.5 + c0 + c1 + b2 AS s2, 0.5 + c0 + c1 + c2 AS s3 FROM p),
c AS (SELECT *, min(s3) OVER (PARTITION BY l_orderkey ORDER BY s0, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM (SELECT k.*, c0 AS l_quantity, c1 AS l_extendedprice, c2 AS l_tax FROM k)),
d AS (SELECT *, CASE WHEN s0 >= cut THEN 0 WHEN s1 >= cut THEN 1 WHEN s2 >= cut THEN 2 ELSE 3 END AS done FROM c)
SELECT l_orderkey, count(*) AS candidates, round(min(s3), 7) AS best, sum(done)::BIGINT AS parts_done, (count(*) * 3 - sum(done))::BIGINT AS skipped, 0::BIGINT AS unsafe FROM d GROUP BY 1
""")
def plan_bounded_cost(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax").distinct()
    rows = rows.withColumns({"b0": F.col("l_quantity") * 0.75, "c0": F.col("l_quantity"), "b1": F.col("l_extendedprice") / 4096, "c1": F.col("l_extendedprice") / 2048, "b2": F.col("l_tax") * 64, "c2": F.col("l_tax") * 128})
    made = bounded.bounded_costs(rows, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"], _PARTS, F.lit(0.5))
    return bounded.bounded_summary(made, ["l_orderkey"], 3).withColumn("best", F.round("best", 7))


@_query(f"""
WITH g AS (SELECT k, (k - 1) * {ladder.MOST_SCALE} // k + 1 AS first, coalesce(sum({ladder.MOST_SCALE} - ((k - 1) * {ladder.MOST_SCALE} // k + 1) + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM range(1, {ladder.MOST_FACTOR} + 1) t(k)),
s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity * 2 AS target, least((l_partkey * 37 + l_suppkey * 101)::BIGINT, {ladder.RUNGS} - 1) AS r, round(greatest(least(l_extendedprice * 3.7::DOUBLE, {ladder.MOST_SCALE * ladder.MOST_FACTOR}), 1))::BIGINT AS z FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem))
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, ((g.first + r - g.start) * g.k)::BIGINT AS effective, (h.start + greatest(z // h.k - h.first, -1))::BIGINT AS rung, greatest(1.0::DOUBLE, 2 * 0.02::DOUBLE * greatest(100 - target, 1e-3)) AS band
FROM s ASOF JOIN g ON s.r >= g.start JOIN g h ON h.k = ceil(z / {ladder.MOST_SCALE})
""")
def curve_ladder(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity").distinct()
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", ladder.effective_scale(F.col("l_partkey") * 37 + F.col("l_suppkey") * 101).alias("effective"), ladder.rung_for_scale(F.col("l_extendedprice") * 3.7).alias("rung"), ladder.met_band(F.col("l_quantity") * 2, 0.02, 2.0).alias("band"))


@_query("""
SELECT 'rate' AS source, user_id, count(*) AS n, count(bytes) AS priced, NULL::BIGINT AS quality FROM (SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 4 <> 0 THEN 1 END AS bytes FROM events) GROUP BY user_id
UNION ALL SELECT 'quality', user_id, count(*), 0, sum(event_id)::BIGINT FROM events WHERE event_type <> 'click' GROUP BY user_id
""")
def curve_records(spark, d):
    from tessera.queries_more import _points

    quality = _t(spark, d, "events").where("event_type <> 'click'").select("user_id", F.col("event_id").alias("requested"))
    both = ladder.curve_union({"rate": _points(spark, d), "quality": quality})
    return both.groupBy("source", "user_id").agg(F.count("*").alias("n"), F.count("bytes").alias("priced"), F.sum("requested").alias("quality"))
