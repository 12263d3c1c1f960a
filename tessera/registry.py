"""Queries of the analytics operators over the supplied tables, and the same in DuckDB SQL.

The tables stand in for measurements: lineitem for experiment records, events by user for curves, embeddings for 8 x 8
blocks of samples, documents for byte streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import queries_held_out, queries_more
from tessera.functions import pixel, text
from tessera.operators import corpus, curves, entropy, metrics, models, raster, sequences, stats
from tessera.plans import ladder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# Statistics


@_query("""WITH r AS (SELECT l_returnflag, l_extendedprice v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 k, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem)
SELECT l_returnflag, max(v) FILTER (k = floor((n - 1) * 0.1)) q10, max(v) FILTER (k = floor((n - 1) * 0.5)) q50, max(v) FILTER (k = floor((n - 1) * 0.9)) q90 FROM r GROUP BY 1""")
def stat_floor_quantile(spark, d):
    return stats.floor_index_quantiles(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])


@_query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) q10, round(quantile_cont(l_extendedprice, 0.5), 6) q50, round(quantile_cont(l_extendedprice, 0.9), 6) q90 FROM lineitem GROUP BY ALL")
def stat_linear_quantile(spark, d):
    return _rounded(stats.linear_quantiles(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.1, 0.5, 0.9]), q10=6, q50=6, q90=6)


@_query("SELECT l_linestatus, quantile_disc(l_extendedprice, 0.3) q30, quantile_disc(l_extendedprice, 0.95) q95 FROM lineitem GROUP BY ALL")
def stat_nearest_rank(spark, d):
    return stats.nearest_ranks(_t(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice", [0.3, 0.95])


@_query("""WITH r AS (SELECT event_type, value v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 k, count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_type, v AS p90 FROM r WHERE k = least(floor(0.9::DOUBLE * (n - 1) + 0.9999::DOUBLE), n - 1)""")
def stat_ceil_quantile(spark, d):
    return stats.order_statistics(_t(spark, d, "events"), ["event_type"], "value", {"p90": stats.ceil_index(0.9)})


@_query("SELECT event_type, min(value) min, round(quantile_cont(value, 0.5), 6) median, quantile_disc(value, 0.95) p95, quantile_disc(value, 0.99) p99, max(value) max FROM events GROUP BY 1")
def stat_summary(spark, d):
    return _rounded(stats.summary(_t(spark, d, "events"), ["event_type"], "value"), median=6)


@_query("""WITH r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 b, count(*) OVER (PARTITION BY l_returnflag, l_quantity) s, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN n <= 1 THEN 0 ELSE (2 * b + s - 1) / 2.0::DOUBLE / (n - 1) END, 9) AS tie_rank FROM r""")
def stat_tie_rank(spark, d):
    return _rounded(stats.tie_rank(_t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "tie_rank").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tie_rank"), tie_rank=9)


@_query("SELECT event_type, round(exp(avg(ln(value)) FILTER (value > 0)), 6) gm, round(coalesce(exp(avg(ln(value - 480)) FILTER (value > 480)), 0), 6) high FROM events GROUP BY 1")
def stat_geomean(spark, d):
    e = _t(spark, d, "events").withColumn("over", F.col("value") - 480)
    return _rounded(e.groupBy("event_type").agg(stats.geometric_mean("value").alias("gm"), stats.geometric_mean("over", 0.0).alias("high")), gm=6, high=6)


@_query("SELECT user_id, coalesce(event_type, 'null') AS value, count(*) n FROM events GROUP BY ALL")
def stat_distribution(spark, d):
    return stats.distribution(_t(spark, d, "events"), ["user_id"], "event_type")


@_query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT label, pos, v AS center FROM (SELECT *, row_number() OVER (PARTITION BY label, pos ORDER BY v) - 1 k, count(*) OVER (PARTITION BY label, pos) n FROM p) WHERE k = floor(n / 2)),
m AS (SELECT label, pos, x AS mad FROM (SELECT label, pos, abs(v - center) x, row_number() OVER (PARTITION BY label, pos ORDER BY abs(v - center)) - 1 k, count(*) OVER (PARTITION BY label, pos) n FROM p JOIN c USING (label, pos)) WHERE k = floor(n / 2))
SELECT label, pos::INT AS pos, center, round(CASE WHEN mad = 0 THEN 1 ELSE mad * 1.4826::DOUBLE END, 9) AS scale FROM c JOIN m USING (label, pos)""")
def stat_mad_standardise(spark, d):
    rows = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return _rounded(stats.robust_scale(rows, ["label", "pos"], "v"), scale=9)


@_query("SELECT o_orderkey, round(1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey), 9) AS weight FROM orders")
def stat_family_weight(spark, d):
    return _rounded(stats.family_weight(_t(spark, d, "orders"), "o_custkey").select("o_orderkey", "weight"), weight=9)


@_query("""WITH c AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey) s, count(*) OVER (PARTITION BY l_partkey, l_suppkey) n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN n > 1 THEN (s - l_quantity) / (n - 1) ELSE 25.0 END, 6) AS expected FROM c""")
def stat_leave_one_out(spark, d):
    out = stats.leave_one_out(_t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity", F.lit(25.0))
    return _rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "expected"), expected=6)


@_query("""WITH r AS (SELECT l_returnflag, l_tax, l_discount, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount) - 1 k, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem)
SELECT l_returnflag, count(*) samples, count(*) FILTER (l_tax <= l_discount) agreements, round(avg(l_discount), 6) mean, max(l_discount) max, max(l_discount) FILTER (k = round(0.99 * (n - 1))) p99 FROM r GROUP BY 1""")
def stat_regret_p99(spark, d):
    return _rounded(stats.regret_summary(_t(spark, d, "lineitem"), ["l_returnflag"], "l_discount", F.col("l_tax") <= F.col("l_discount")), mean=6)


@_query("SELECT l_linestatus, count(*) candidates, count(*) FILTER (l_discount > 0.05) pruned, count(*) FILTER (l_discount > 0.05 AND l_quantity < 10 - 1e-6) violations FROM lineitem GROUP BY 1")
def stat_prune_audit(spark, d):
    return stats.prune_summary(_t(spark, d, "lineitem"), ["l_linestatus"], F.col("l_discount") > 0.05, F.col("l_quantity"), F.lit(10.0))


@_query("SELECT user_id, min(value) min, max(value) max, round(max(value) - min(value), 9) delta, ceil((max(value) - min(value)) * 100 - 1e-9) / 100.0::DOUBLE guard FROM events GROUP BY 1")
def stat_metric_variation(spark, d):
    return _rounded(stats.metric_variation(_t(spark, d, "events"), ["user_id"], "value"), delta=9)


@_query("""WITH e AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) e FROM lineitem)
SELECT (SELECT count(*) FROM unnest(e) t(x) WHERE l_extendedprice >= x)::INT AS price_bucket, l_returnflag, round(exp(avg(ln(l_quantity)) FILTER (l_quantity > 0)), 6) AS geomean, count(*) n, count(DISTINCT l_partkey) support FROM lineitem, e GROUP BY ALL""")
def stat_bucket_table(spark, d):
    rows = _t(spark, d, "lineitem")
    key = stats.bucket(F.col("l_extendedprice"), stats.bucket_edges(rows, "l_extendedprice")).alias("price_bucket")
    return _rounded(stats.cell_table(rows, [key, F.col("l_returnflag")], "l_quantity", "l_partkey"), geomean=6)


@_query("""WITH r AS (SELECT l_returnflag g, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) t, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) p, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem),
f AS (SELECT g, t <= greatest(1, ceil(n * 0.05::DOUBLE)) t, p <= greatest(1, ceil(n * 0.1::DOUBLE)) p FROM r)
SELECT g AS l_returnflag, round(count(*) FILTER (t AND p) / count(*) FILTER (t), 9) AS recall FROM f GROUP BY 1""")
def stat_recall_at_k(spark, d):
    return _rounded(stats.recall_at(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), recall=9)


@_query("""WITH g AS (SELECT i // 1 % 3 w0, i // 3 % 3 w1 FROM range(1, 9) t(i)),
s AS (SELECT w0, w1, p_partkey, p_retailprice tr, w0 * p_size::DOUBLE + w1 * (p_partkey % 97)::DOUBLE pr FROM part, g),
r AS (SELECT w0, w1, row_number() OVER (PARTITION BY w0, w1 ORDER BY tr DESC, p_partkey) t, row_number() OVER (PARTITION BY w0, w1 ORDER BY pr DESC, p_partkey) p, count(*) OVER (PARTITION BY w0, w1) n FROM s),
f AS (SELECT w0, w1, t <= greatest(1, ceil(n * 0.05::DOUBLE)) t, p <= greatest(1, ceil(n * 0.1::DOUBLE)) p FROM r)
SELECT w0, w1, round(count(*) FILTER (t AND p) / count(*) FILTER (t), 9) AS recall FROM f GROUP BY ALL""")
def stat_weight_search(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 97).cast("double").alias("b"))
    found = stats.weight_search(part, [], "p_retailprice", ["a", "b"], 3, ["p_partkey"])
    return _rounded(found.select("w0", "w1", F.col("recall_at_10").alias("recall")), recall=9)


@_query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') matched, count(*) total, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) fraction FROM orders GROUP BY 1")
def stat_match_coverage(spark, d):
    return _rounded(stats.match_coverage(_t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F"), fraction=9)


@_query("SELECT event_type, CASE WHEN count(value) > 0 THEN min(value) END AS low, max(value) AS high FROM events GROUP BY 1")
def stat_score_range(spark, d):
    out = _t(spark, d, "events").groupBy("event_type").agg(stats.score_range("value").alias("r"))
    return out.select("event_type", F.col("r")[0].alias("low"), F.col("r")[1].alias("high"))


@_query("""WITH m AS (SELECT 'mean' AS metric, round(avg(value), 6) AS value FROM events UNION ALL SELECT 'max', max(value) FROM events),
g(metric, op, bound) AS (VALUES ('mean', '<=', 100.0::DOUBLE), ('max', '>=', 480.0::DOUBLE), ('none', '<=', 1.0::DOUBLE))
SELECT metric, value, bound, CASE WHEN op = '<=' THEN value <= bound ELSE value >= bound END AS passed FROM g LEFT JOIN m USING (metric)""")
def stat_gates(spark, d):
    e = _t(spark, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max")).unpivot([], ["mean", "max"], "metric", "value")
    return stats.gate_verdicts(e, [("mean", "<=", 100.0), ("max", ">=", 480.0), ("none", "<=", 1.0)])


# Curves: events of a user in order; the scale is the place in that order, the score the value on a scale of 100

_CURVE = "c AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10)::BIGINT AS scale, value / 5.0::DOUBLE AS score FROM events)"


def _curve(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("user_id", (F.row_number().over(w) * 10).cast("bigint").alias("scale"), (F.col("value") / 5.0).alias("score"))


@_query(f"WITH {_CURVE} SELECT user_id, scale, score, max(score) OVER (PARTITION BY user_id ORDER BY scale) AS top FROM c")
def curve_running_max(spark, d):
    return curves.running_max(_curve(spark, d), ["user_id"], ["scale"], "score", "top")


_CROSS = f"""WITH {_CURVE}, r AS (SELECT *, row_number() OVER w AS r, lag(scale) OVER w AS px, lag(score) OVER w AS ps FROM c WINDOW w AS (PARTITION BY user_id ORDER BY scale)),
h AS (SELECT user_id, count(*) AS points, arg_min(struct_pack(r, scale, score, px, ps), r) FILTER (score >= 70) AS h FROM r GROUP BY user_id),
s AS (SELECT user_id, points, CASE WHEN h IS NULL THEN 'censored' WHEN h.r = 1 THEN 'floor' ELSE 'crossed' END AS state, h.scale AS x, h.score AS score, h.px AS below_x, h.ps AS below_score FROM h)"""


@_query(_CROSS + " SELECT * FROM s")
def curve_crossing(spark, d):
    return curves.crossing_state(_curve(spark, d), ["user_id"], ["scale"], "score", 70.0)


@_query(_CROSS + """, l AS (SELECT user_id, below_x, x, ln(greatest(100 - below_score, 1e-3)) a, ln(greatest(100 - score, 1e-3)) b, ln(30.0::DOUBLE) t FROM s WHERE state = 'crossed')
SELECT user_id, round(exp(greatest(least(CASE WHEN abs(b - a) < 1e-12 THEN (ln(below_x) + ln(x)) / 2 ELSE ln(below_x) + (ln(x) - ln(below_x)) * (t - a) / (b - a) END, ln(x)), ln(below_x))), 6) AS crossing FROM l""")
def curve_log_loss_crossing(spark, d):
    s = curves.crossing_state(_curve(spark, d), ["user_id"], ["scale"], "score", 70.0).where("state = 'crossed'")
    return s.select("user_id", F.round(curves.log_loss_crossing(F.col("below_x"), F.col("below_score"), F.col("x"), F.col("score"), 70.0), 6).alias("crossing"))


@_query(f"""WITH {_CURVE}, b AS (SELECT user_id, scale x0, lead(scale) OVER w x1, score y0, lead(score) OVER w y1, row_number() OVER w k FROM c WINDOW w AS (PARTITION BY user_id ORDER BY scale)),
t AS (SELECT DISTINCT user_id, unnest([5.0, 33.0, 95.0, 1e6])::DOUBLE AS target FROM events),
m AS (SELECT user_id, target, arg_min(y0 + (target - x0) / (x1 - x0) * (y1 - y0), k) y FROM t JOIN b USING (user_id) WHERE x1 IS NOT NULL AND target BETWEEN x0 AND x1 GROUP BY ALL)
SELECT user_id, target, round(y, 6) AS score_at FROM t LEFT JOIN m USING (user_id, target)""")
def curve_interp(spark, d):
    t = _t(spark, d, "events").select("user_id").distinct().withColumn("target", F.explode(F.lit([5.0, 33.0, 95.0, 1e6])))
    return _rounded(curves.interpolate(t, _curve(spark, d), ["user_id"], "target", "scale", "score"), score_at=6)


@_query(f"""WITH {_CURVE}, m AS (SELECT user_id, scale, max(score) OVER (PARTITION BY user_id ORDER BY scale) AS top FROM c),
b AS (SELECT user_id, scale x0, lead(scale) OVER w x1, top m0, lead(top) OVER w m1 FROM m WINDOW w AS (PARTITION BY user_id ORDER BY scale, top)),
t AS (SELECT DISTINCT user_id, unnest([10.0, 60.0, 90.0, 99.9])::DOUBLE AS target FROM events),
f AS (SELECT user_id, target, min(struct_pack(span := greatest(m0, m1) - least(m0, m1), x0, x1, m0, m1)) b FROM t JOIN b USING (user_id) WHERE x1 IS NOT NULL AND target BETWEEN least(m0, m1) AND greatest(m0, m1) GROUP BY ALL),
e AS (SELECT user_id, target, min(scale) x FROM t JOIN m USING (user_id) WHERE target = top GROUP BY ALL)
SELECT user_id, target, round(coalesce(x, exp(ln(b.x0) + coalesce((target - b.m0) / CASE WHEN b.m1 <> b.m0 THEN b.m1 - b.m0 END, 0) * (ln(b.x1) - ln(b.x0)))), 6) AS setting, CASE WHEN x IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'interpolated' ELSE 'outside' END AS status
FROM t LEFT JOIN f USING (user_id, target) LEFT JOIN e USING (user_id, target)""")
def curve_match_metric(spark, d):
    m = curves.running_max(_curve(spark, d), ["user_id"], ["scale"], "score", "top").select("user_id", "scale", "top")
    t = _t(spark, d, "events").select("user_id").distinct().withColumn("target", F.explode(F.lit([10.0, 60.0, 90.0, 99.9])))
    return _rounded(curves.match_metric(t, m, ["user_id"], "target", "scale", "top", log_rate=True), setting=6)


@_query(f"""WITH {_CURVE}, b AS (SELECT user_id, scale x0, lead(scale) OVER w x1, score y0, lead(score) OVER w y1 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY scale)),
e AS (SELECT user_id, arg_min(score, scale) lo, min(scale) lx, arg_max(score, scale) hi, max(scale) hx FROM c GROUP BY 1),
t AS (SELECT DISTINCT user_id, unnest([5.0, 33.0, 95.0, 1e6])::DOUBLE AS target FROM events)
SELECT t.user_id, target, round(CASE WHEN target <= lx THEN lo WHEN target >= hx THEN hi ELSE y0 + (ln(target) - ln(x0)) / (ln(x1) - ln(x0)) * (y1 - y0) END, 6) AS score_at
FROM t JOIN e USING (user_id) LEFT JOIN b ON t.user_id = b.user_id AND target >= x0 AND target < x1""")
def curve_asof(spark, d):
    t = _t(spark, d, "events").select("user_id").distinct().withColumn("target", F.explode(F.lit([5.0, 33.0, 95.0, 1e6])))
    return _rounded(curves.as_of(t, _curve(spark, d), ["user_id"], "target", "scale", "score"), score_at=6)


_TOP = f"{_CURVE}, m AS (SELECT user_id, scale, max(score) OVER (PARTITION BY user_id ORDER BY scale) AS top FROM c), t AS (SELECT *, ln(greatest(100.0::DOUBLE - top, 1e-3::DOUBLE)) AS l FROM m)"


@_query(f"""WITH {_TOP}, s AS (SELECT user_id, row_number() OVER w - 1 AS segment, ln(scale) - ln(lag(scale) OVER w) dx, l - lag(l) OVER w dy FROM t WINDOW w AS (PARTITION BY user_id ORDER BY scale))
SELECT user_id, segment, round(dx / dy, 2) AS slope FROM s WHERE dy <> 0""")
def curve_slopes(spark, d):
    return _rounded(curves.segment_slopes(_curve(spark, d), ["user_id"], "scale", "score"), slope=2)


@_query(f"WITH {_TOP} SELECT user_id, round(regr_slope(l, ln(scale)), 6) AS exponent FROM t GROUP BY 1")
def curve_loss_exponent(spark, d):
    return _rounded(curves.loss_exponent(_curve(spark, d), ["user_id"], "scale", "score"), exponent=6)


@_query(f"""WITH {_CURVE}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(ln(scale) - ln(100.0::DOUBLE)), scale) r FROM c),
s AS (SELECT user_id, -regr_slope(ln(greatest(100 - score, 1e-3)), ln(scale)) s FROM n WHERE r <= 4 GROUP BY 1) SELECT user_id, round(CASE WHEN s > 0 THEN s END, 6) AS beta FROM s""")
def curve_beta(spark, d):
    return _rounded(curves.local_slope(_curve(spark, d).withColumn("at", F.lit(100.0)), ["user_id"], "scale", "score", "at"), beta=6)


_LINE = "CASE WHEN y1 = y0 THEN CASE WHEN t <= y0 THEN x1 ELSE x0 END ELSE x0 + (t - y0) * (x1 - x0) / (y1 - y0) END"


@_query(f"""WITH {_TOP}, g AS (SELECT user_id, ln(scale) x0, l y0, lead(ln(scale)) OVER w x1, lead(l) OVER w y1, top, ln(15.0::DOUBLE) t, row_number() OVER w k FROM t WINDOW w AS (PARTITION BY user_id ORDER BY scale)),
e AS (SELECT *, {_LINE} AS spot FROM g), f AS (SELECT user_id, any_value(t) t, arg_min(spot, k) FILTER (x1 IS NOT NULL) first_at, arg_min(y0, k) first_y, arg_max(spot, k) FILTER (x1 IS NOT NULL) last_at, arg_max(y0, k) end_y, arg_max(x0, k) end_x, arg_max(top, k) end_top, arg_min(spot, k) FILTER (x1 IS NOT NULL AND y0 >= t AND t >= y1) in_at FROM e GROUP BY 1)
SELECT user_id, round_even(least(greatest(exp(CASE WHEN first_at IS NULL THEN end_x WHEN t >= first_y THEN first_at WHEN t <= end_y THEN last_at ELSE coalesce(in_at, end_x) END), 1), 73728), 0)::BIGINT AS crossing, end_top < 85 AS saturated FROM f""")
def curve_crossing_scale(spark, d):
    return curves.crossing_scale(_curve(spark, d), ["user_id"], "scale", "score", 85.0)


@_query(f"""WITH {_CURVE}, p AS (SELECT user_id, score, lag(score) OVER (PARTITION BY user_id ORDER BY scale) p FROM c)
SELECT user_id, coalesce(bool_and(score >= p), true) rising, coalesce(bool_and(score <= p), true) falling FROM p GROUP BY ALL""")
def curve_monotone(spark, d):
    return curves.monotone(_curve(spark, d), ["user_id"], ["scale"], "score")


@_query(f"WITH {_CURVE} SELECT a.user_id, count(b.scale) AS pairs FROM c a LEFT JOIN c b ON a.user_id = b.user_id AND a.scale < b.scale AND b.score < a.score GROUP BY ALL")
def curve_inversions(spark, d):
    return curves.non_monotone_pairs(_curve(spark, d), ["user_id"], "scale", "score")


@_query(f"""WITH {_CURVE}, b AS (SELECT user_id, scale x0, lead(scale) OVER w x1, score m0, lead(score) OVER w m1 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY scale))
SELECT DISTINCT user_id, (x0 + x1) / 2 AS setting, round(abs(m0 - m1), 6) AS width FROM b WHERE x1 IS NOT NULL AND 50 BETWEEN least(m0, m1) AND greatest(m0, m1) AND abs(m0 - m1) > 40""")
def curve_refine(spark, d):
    t = _t(spark, d, "events").select("user_id").distinct().withColumn("target", F.lit(50.0))
    return _rounded(curves.refinements(_curve(spark, d), t, ["user_id"], "target", "scale", "score", 40.0), width=6)


@_query()
def curve_bd_rate(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus", F.col("l_quantity").alias("quality")).agg(F.avg("l_extendedprice").alias("rate"))
    return curves.bd_rate(rows, ["l_suppkey"], "l_linestatus", "O", "F", "rate", "quality")


# Corpus


@_query("""WITH n AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 3600 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM n) SELECT event_id, first(event_id) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS family FROM g""")
def corpus_bursts(spark, d):
    return corpus.fold_bursts(_t(spark, d, "events"), ["user_id"], "ts", "event_id", 3600.0).select("event_id", "family")


@_query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT *, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM e),
f AS (SELECT *, CASE WHEN coalesce(list_inner_product(e, q) / sqrt(list_inner_product(e, e) * list_inner_product(q, q)), -2) >= 0.1 THEN 0 ELSE 1 END AS f FROM p)
SELECT vec_id, (sum(f) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS chain FROM f""")
def corpus_similar_chain(spark, d):
    return corpus.fold_similar(_t(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding", 0.1).select("vec_id", "chain")


@_query("""WITH u AS (SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM customer)
SELECT c_custkey, CASE WHEN u < 0.2 THEN 'holdout' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'development' ELSE 'calibration' END AS split FROM u""")
def corpus_split(spark, d):
    return _t(spark, d, "customer").select("c_custkey", corpus.split(F.col("c_name"), 0.2, 0.1).alias("split"))


@_query("SELECT c_custkey, (('0x' || substr(sha256('fold:' || c_name), 1, 8))::BIGINT % 5)::INT AS fold FROM customer")
def corpus_fold(spark, d):
    return _t(spark, d, "customer").select("c_custkey", corpus.fold(F.col("c_name"), 5).alias("fold"))


@_query("""WITH h AS (SELECT doc_id, source, doc_id // 3 AS family, sha256(doc_id::VARCHAR) AS h FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY h, doc_id) r FROM h),
t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS turn FROM o WHERE r = 1) SELECT doc_id, source, turn FROM t WHERE turn <= 4 ORDER BY turn, source LIMIT 50""")
def corpus_sample(spark, d):
    rows = _t(spark, d, "documents").withColumn("family", F.floor(F.col("doc_id") / 3))
    return corpus.sample(rows, "source", "family", "doc_id", 4, 50).select("doc_id", "source", "turn")


@_query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_discount > 0.05 THEN 0 ELSE 1 END, l_orderkey, l_linenumber, l_suppkey) r FROM lineitem) WHERE r = 1")
def corpus_dedupe(spark, d):
    out = corpus.dedupe(_t(spark, d, "lineitem"), ["l_partkey"], F.col("l_discount") > 0.05, ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount")


@_query(r"""WITH n AS (SELECT page_id, lower(regexp_extract(url, '[^/]*$')) n FROM pages),
b AS (SELECT *, trim(regexp_replace(regexp_replace(n, '^(\.*[^.].*)\.[^.]*$', '\1'), '(?:[\s_\-]*(?:\(\d+\)|copy|\d{3,4}x\d{3,4}|small|large|hd)\s*)+$', '')) b FROM n) SELECT page_id, CASE WHEN b = '' THEN n ELSE b END AS stem FROM b""")
def corpus_stem(spark, d):
    return _t(spark, d, "pages").select("page_id", text.stem(F.regexp_extract("url", "[^/]*$", 0)).alias("stem"))


@_query("SELECT n_chars, count(DISTINCT source) AS parts FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def corpus_family_audit(spark, d):
    return corpus.spanning_families(_t(spark, d, "documents"), "n_chars", "source")


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def corpus_exclude(spark, d):
    return corpus.exclude(_t(spark, d, "documents"), _t(spark, d, "labels"), ["doc_id"]).select("doc_id", "source")


@_query("SELECT source, list_sort(list(DISTINCT lang)) AS values FROM documents GROUP BY 1")
def corpus_referenced(spark, d):
    return corpus.referenced(_t(spark, d, "documents"), ["source"], "lang")


# Images: 8 x 8 blocks

_PIX = "p AS (SELECT vec_id AS image, label, pos % 8 AS x, pos // 8 AS y, v FROM (SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings))"
_INT = "p AS (SELECT vec_id AS image, pos % 8 AS x, pos // 8 AS y, floor(v * 1000)::BIGINT AS v FROM (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings))"


def _pixels(spark, d):
    return raster.from_blocks(_t(spark, d, "embeddings"), "vec_id", "embedding", 8, F.col("value").cast("double"))


def _integers(spark, d):
    return raster.from_blocks(_t(spark, d, "embeddings"), "vec_id", "embedding", 8, F.floor(F.col("value").cast("double") * 1000))


def _pairs(spark, d):
    a = _pixels(spark, d).where("image % 2 = 0").withColumn("image", F.floor(F.col("image") / 2))
    b = _pixels(spark, d).where("image % 2 = 1").withColumn("image", F.floor(F.col("image") / 2))
    return metrics.pairs(a, b, ["image", "x", "y"])


_PAIR = f"WITH {_PIX}, q AS (SELECT a.image // 2 AS image, a.x, a.y, a.v AS a, b.v AS b FROM p a JOIN p b ON a.image % 2 = 0 AND b.image = a.image + 1 AND a.x = b.x AND a.y = b.y)"


@_query(_PAIR + ", m AS (SELECT image, max(abs(a - b)) pe, sqrt(avg((a - b) * (a - b))) r FROM q GROUP BY 1) SELECT image, pe AS peak_error, round(r, 9) AS rmse, round(CASE WHEN r = 0 THEN 'inf'::DOUBLE ELSE 20 * log10(1.0 / r) END, 6) AS psnr_db FROM m")
def metric_rmse_psnr(spark, d):
    return _rounded(metrics.quality(_pairs(spark, d), ["image"], 1.0), rmse=9, psnr_db=6)


@_query(_PAIR + ", m AS (SELECT image, y, max(abs(a - b)) pe, sqrt(avg((a - b) * (a - b))) r FROM q GROUP BY ALL) SELECT image, bool_and(pe <= 0.6 AND r <= 0.25) AS conforms FROM m GROUP BY 1")
def metric_similarity(spark, d):
    return metrics.conforms(metrics.quality(_pairs(spark, d), ["image", "y"], 1.0), ["image"], 0.6, 0.25)


@_query(_PAIR + " SELECT image, round(avg(abs(a - b)), 9) AS norm1, round(pow(avg(pow(abs(a - b), 4)), 0.25), 9) AS norm4 FROM q GROUP BY 1")
def metric_pooled_norms(spark, d):
    return _rounded(metrics.pooled_norms(_pairs(spark, d), ["image"]), norm1=9, norm4=9)


@_query(_PAIR + ", m AS (SELECT image, y, avg(abs(a - b)) n FROM q GROUP BY ALL), k AS (SELECT image, n, row_number() OVER (PARTITION BY image ORDER BY y) - 1 k FROM m) SELECT image, round(e, 6) AS error, round(CASE WHEN y > 0 THEN 100 - 10 * pow(y, 0.6276336467831387::DOUBLE) ELSE 100 END, 6) AS score FROM (SELECT *, 6.248496625763138e-5 * x * x * x + 2.326765642916932::DOUBLE * x - 0.020884521182843837::DOUBLE * x * x AS y FROM (SELECT image, sum(n * (k + 1)::DOUBLE) AS e, e * 0.9562382616834844::DOUBLE AS x FROM k GROUP BY 1))")
def metric_weighted_error(spark, d):
    rows = metrics.pooled_norms(_pairs(spark, d), ["image", "y"])
    weights = spark.createDataFrame([(k, float(k + 1)) for k in range(8)], "k int, weight double")
    out = metrics.weighted_error(rows, ["image"], ["y"], "norm1", weights)
    return _rounded(out.withColumn("score", pixel.score_remap(F.col("error"))), error=6, score=6)


@_query(_PAIR + " SELECT image, avg(CASE WHEN floor(a * 10) <> floor(b * 10) THEN 1.0 ELSE 0.0 END)::DOUBLE AS churn FROM q GROUP BY 1")
def metric_churn(spark, d):
    side = lambda k: _pixels(spark, d).where(f"image % 2 = {k}").select(F.floor(F.col("image") / 2).alias("image"), "x", "y", F.floor(F.col("v") * 10).alias("c"))
    return metrics.churn(side(0), side(1), ["image"], ["x", "y"], "c")


@_query(f"WITH {_PIX} SELECT image, (y // 4)::INT ty, (x // 4)::INT tx, round(avg(v), 9) AS mean, min(v) low, max(v) high, count(*) n, round(greatest(avg(v * v) - avg(v) * avg(v), 0), 9) AS variance FROM p GROUP BY ALL")
def raster_tile_stats(spark, d):
    return _rounded(raster.tiles(_pixels(spark, d), 4), mean=9, variance=9)


_NEAR = f"""WITH {_INT}, u AS (SELECT *, lag(v) OVER (PARTITION BY image, x ORDER BY y) n0, lag(v, 2) OVER (PARTITION BY image, x ORDER BY y) nn0, lag(v) OVER (PARTITION BY image, y ORDER BY x) w0, lag(v, 2) OVER (PARTITION BY image, y ORDER BY x) ww0 FROM p),
g AS (SELECT *, lag(n0) OVER r nw0, lead(n0) OVER r ne0, lead(n0, 2) OVER r nee0 FROM u WINDOW r AS (PARTITION BY image, y ORDER BY x)),
a AS (SELECT *, coalesce(w0, n0, 0) w FROM g), b AS (SELECT *, coalesce(n0, w) n, coalesce(nw0, w) nw, coalesce(ww0, w) ww FROM a),
e AS (SELECT *, coalesce(ne0, n) ne, coalesce(nn0, n) nn, coalesce(nee0, ne0, n) nee FROM b)"""


@_query(_NEAR + " SELECT image, x, y, v, w, n, nw, ne, nn, nee, ww FROM e")
def raster_neighbours(spark, d):
    return raster.neighbours(_integers(spark, d)).select("image", "x", "y", "v", "w", "n", "nw", "ne", "nn", "nee", "ww")


@_query(_NEAR + """, c AS (SELECT image, sum(abs(v)) zero, sum(abs(v - w)) west, sum(abs(v - n)) north, sum(abs(v - (w + n) // 2)) avg_wn, sum(abs(v - CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END)) "select",
sum(abs(v - least(greatest(w + n - nw, least(w, n)), greatest(w, n)))) gradient, sum(abs(v - ne)) north_east, sum(abs(v - nw)) north_west, sum(abs(v - ww)) west_west, sum(abs(v - (w + nw) // 2)) avg_wnw, sum(abs(v - (n + nw) // 2)) avg_nnw, sum(abs(v - (n + ne) // 2)) avg_nne, sum(abs(v - (6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) // 16)) avg_all FROM e GROUP BY 1)
SELECT image, predictor, cost::BIGINT AS cost FROM c UNPIVOT (cost FOR predictor IN (zero, west, north, avg_wn, "select", gradient, north_east, north_west, west_west, avg_wnw, avg_nnw, avg_nne, avg_all))""")
def raster_predictors(spark, d):
    return raster.residual_cost(_integers(spark, d))


@_query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 256 r, l_partkey % 256 g, l_suppkey % 256 b FROM lineitem), f AS (SELECT *, r - b co FROM i), h AS (SELECT *, g - (b + (co >> 1)) cg FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, b + (co >> 1) + (cg >> 1) AS luma, co, cg, true AS same FROM h""")
def raster_rct_roundtrip(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[(F.col(c) % 256).alias(n) for c, n in (("l_orderkey", "r"), ("l_partkey", "g"), ("l_suppkey", "b"))])
    y, co, cg = pixel.rct_forward(F.col("r"), F.col("g"), F.col("b"))
    coded = rows.withColumns({"luma": y, "co": co, "cg": cg})
    r, g, b = pixel.rct_inverse(F.col("luma"), F.col("co"), F.col("cg"))
    return coded.withColumn("same", (r == F.col("r")) & (g == F.col("g")) & (b == F.col("b"))).drop("r", "g", "b")


@_query(f"""WITH {_INT}, h AS (SELECT image, y, x // 2 AS x, max(v) FILTER (x % 2 = 0) a, max(v) FILTER (x % 2 = 1) b FROM p GROUP BY ALL), m AS (SELECT *, a - (a - b) // 2 AS average FROM h),
s AS (SELECT *, coalesce(lead(average) OVER w, average) nx, coalesce(lag(b) OVER w, average) lf FROM m WINDOW w AS (PARTITION BY image, y ORDER BY x)),
t AS (SELECT *, CASE WHEN lf >= average AND average >= nx THEN (4 * lf - 3 * nx - average + 6) // 12 WHEN lf <= average AND average <= nx THEN (4 * lf - 3 * nx - average - 6) // 12 ELSE 0 END e0 FROM s),
e1 AS (SELECT *, CASE WHEN lf >= average AND average >= nx THEN CASE WHEN e0 - (e0 & 1) > 2 * (lf - average) THEN 2 * (lf - average) + 1 ELSE e0 END WHEN lf <= average AND average <= nx THEN CASE WHEN e0 + (e0 & 1) < 2 * (lf - average) THEN 2 * (lf - average) - 1 ELSE e0 END ELSE 0 END e1 FROM t),
e2 AS (SELECT *, CASE WHEN lf >= average AND average >= nx THEN CASE WHEN e1 + (e1 & 1) > 2 * (average - nx) THEN 2 * (average - nx) ELSE e1 END WHEN lf <= average AND average <= nx THEN CASE WHEN e1 - (e1 & 1) < 2 * (average - nx) THEN 2 * (average - nx) ELSE e1 END ELSE 0 END e2 FROM e1)
SELECT image, y, x, average, a - b - e2 AS residual FROM e2""")
def raster_squeeze(spark, d):
    return raster.squeeze_rows(_integers(spark, d))


@_query(f"WITH {_INT} SELECT image, x, y, v FROM p")
def raster_unsqueeze(spark, d):
    return raster.unsqueeze_rows(raster.squeeze_rows(_integers(spark, d)))


@_query(f"WITH {_INT}, m AS (SELECT *, min(v) OVER (PARTITION BY image, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) m FROM p) SELECT image, x, y, v, min(m) OVER (PARTITION BY image, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS eroded FROM m")
def raster_erode(spark, d):
    return raster.erode(_integers(spark, d))


@_query(f"""WITH {_PIX}, h AS (SELECT *, coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) h, coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) vv FROM p WINDOW r AS (PARTITION BY image, y ORDER BY x), c AS (PARTITION BY image, x ORDER BY y)),
k AS (SELECT *, coalesce(lag(h) OVER c, h) + coalesce(lead(h) OVER c, h) dd FROM h WINDOW c AS (PARTITION BY image, x ORDER BY y))
SELECT image, x, y, round((v + 0.115169525::DOUBLE * (h + vv) + 0.061248592::DOUBLE * dd) / (1 + 4 * 0.115169525::DOUBLE + 4 * 0.061248592::DOUBLE), 9) AS v FROM k""")
def raster_gaborish(spark, d):
    return _rounded(raster.gaborish(_pixels(spark, d)), v=9)


@_query(f"""WITH {_PIX}, o AS (SELECT unnest(range(-2, 3)) AS o), m AS (SELECT i, o, CASE WHEN i + o < 0 THEN -1 - i - o WHEN i + o > 7 THEN 15 - i - o ELSE i + o END AS j FROM range(8) t(i), o)
SELECT c.image, c.x, c.y, round(0.16::DOUBLE * sum(n.v) - 4.0::DOUBLE * c.v, 8) AS v FROM p c JOIN m mx ON mx.i = c.x JOIN m my ON my.i = c.y JOIN p n ON n.image = c.image AND n.x = mx.j AND n.y = my.j GROUP BY c.image, c.x, c.y, c.v""")
def raster_laplacian(spark, d):
    return _rounded(raster.laplacian(_pixels(spark, d)), v=8)


@_query(f"""WITH {_PIX}, b AS (SELECT u, x, CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END * cos((2 * x + 1) * u * pi() / 16) / 8 AS c FROM range(8) t(u), range(8) s(x))
SELECT image, r.u::INT AS u, q.u::INT AS w, round(sum(v * r.c * q.c), 7) + 0.0 AS coefficient FROM p JOIN b r ON r.x = p.x JOIN b q ON q.x = p.y GROUP BY ALL""")
def raster_dct8(spark, d):
    out = raster.dct_blocks(_t(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return out.withColumn("coefficient", F.round("coefficient", 7) + 0.0)


@_query(f"WITH {_PIX} SELECT image, x, y, round(v, 6) + 0.0 AS v FROM p")
def raster_dct8_roundtrip(spark, d):
    return raster.inverse_dct(raster.dct(_pixels(spark, d), 8), 8).select("image", "x", "y", (F.round("v", 6) + 0.0).alias("v"))


@_query(f"WITH {_PIX} SELECT image, (x // 2)::INT AS x, (y // 2)::INT AS y, round(avg(v), 9) AS v FROM p GROUP BY ALL")
def raster_pyramid(spark, d):
    return _rounded(raster.pyramid(_pixels(spark, d)), v=9)


@_query(f"""WITH {_PIX}, o AS (SELECT *, image % 8 + 1 AS o FROM p) SELECT image, CASE WHEN o IN (1, 4) THEN x WHEN o IN (2, 3) THEN 7 - x WHEN o IN (5, 8) THEN y ELSE 7 - y END AS x,
CASE WHEN o IN (1, 2) THEN y WHEN o IN (3, 4) THEN 7 - y WHEN o IN (5, 6) THEN x ELSE 7 - x END AS y, v FROM o""")
def raster_orientation(spark, d):
    nx, ny = pixel.orient(F.col("image") % 8 + 1, F.col("x"), F.col("y"), F.lit(8), F.lit(8))
    return _pixels(spark, d).select("image", nx.alias("x"), ny.alias("y"), "v")


@_query(_PAIR + """, m AS (SELECT *, CASE image % 5 WHEN 0 THEN 'replace' WHEN 1 THEN 'add' WHEN 2 THEN 'mul' WHEN 3 THEN 'muladd' ELSE 'blend' END AS mode, least(greatest(abs(b), 0), 1) AS al FROM q), o AS (SELECT *, al * (1 - 0.5::DOUBLE) + 0.5::DOUBLE AS t FROM m)
SELECT image, x, y, round(CASE mode WHEN 'replace' THEN b WHEN 'add' THEN a + b WHEN 'mul' THEN a * least(greatest(b, 0), 1) WHEN 'muladd' THEN a + al * b ELSE (al * b + 0.5::DOUBLE * a * (1 - al)) / t END, 9) + 0.0 AS v FROM o""")
def raster_blend(spark, d):
    mode = F.element_at(F.lit(["replace", "add", "mul", "muladd", "blend"]), (F.col("image") % 5 + 1).cast("int"))
    value = pixel.blend(mode, F.col("a"), F.col("b"), F.lit(0.5), F.abs("b"))
    return _pairs(spark, d).select("image", "x", "y", (F.round(value, 9) + 0.0).alias("v"))


@_query("WITH f AS (SELECT p_brand, p_size // 8 AS band, min(p_partkey) AS first, count(*) n FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS index, count(*) OVER () a FROM f) SELECT p_brand, band, first, n, index FROM k WHERE a <= 256")
def raster_palette(spark, d):
    return raster.palette(_t(spark, d, "part").withColumn("band", F.floor(F.col("p_size") / 8)), ["p_brand", "band"], "p_partkey")


@_query("""SELECT image, pixels, least(n, 40) AS colours, n > 40 AS capped, CASE WHEN n > 40 THEN 'photo' WHEN least(n, 40) <= 65536 AND pixels / least(n, 40) >= 2 THEN 'text' ELSE 'unknown' END AS route FROM (SELECT vec_id AS image, count(*) pixels, count(DISTINCT floor(v * 40)) n FROM (SELECT vec_id, unnest(embedding)::DOUBLE v FROM embeddings) GROUP BY 1)""")
def raster_route(spark, d):
    return raster.route(raster.colour_census(_pixels(spark, d), "image", F.floor(F.col("v") * 40), cap=40), dense=2.0)


@_query(f"""WITH {_PIX} SELECT image, x - 2 AS x, y - 1 AS y, v FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6""")
def raster_crop(spark, d):
    return raster.crop(_pixels(spark, d), 2, 1, 4, 6)


@_query(f"""WITH {_PIX}, c AS (SELECT * FROM p WHERE image % 2 = 0), f AS (SELECT image - 1 AS image, x + 2 AS x, y + 3 AS y, v AS nv, least(abs(v), 1) AS a FROM p WHERE image % 2 = 1 AND x < 4 AND y < 4)
SELECT c.image, c.x, c.y, round(CASE WHEN nv IS NULL THEN c.v ELSE (a * nv + c.v * (1 - a)) / (a * (1 - 1.0) + 1.0) END, 9) + 0.0 AS v FROM c LEFT JOIN f USING (image, x, y)""")
def raster_composite(spark, d):
    p = _pixels(spark, d)
    frame = p.where("image % 2 = 1 and x < 4 and y < 4").select((F.col("image") - 1).alias("image"), "x", "y", "v", F.abs("v").alias("alpha"))
    out = raster.composite(p.where("image % 2 = 0"), frame, "blend", 2, 3)
    return out.select("image", "x", "y", (F.round("v", 9) + 0.0).alias("v"))


@_query(f"""WITH {_PIX}, l AS (SELECT image, x, y, CASE WHEN abs(v) <= 0.04045 THEN v / 12.92 ELSE sign(v) * pow((abs(v) + 0.055) / 1.055, 2.4) END AS l FROM p) SELECT image, x, y, round(l, 8) + 0.0 AS linear, true AS back FROM l""")
def raster_transfer(spark, d):
    rows = _pixels(spark, d).withColumn("linear", pixel.srgb_to_linear(F.col("v")))
    return rows.select("image", "x", "y", (F.round("linear", 8) + 0.0).alias("linear"), (F.abs(pixel.linear_to_srgb(F.col("linear")) - F.col("v")) < 1e-6).alias("back"))


@_query(f"""WITH {_PIX}, s AS (SELECT image, y, x, abs(v) AS r, abs(lead(v, 1, 0.1::DOUBLE) OVER w) AS g, abs(lag(v, 1, 0.1::DOUBLE) OVER w) AS b FROM p WINDOW w AS (PARTITION BY image, y ORDER BY x)),
k AS (SELECT *, pow(0.0037930732552754493::DOUBLE, 1.0::DOUBLE / 3) c FROM s), m AS (SELECT *, cbrt(0.3::DOUBLE * r + 0.622::DOUBLE * g + 0.078::DOUBLE * b + 0.0037930732552754493::DOUBLE) - c l, cbrt(0.23::DOUBLE * r + 0.692::DOUBLE * g + 0.078::DOUBLE * b + 0.0037930732552754493::DOUBLE) - c m, cbrt(0.24342268924547819::DOUBLE * r + 0.20476744424496821::DOUBLE * g + 0.55180986650955360::DOUBLE * b + 0.0037930732552754493::DOUBLE) - c s FROM k)
SELECT image, x, y, round((l - m) / 2, 7) + 0.0 AS xx, round((l + m) / 2, 7) + 0.0 AS yy, round(s, 7) + 0.0 AS bb, true AS back FROM m""")
def raster_xyb(spark, d):
    w = Window.partitionBy("image", "y").orderBy("x")
    rgb = _pixels(spark, d).select("image", "y", "x", F.abs("v").alias("r"), F.abs(F.lead("v", 1, 0.1).over(w)).alias("g"), F.abs(F.lag("v", 1, 0.1).over(w)).alias("b"))
    x, y, b = pixel.linear_to_xyb(F.col("r"), F.col("g"), F.col("b"))
    rows = rgb.withColumns({"xx": x, "yy": y, "bb": b})
    r, g, bl = pixel.xyb_to_linear(F.col("xx"), F.col("yy"), F.col("bb"))
    same = (F.abs(r - F.col("r")) < 1e-6) & (F.abs(g - F.col("g")) < 1e-6) & (F.abs(bl - F.col("b")) < 1e-6)
    return rows.select("image", "x", F.col("y"), *[(F.round(c, 7) + 0.0).alias(c) for c in ("xx", "yy", "bb")], same.alias("back"))


@_query()
def raster_self_correcting(spark, d):
    return sequences.self_correcting(_integers(spark, d))


_TAPS = sequences.blur_taps()


def _blurred(v: str, along: str, of: str) -> str:
    near = " + ".join(f"{t!r}::DOUBLE * (coalesce(lag({v}, {k}) OVER w, 0) + coalesce(lead({v}, {k}) OVER w, 0))" for k, t in enumerate(_TAPS) if k)
    return f"SELECT image, x, y, {_TAPS[0]!r}::DOUBLE * {v} + {near} AS v FROM {of} WINDOW w AS (PARTITION BY image, {'y' if along == 'x' else 'x'} ORDER BY {along})"


@_query(f"WITH {_PIX}, h AS ({_blurred('v', 'x', 'p')}), b AS ({_blurred('v', 'y', 'h')}) SELECT image, x, y, round(v, 9) + 0.0 AS v FROM b")
def raster_blur(spark, d):
    return sequences.blur(_pixels(spark, d)).withColumn("v", F.round("v", 9) + 0.0)


# Entropy



@_query("""WITH h AS (SELECT lang, hex(encode(text)) AS h FROM documents WHERE length(text) > 0), v AS (SELECT lang, ('0x' || substr(h, 2 * k + 1, 2))::INT AS value FROM (SELECT lang, h, unnest(range(0, length(h) // 2)) AS k FROM h)) SELECT lang, value, count(*) n FROM v GROUP BY ALL""")
def entropy_census(spark, d):
    return entropy.byte_census(_t(spark, d, "documents"), ["lang"], "text")


@_query("WITH c AS (SELECT l_returnflag, l_quantity::BIGINT AS value, count(*) n FROM lineitem GROUP BY ALL) SELECT l_returnflag, sum(n)::BIGINT AS symbols, round(sum(n) * log2(sum(n)) - sum(n * log2(n)) + sum(n * (value % 4)), 4) AS bits FROM c GROUP BY 1")
def entropy_cost(spark, d):
    c = entropy.census(_t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("value")), ["l_returnflag"], "value")
    return _rounded(entropy.shannon_cost(c, ["l_returnflag"], F.col("value") % 4), bits=4)


@_query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 5000 AS v FROM lineitem), n AS (SELECT *, length(bin(v)) - 1 AS n FROM v), t AS (SELECT *, v - (1::BIGINT << n::INT) AS m FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v < 16 THEN v ELSE 16 + ((n - 4) << 2) + (m >> (n - 2)::INT) END::BIGINT AS token, CASE WHEN v < 16 THEN 0 ELSE n - 2 END::BIGINT AS bits, CASE WHEN v < 16 THEN 0 ELSE m & ((1::BIGINT << (n - 2)::INT) - 1) END::BIGINT AS extra, true AS same FROM t""")
def entropy_hybrid_uint(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 5000).alias("v"))
    token, bits, extra = pixel.hybrid_token(F.col("v"))
    coded = rows.withColumns({"token": token, "bits": bits, "extra": extra})
    return coded.withColumn("same", pixel.hybrid_value(F.col("token"), F.col("extra")) == F.col("v")).drop("v")


@_query("WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey - l_suppkey * 10 AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS packed, true AS same FROM v")
def entropy_pack_signed(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") - F.col("l_suppkey") * 10).alias("v"))
    return rows.withColumn("packed", pixel.pack_signed(F.col("v"))).withColumn("same", pixel.unpack_signed(F.col("packed")) == F.col("v")).drop("v")


@_query()
def entropy_huffman(spark, d):
    counts = entropy.byte_census(_t(spark, d, "documents"), ["lang"], "text")
    return entropy.canonical_codes(entropy.huffman_lengths(counts, ["lang"], "value"), ["lang"], "value")


@_query("""WITH c AS (SELECT l_returnflag, l_quantity::BIGINT AS value, count(*) n FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag)::BIGINT t FROM c),
p AS (SELECT *, greatest(1, n * 4096 // t) p, row_number() OVER (PARTITION BY l_returnflag ORDER BY (n * 4096) % t DESC, value) r FROM t)
SELECT l_returnflag, value, n, (p + CASE WHEN r <= 4096 - sum(p) OVER (PARTITION BY l_returnflag) THEN 1 ELSE 0 END)::BIGINT AS p FROM p""")
def entropy_normalised(spark, d):
    c = entropy.census(_t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("value")), ["l_returnflag"], "value")
    return entropy.normalised(c, ["l_returnflag"], "value")


@_query()
def entropy_cluster(spark, d):
    c = _t(spark, d, "part").groupBy("p_brand", F.col("p_size").alias("value")).agg(F.count("*").alias("n"))
    return entropy.cluster(c, "p_brand", "value", 5)


@_query()
def entropy_lz77(spark, d):
    return sequences.lz77(_t(spark, d, "documents"), "doc_id", "text")


# Sources


@_query("SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE html>') THEN 'document' WHEN starts_with(html, '<') THEN 'fragment' ELSE 'unknown' END AS kind FROM pages")
def src_sniff(spark, d):
    from tessera.sources import files

    return _t(spark, d, "pages").select("page_id", files.sniff(F.col("html").cast("binary"), [(b"<!DOCTYPE html>", "document"), (b"<", "fragment")]).alias("kind"))


@_query("SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def src_toc_offsets(spark, d):
    from tessera.sources import files

    return files.offsets(_t(spark, d, "documents"), ["source"], ["doc_id"], "n_chars", "start").select("doc_id", "source", "start")


@_query("SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL")
def src_records(spark, d):
    from tessera.sources import records

    e = _t(spark, d, "events").select(F.lit("measure/1").alias("schema"), "event_id", "event_type", "value")
    return records.parse(e.select(records.line(e).alias("line")), "schema string, event_id bigint, event_type string, value double", ["measure/1"]).where("value is not null").drop("schema")


# Models


@_query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings), a AS (SELECT label, pos, avg(v) v FROM (SELECT label, generate_subscripts(embedding, 1) pos, unnest(embedding)::DOUBLE v FROM embeddings) GROUP BY ALL),
c AS (SELECT label cl, list(v ORDER BY pos) ce FROM a GROUP BY 1), m AS (SELECT vec_id, cl, list_distance(e, ce) d FROM q, c WHERE label <> cl),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cl) r FROM m), k AS (SELECT *, min(d) OVER (PARTITION BY vec_id) l FROM r WHERE r <= 3)
SELECT vec_id, round(sum(cl / (d + 1e-6)) / sum(1 / (d + 1e-6)), 5) AS prediction, count(*) used, round(min(d), 6) AS distance FROM k WHERE d <= l * 1.1::DOUBLE + 1e-6 GROUP BY 1""")
def model_knn(spark, d):
    e = _t(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    cases = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x.v).alias("embedding"))
    cases = cases.select(F.col("label").alias("case"), "label", "embedding", F.col("label").cast("double").alias("value"))
    out = models.nearest_cases(e, cases, "vec_id", "case", "embedding", "value", [1.0] * 64, 3, 1.1, 1e-6, "label")
    return _rounded(out, prediction=5, distance=6)


@_query("SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, count(*) n FROM lineitem GROUP BY 1")
def model_ols(spark, d):
    return _rounded(models.simple_slope(_t(spark, d, "lineitem"), ["l_returnflag"], F.ln("l_quantity"), F.ln("l_extendedprice")), slope=6, intercept=6)


@_query("""WITH m AS (SELECT l_returnflag, count(*)::DOUBLE n, sum(l_quantity) sx, sum(l_quantity * l_quantity) sxx, sum(l_extendedprice) sy, sum(l_quantity * l_extendedprice) sxy FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(((sxx + 0.001) * sy - sx * sxy) / (n * (sxx + 0.001) - sx * sx), 3) AS w0, round((n * sxy - sx * sy) / (n * (sxx + 0.001) - sx * sx), 4) AS w1 FROM m""")
def model_ridge(spark, d):
    out = models.ridge(_t(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    return out.select("l_returnflag", F.round(F.col("w")[0], 3).alias("w0"), F.round(F.col("w")[1], 4).alias("w1"))


@_query()
def model_quantile_reg(spark, d):
    rows = _t(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("price"))
    return models.grouped_fit(rows, ["l_suppkey"], ["l_quantity", "l_discount"], "price", lambda x, y: models.fit_quantile(x, y, 0.9))


@_query()
def model_logistic(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("source", F.ln(F.col("n_chars") + 1.0).alias("size"), "quality")
    return models.logistic(rows, ["source"], ["size"], "quality")


@_query()
def model_grouped_cv(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("fold", corpus.fold(F.col("l_suppkey").cast("string"), 5))
    return models.cross_validated(rows, "fold", 5, ["l_quantity", "l_discount"], "l_extendedprice").withColumn("rmse", F.round("rmse", 4))


@_query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 k FROM events), p AS (SELECT a.user_id, a.k // 2 rep, b.value / a.value ratio FROM r a JOIN r b ON a.user_id = b.user_id AND a.k % 2 = 0 AND b.k = a.k + 1 WHERE a.value <> 0),
s AS (SELECT user_id, list(ratio ORDER BY rep) s, count(*) n FROM p WHERE ratio IS NOT NULL GROUP BY 1), d AS (SELECT user_id, n, s, unnest(range(1, 101)) d FROM s WHERE n >= 3),
m AS (SELECT user_id, list_aggregate(list_transform(range(1, n + 1), lambda i: s[('0x' || substr(md5('7:' || d || ':' || i), 1, 12))::BIGINT % n + 1]), 'median') m FROM d), e AS (SELECT user_id, list(m ORDER BY m) m FROM m GROUP BY 1)
SELECT user_id, n AS pairs, round(list_aggregate(s, 'median'), 9) AS ratio, round(m[3], 9) AS low, round(m[98], 9) AS high, CASE WHEN m[98] < 1 THEN 'FASTER' WHEN m[3] > 1 THEN 'SLOWER' ELSE 'INCONCLUSIVE' END AS verdict FROM s LEFT JOIN e USING (user_id)""")
def ab_bootstrap(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    runs = _t(spark, d, "events").select("user_id", "value", k.alias("k"))
    runs = runs.select("user_id", "value", F.floor(F.col("k") / 2).alias("rep"), F.when(F.col("k") % 2 == 0, "base").otherwise("new").alias("arm"))
    pairs = models.paired(runs, ["user_id"], "arm", "base", "rep", "value")
    return _rounded(models.bootstrap(pairs, ["user_id"], "ratio", ["rep"], 100), ratio=9, low=9, high=9)


# Plans over priced ladders

_LADDER = "l AS (SELECT l_orderkey, l_linenumber AS rung, sum(l_extendedprice) AS size, sum(l_quantity) AS score FROM lineitem GROUP BY ALL)"


def _ladder(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("rung")).agg(F.sum("l_extendedprice").alias("size"), F.sum("l_quantity").alias("score"))


@_query(f"WITH {_LADDER}, m AS (SELECT l_orderkey, max(struct_pack(size, rung)) FILTER (size <= 40000) m FROM l GROUP BY 1) SELECT l_orderkey, m.rung AS rung, round(m.size, 4) AS size FROM m")
def plan_rate_search(spark, d):
    return _rounded(ladder.largest_within(_ladder(spark, d), ["l_orderkey"], "rung", "size", F.lit(40000.0)), size=4)


@_query(f"WITH {_LADDER}, m AS (SELECT l_orderkey, min(struct_pack(size, rung, score)) FILTER (score >= 30) m FROM l GROUP BY 1) SELECT l_orderkey, m.rung AS rung, round(m.size, 4) AS size, m.score AS score FROM m")
def plan_quality_search(spark, d):
    return _rounded(ladder.smallest_reaching(_ladder(spark, d), ["l_orderkey"], "rung", "size", "score", F.lit(30.0)), size=4)


@_query(f"""WITH {_PIX}, c0 AS (SELECT image, x, y, floor(abs(v) * 1000) + 40 AS c FROM p), c1 AS (SELECT image, x // 2 x, y // 2 y, sum(c) s, floor(max(c) * 2.5::DOUBLE) AS own FROM c0 GROUP BY ALL), b1 AS (SELECT *, least(s, own) b, CASE WHEN own <= s THEN 1 ELSE 4 END n FROM c1),
c2 AS (SELECT image, x // 2 x, y // 2 y, sum(b) s, sum(n) n, floor(max(own) * 2.5::DOUBLE) AS own FROM b1 GROUP BY ALL) SELECT image, x::BIGINT AS x, y::BIGINT AS y, least(s, own) AS best, CASE WHEN own <= s THEN 1 ELSE n END::BIGINT AS nodes FROM c2""")
def plan_quadtree(spark, d):
    leaf = _pixels(spark, d).select("image", F.lit(0).alias("level"), F.col("x").cast("bigint"), F.col("y").cast("bigint"), (F.floor(F.abs("v") * 1000) + 40).cast("double").alias("cost"))
    up = lambda rows, level: rows.groupBy("image", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.floor(F.max("cost") * 2.5).cast("double").alias("cost")).select("image", F.lit(level).alias("level"), "x", "y", "cost")
    one = up(leaf, 1)
    return ladder.quadtree_cover(leaf.unionAll(one).unionAll(up(one, 2)), ["image"], 2)


@_query()
def plan_best_factor(spark, d):
    rows = _t(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"))
    return ladder.best_factor(rows, ["l_suppkey"], "x", "y", 84, -128, 127)


@_query("""WITH n AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 3600 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM n) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_bursts(spark, d):
    from tessera.streaming import bursts

    return bursts.sessions(_t(spark, d, "events"), "user_id", "ts", 3600).select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | queries_more.QUERIES | queries_held_out.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | queries_more.SQL | queries_held_out.SQL
