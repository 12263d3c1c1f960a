"""Histograms of fixed bins as mergeable quantile sketches, and summaries of transformed blocks that use them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where the bins of a logarithm begin, their width and number; what keeps a logarithm finite.
LOW, WIDTH, BINS, EPSILON = -46.0, 0.125, 512, 1e-30


def log_bin(ln: Column) -> Column:
    """Number of a logarithm's bin; what lies beyond the bins is in the first or the last. Null and NaN have none."""
    return F.when(~F.isnan(ln), F.floor(F.greatest(F.least((ln - LOW) / WIDTH, F.lit(BINS - 1.0)), F.lit(0.0))).cast("int"))


def log_sketch(df: DataFrame, by: Sequence[str], ln: Column) -> DataFrame:
    """by, bin, n: at most BINS rows for each group, whatever it holds; no hot group, for bins are counted before the shuffle."""
    return df.select(*by, log_bin(ln).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def merged(sketches: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One sketch of what several have seen: counts add up."""
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """by and, for each name, the middle of the bin that holds the value at int(min(q n, n - 1)).

    Within the bins it is at most half a WIDTH from that value. A group is one array of at most BINS counts.
    """
    total = F.col("_n")
    lists = sketch.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("_s"), F.sum("n").alias("_n"))

    def at(q: float) -> Column:
        want = F.floor(F.least(F.lit(q) * total, total - 1.0))
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bin"))
        step = lambda a, e: F.struct((a["seen"] + e["n"]).alias("seen"), F.when(a["bin"].isNull() & (a["seen"] + e["n"] > want), e["bin"]).otherwise(a["bin"]).alias("bin"))
        return LOW + (F.aggregate("_s", start, step, lambda a: a["bin"]) + 0.5) * WIDTH

    return lists.select(*by, *[at(q).alias(name) for name, q in quantiles.items()])


def _masked(values: Column, keep: Sequence[bool]) -> Column:
    """Sum of squares of the coefficients that are kept."""
    return F.aggregate(F.zip_with(values, F.lit([float(k) for k in keep]), lambda v, k: v * v * k), F.lit(0.0), lambda a, v: a + v)


def transform_partials(blocks: DataFrame, by: Sequence[str], y: str, x: str, b: str, side: int = 8) -> DataFrame:
    """by, bin and sums of blocks of coefficients (arrays of side x side, row after row, of three planes): what merges by addition.

    Blocks with a null or wrongly sized array are left out. A block's sums need no other row, so nothing but at most BINS
    rows for each group and task is shuffled.
    """
    cells = [(k // side, k % side) for k in range(side * side)]
    ac = [k > 0 for k in range(side * side)]
    whole = blocks.where((F.size(y) == side * side) & (F.size(x) == side * side) & (F.size(b) == side * side))
    near = lambda most: F.size(F.filter(F.slice(F.col(y), 2, side * side), lambda v: F.abs(v) < most))
    dc = F.get(F.col(y), F.lit(0))
    parts = whole.select(
        *by, _masked(F.col(y), ac).alias("_y"), _masked(F.col(y), [k > 0 and r + c <= 2 for k, (r, c) in enumerate(cells)]).alias("_low"),
        _masked(F.col(y), [max(r, c) >= side // 2 for r, c in cells]).alias("_high"), _masked(F.col(y), [r > c for r, c in cells]).alias("_row"), _masked(F.col(y), [c > r for r, c in cells]).alias("_col"),
        (_masked(F.col(x), ac) + _masked(F.col(b), ac)).alias("_xb"), near(1e-3).alias("_near3"), near(1e-2).alias("_near2"), dc.alias("_dc"), (dc * dc).alias("_dc2"),
    )
    sums = [c for c in parts.columns if c.startswith("_")]
    return parts.withColumn("bin", log_bin(F.ln(F.col("_y") + EPSILON))).groupBy(*by, "bin").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])


def transform_summary(partials: DataFrame, by: Sequence[str], side: int = 8) -> DataFrame:
    """by, blocks and ten features of the blocks' energy, from `transform_partials` (of one table, or several united).

    Log of the mean and the 0.5, 0.9, 0.99 quantiles (of the sketch) of a block's energy without its mean; high to low
    frequencies; lines to columns; colour to luma; shares of coefficients near zero; variance of the means.
    """
    names = [c for c in partials.columns if c.startswith("_")]
    sums = partials.groupBy(*by).agg(F.sum("n").alias("blocks"), *[F.sum(c).alias(c) for c in names])
    ends = sketch_quantiles(merged([partials.select(*by, "bin", "n")], by), by, {"ln_ac_y_q50": 0.5, "ln_ac_y_q90": 0.9, "ln_ac_y_q99": 0.99})
    named = ends.withColumnsRenamed({k: f"_k_{k}" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & sums[k].eqNullSafe(named[f"_k_{k}"])
    n, cells = F.col("blocks"), F.col("blocks") * (side * side - 1)
    return sums.join(named, on).select(
        *by, "blocks", F.ln(F.col("_y") / n + EPSILON).alias("ln_ac_y_mean"), "ln_ac_y_q50", "ln_ac_y_q90", "ln_ac_y_q99", (F.col("_high") / (F.col("_low") + EPSILON)).alias("high_low_ratio"),
        (F.abs(F.col("_row") - F.col("_col")) / (F.col("_row") + F.col("_col") + EPSILON)).alias("directional_asymmetry"), (F.col("_xb") / (F.col("_y") + EPSILON)).alias("chroma_ac_ratio"),
        (F.col("_near3") / cells).alias("near_zero_frac_1e3"), (F.col("_near2") / cells).alias("near_zero_frac_1e2"), F.greatest(F.col("_dc2") / n - F.pow(F.col("_dc") / n, F.lit(2)), F.lit(0.0)).alias("dc_variance_y"),
    )
