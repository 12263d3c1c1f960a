"""Symbol counts and what coding them would cost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def byte_rows(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """A row for each UTF-8 byte: keys, pos, value."""
    # One pass over the hexadecimal digits; a substring at each position would walk the text each time.
    pairs = F.regexp_extract_all(F.hex(F.col(text).cast("binary")), F.lit("(..)"), F.lit(1))
    rows = df.where(F.length(text) > 0).select(*keys, F.posexplode(pairs).alias("pos", "_pair"))
    return rows.select(*keys, "pos", F.conv("_pair", 16, 10).cast("int").alias("value"))


def byte_census(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Count of each UTF-8 byte value in each context: at most 256 rows for each context and batch leave a task.

    Null and empty texts count nothing; null keys are a context.
    """

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            table = pa.Table.from_batches([batch])
            groups = table.select(list(keys)).append_column("_row", pa.array(np.arange(len(table)))).group_by(list(keys)).aggregate([("_row", "list")]).to_pylist() if keys else [{"_row_list": list(range(len(table)))}]
            column = batch.column(len(keys))
            for group in groups:
                own = column.take(pa.array(group["_row_list"], pa.int64())).drop_null()
                _, offsets, data = own.buffers()
                at = np.frombuffer(offsets, np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else [0]
                raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
                n = np.bincount(raw, minlength=256)
                value = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([*[pa.array([group[k]] * len(value), batch.schema.field(k).type) for k in keys], pa.array(value, pa.int32()), pa.array(n[value], pa.int64())], names=[*keys, "value", "n"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.select(*keys).dtypes], "value int, n bigint"])
    part = df.select(*keys, F.col(text).cast("binary").alias("_text")).mapInArrow(count, schema)
    return part.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def census(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count of each value in each context; partial counts are merged by addition."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def merge_census(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, value).agg(F.sum("n").alias("n"))


def shannon_cost(counts: DataFrame, keys: Sequence[str], extra: Column | None = None) -> DataFrame:
    """symbols and bits of each context: the entropy of its counts and its symbols' raw extra bits."""
    raw = F.lit(0.0) if extra is None else F.sum(F.col("n") * extra).cast("double")
    total = F.sum("n").cast("double")
    bits = total * F.log2(total) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) + raw
    return counts.groupBy(*keys).agg(F.sum("n").alias("symbols"), bits.alias("bits"))


def direction_entropy(counts: Column) -> Column:
    """Entropy of four counts on a scale of 0 to 256, rounded; 0 without counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    share = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0)
    return F.when(total > 0, F.round(F.aggregate(counts, F.lit(0.0), lambda s, c: s + share(c)) * 128)).otherwise(0.0).cast("int")


def huffman_lengths(counts: DataFrame, keys: Sequence[str], value: str, limit: int = 15) -> DataFrame:
    """Code lengths of at most limit bits with the smallest total, by package merge; one symbol gets length 1.

    A context's alphabet is one bounded group.
    """

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["n", value], ignore_index=True)
        # A package is the list of its symbols, so a level holds about two numbers for each symbol.
        coins = [(int(n), np.array([k])) for k, n in enumerate(own["n"])]
        bits = np.zeros(len(own), np.int64)
        if len(own) == 1:
            bits += 1
        elif len(own) > 1 << limit:
            raise ValueError("more symbols than codes of that length")
        else:
            row = coins
            for _ in range(limit - 1):
                made = [(a[0] + b[0], np.concatenate([a[1], b[1]])) for a, b in zip(row[::2], row[1::2], strict=False)]
                row = sorted([*coins, *made], key=lambda c: c[0])
            bits += np.bincount(np.concatenate([members for _, members in row[: 2 * len(own) - 2]]), minlength=len(own))
        return own[[*keys, value, "n"]].assign(length=bits)

    schema = ", ".join(f"`{c}` {t}" for c, t in counts.select(*keys, value, "n").dtypes) + ", length int"
    return counts.groupBy(*keys).applyInPandas(lengths, schema)


def canonical_codes(lengths: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Codes of canonical prefix codes: shorter first, then smaller symbols; each starts where those before it end."""
    w = Window.partitionBy(*keys).orderBy("length", value)
    before = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("length").cast("double"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return lengths.withColumn("code", (before * F.pow(F.lit(2.0), F.col("length").cast("double"))).cast("bigint"))


def normalised(counts: DataFrame, keys: Sequence[str], value: str, bits: int = 12) -> DataFrame:
    """Positive counts scaled to a sum of 2 ** bits with none below 1: keys, value, n, p.

    Shares are rounded down; what is missing goes to the largest remainders, the smaller value first, and what the floor
    of 1 adds is taken from the heaviest, the first of equals, one by one. A context with more values than 2 ** bits fails
    the query. A context's alphabet is so bounded, and one array.
    """
    total, most = F.sum("n").cast("bigint"), F.lit(1 << bits).cast("bigint")
    own = counts.where("n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("n").cast("bigint").alias("n")))).alias("s"), total.alias("t"))
    own = own.withColumn("s", F.when(F.size("s") > most, F.raise_error(F.lit("more values than units of probability"))).otherwise(F.col("s")))
    share = lambda e: F.greatest(F.call_function("div", e.n * most, F.col("t")), F.lit(1).cast("bigint"))
    own = own.withColumn("p", F.transform("s", share)).withColumn("short", most - F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x))
    places = F.transform(F.array_sort(F.transform("s", lambda e, k: F.struct((-((e.n * most) % F.col("t"))).alias("r"), k.alias("k")))), lambda x: x.k)
    first = F.slice(places, 1, F.greatest(F.col("short"), F.lit(1)).cast("int"))
    raised = F.transform("p", lambda x, k: x + F.when((F.col("short") > 0) & F.array_contains(first, k), 1).otherwise(0).cast("bigint"))
    # Taking from the heaviest leaves no share above a level, and the first of those at it one below.
    cut = lambda level: F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.least(x, level))
    half = lambda r: F.call_function("div", r.lo + r.hi, F.lit(2))
    step = lambda r, _: F.when(cut(half(r)) >= most, F.struct(r.lo.alias("lo"), half(r).alias("hi"))).otherwise(F.struct((half(r) + 1).alias("lo"), r.hi.alias("hi")))
    level = F.aggregate(F.sequence(F.lit(0), F.lit(bits)), F.struct(F.lit(1).cast("bigint").alias("lo"), most.alias("hi")), lambda r, k: F.when(r.lo < r.hi, step(r, k)).otherwise(r), lambda r: r.hi)
    own = own.withColumn("level", F.when(F.col("short") < 0, level)).withColumn("over", F.when(F.col("short") < 0, cut(F.col("level")) - most))
    at_level = F.filter(F.transform("p", lambda x, k: F.when(x >= F.col("level"), k)), lambda k: k.isNotNull())
    own = own.withColumn("first", F.when(F.col("short") < 0, F.slice(at_level, 1, F.greatest(F.col("over"), F.lit(1)).cast("int"))))
    lowered = F.transform("p", lambda x, k: F.least(x, F.col("level")) - F.when((F.col("over") > 0) & F.array_contains("first", k), 1).otherwise(0).cast("bigint"))
    done = F.when(F.col("short") < 0, lowered).otherwise(raised)
    rows = own.select(*keys, F.explode(F.arrays_zip(F.col("s"), done.alias("p"))).alias("e"))
    return rows.select(*keys, F.col("e.s.v").alias(value), F.col("e.s.n").alias("n"), F.col("e.p").alias("p"))


#: Contexts and values that a clustering may have.
MOST_CONTEXTS, MOST_CELLS = 4096, 1 << 24


def cluster(counts: DataFrame, context: str, value: str, most: int = 8, header: float | None = None) -> DataFrame:
    """Contexts joined greedily while their joint cost falls, or there are more than most clusters: context, cluster.

    The census is an aggregate: contexts times alphabet, whatever the corpus; it is checked to have at most MOST_CONTEXTS
    contexts and MOST_CELLS cells before it comes to the driver. A pair costs what coding both with one table adds; header
    is what a table costs (its alphabet by default). Pairs are priced once, and a merge reprices only its own.
    """
    shape = counts.agg(F.countDistinct(context).alias("c"), F.countDistinct(value).alias("v")).first()
    if shape.c > MOST_CONTEXTS or shape.c * shape.v > MOST_CELLS:
        raise ValueError("the census is too large for clustering")
    kind = dict(counts.dtypes)[context]
    spark = counts.sparkSession
    pdf = counts.groupBy(context, value).agg(F.sum("n").alias("n")).toPandas()
    if not len(pdf):
        return spark.createDataFrame([], f"`{context}` {kind}, cluster int")
    table = pdf.pivot_table(index=context, columns=value, values="n", fill_value=0).sort_index()
    rows = table.to_numpy(float)
    price = lambda r: r.sum(-1) * np.log2(np.maximum(r.sum(-1), 1)) - (r * np.log2(np.maximum(r, 1))).sum(-1)
    own, live, of = price(rows), np.ones(len(rows), bool), np.arange(len(rows))
    head = float(table.shape[1]) if header is None else header
    gain = np.full((len(rows), len(rows)), -np.inf)
    for i in range(len(rows)):
        gain[i, i + 1 :] = own[i] + own[i + 1 :] + head - price(rows[i] + rows[i + 1 :])
    while live.sum() > 1:
        # Of equal gains the pair with the smallest first, then the smallest second context.
        i, j = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
        if gain[i, j] <= 0 and live.sum() <= most:
            break
        rows[i] += rows[j]
        of[of == j] = i
        live[j] = False
        gain[j, :] = gain[:, j] = -np.inf
        own[i] = price(rows[i])
        others = np.flatnonzero(live & (np.arange(len(rows)) != i))
        for k in others.tolist():
            gain[min(i, k), max(i, k)] = own[i] + own[k] + head - price(rows[i] + rows[k])
    number = {k: n for n, k in enumerate(np.flatnonzero(live).tolist())}
    return spark.createDataFrame([(c, number[k]) for c, k in zip(table.index.tolist(), of.tolist(), strict=True)], f"`{context}` {kind}, cluster int")


def token_totals(df: DataFrame, by: Sequence[str], counts: str) -> DataFrame:
    """Elementwise sum of count vectors, the shorter ones ending in zeros: by, counts."""
    rows = df.select(*by, F.posexplode(counts).alias("_k", "_n")).groupBy(*by, "_k").agg(F.sum("_n").alias("_n"))
    cells = F.map_from_entries(F.collect_list(F.struct("_k", "_n")))
    filled = rows.groupBy(*by).agg(cells.alias("_m"), F.max("_k").alias("_last"))
    return filled.select(*by, F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: F.coalesce(F.try_element_at(F.col("_m"), k), F.lit(0))).alias(counts))


def coefficient_order(df: DataFrame, by: Sequence[str], position: str, coefficient: str, fixed: int, least: int = 0) -> DataFrame:
    """by, rank, position: the first fixed positions as they are, the others by how often their coefficient is not 0, most
    often first, ties by position. Groups with fewer than least samples beyond the fixed ones are left out."""
    seen = df.groupBy(*by, position).agg(F.count_if(F.col(coefficient) != 0).alias("_n"), F.count("*").alias("_all"))
    w = Window.partitionBy(*by)
    enough = F.sum(F.when(F.col(position) >= fixed, F.col("_all")).otherwise(0)).over(w)
    key = F.when(F.col(position) < fixed, F.lit(None)).otherwise(-F.col("_n"))
    ranked = seen.withColumn("_enough", enough).withColumn("rank", F.row_number().over(w.orderBy(key.asc_nulls_first(), position)) - 1)
    return ranked.where(F.col("_enough") >= least).select(*by, "rank", position)


def presets(df: DataFrame, by: Sequence[str], group: str, mass: str) -> DataFrame:
    """by, group, preset: 0 for groups up to the middle of the smallest and largest mass, else 1; null without spread."""
    per = df.groupBy(*by, group).agg(F.sum(mass).alias("_m"))
    ends = per.groupBy(*by).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    middle = F.col("_lo") + F.call_function("div", F.col("_hi") - F.col("_lo"), F.lit(2))
    out = per.join(ends, list(by)) if by else per.crossJoin(F.broadcast(ends))
    return out.select(*by, group, F.when(F.col("_lo") == F.col("_hi"), F.lit(None)).when(F.col("_m") <= middle, 0).otherwise(1).alias("preset"))


def thresholds(df: DataFrame, by: Sequence[str], value: str, most: int = 15) -> DataFrame:
    """by, thresholds: the distinct values without the largest, ascending, at most most of them."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("_s")).select(*by, F.slice("_s", 1, F.least(F.size("_s") - 1, F.lit(most))).alias("thresholds"))
