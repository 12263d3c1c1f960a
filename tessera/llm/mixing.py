"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import skew_join, stored

#: Weights dealt to the sources in order of their names, again and again.
WEIGHTS = (3, 1, 2)

#: Words: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(*keys: F.Column, seed: int = 0) -> F.Column:
    """A number in [0, 1) that depends on the seed and the keys' text alone: the first 13 hex digits of an MD5."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, name: str = "source", size: str = "size") -> DataFrame:
    """sizes (a row for each source) with target.

    Sources weigh weights[0], weights[1], ... in code-point order of their names, null last. Together they get total
    times all sizes; a source stops at most times its own, and what is over goes to the others by weight until none is
    above. This is the level at which sum(least(weight x level, most x size)) meets the total, found by one running sum
    over the sources ordered by the level at which they fill. Sources without size get target 0. If total reaches most,
    every source gets most times its size.
    """
    # The running sums see a row for each source; a hot source is one row, of three numbers and a name.
    everyone = Window.partitionBy(F.lit(0))
    by_name = everyone.orderBy(F.col(name).isNull(), F.col(name))
    w = F.element_at(F.lit([float(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col(size) * F.lit(float(most)))
    by_level = everyone.orderBy(F.col("_cap") / F.col("_w"), F.col(name).isNull(), F.col(name))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_all", F.sum(size).over(everyone) * F.lit(float(total)))
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_open", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open"))
    # The first source that the level does not fill sets the level for those after it; those before are full.
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everyone)["_level"])
    return s.withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))).drop("_w", "_cap", "_all", "_full", "_open", "_level")


def _counted(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_row (all columns of docs as one value, which no name can clash with), _source, _size and _draw of each row."""
    mark = draw(F.col(id_col), F.col(source_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), seed=seed)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), mark.alias("_draw"))


def _dealt(docs: DataFrame, weights: tuple[float, ...], total: float, most: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_counted() with _of (the source's size), _target, _rate and _copies."""
    rows = _counted(docs, seed, id_col, text_col, source_col)
    totals = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    # A null source has a row of its own; the join takes it by a flag and an empty name.
    name = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))
    plan = stored(targets(totals, weights, total, most).select(name("source").alias("_key"), F.col("size").alias("_of"), F.col("target").alias("_target"), "n"), "targets")
    out = skew_join(rows.withColumn("_key", name("_source")), plan, "_key").drop("_key")
    out = out.withColumn("_rate", F.when(F.col("_of") > 0, F.col("_target") / F.col("_of")).otherwise(F.lit(0.0)))
    extra = F.col("_draw") < F.col("_rate") - F.floor("_rate")
    return out.withColumn("_copies", (F.floor("_rate") + F.when(extra, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, rate and copies.

    rate is the target over the source's size; a row is taken floor(rate) times, and once more with probability equal to
    the fraction, drawn from the seed, its id, source and text: reruns agree, and repeated rows share their draw. Rows of
    a null source are one source; null texts have size 0; rows of size 0 change nothing and are taken by the same rule;
    an empty table stays empty. Columns of docs that have one of the five names (in any case) are replaced, all others
    stay as they are. The totals are pre-aggregated before their shuffle and stored; a hot source is one row of them, and
    the join that brings them back moves no hot source's rows. Texts are not read after that join.
    """
    made = {"size": "_size", "source_size": "_of", "target": "_target", "rate": "_rate", "copies": "_copies"}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in made]
    return _dealt(docs, weights, total, most, seed, id_col, text_col, source_col).select(*kept, *[F.col(c).alias(name) for name, c in made.items()])


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as it is taken; copy counts from 1, in place of any column of that name."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def taken(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with the columns of docs alone, whatever their names."""
    out = _dealt(docs, weights, total, most, seed, id_col, text_col, source_col).where("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
