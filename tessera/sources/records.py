"""Versioned JSON records, one a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def line(df: DataFrame) -> Column:
    """A row as compact JSON with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def no_nan(df: DataFrame) -> DataFrame:
    """df, failing at the first NaN or infinity: records may not hold them."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.col(f.name)
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            out = out.withColumn(f.name, F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite"))).otherwise(c))
    return out


def write(df: DataFrame, path: str, append: bool = False) -> None:
    no_nan(df).select(line(df).alias("value")).write.mode("append" if append else "overwrite").text(path)


def parse(lines: DataFrame, schema: str, versions: Sequence[str], column: str = "line") -> DataFrame:
    """Typed records; a record of another version, or without one, fails the read."""
    rows = lines.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    known = F.col("schema").isin(*versions)
    return rows.withColumn("schema", F.when(F.coalesce(known, F.lit(False)), F.col("schema")).otherwise(F.raise_error(F.concat(F.lit("unknown schema: "), F.coalesce("schema", F.lit("none"))))))


def read(spark: SparkSession, path: str, schema: str, versions: Sequence[str]) -> DataFrame:
    return parse(spark.read.text(path).select(F.col("value").alias("line")), schema, versions)


def read_kinds(spark: SparkSession, path: str, schema: str, kind: str, value: str) -> DataFrame:
    """Records of one kind of a mixed file, without those whose value is NaN."""
    rows = spark.read.schema(schema).json(path, allowNonNumericNumbers=True)
    return rows.where((F.col("kind") == kind) & ~F.isnan(F.coalesce(F.col(value), F.lit(0.0))))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Images of a manifest (one JSON object); an id that repeats or is empty fails the read."""
    schema = "schema string, images array<struct<id: string, path: string, sha256: string, strata: array<string>, split: string, family_id: string>>"
    images = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("images").alias("i")).select("i.*")
    bad = images.groupBy("id").count().where("count > 1 or id is null or id = ''").limit(1).collect()
    if bad:
        raise ValueError(f"manifest id {bad[0]['id']!r} is empty or not unique")
    return images


def atlas(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of an atlas file; atoms out of raster order or missing fail the read."""
    schema = "kind string, width int, height int, grid_width int, grid_height int, x int, y int, mean_xyb array<double>, variance_xyb array<double>"
    rows = spark.read.schema(schema).json(path)
    head = rows.where("kind = 'header'").select("grid_width", "grid_height").first()
    atoms = rows.where("kind = 'atom'").drop("width", "height", "grid_width", "grid_height")
    seen = atoms.select((F.col("y") * head.grid_width + F.col("x")).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("u"), F.max("k").alias("m")).first()
    if seen.n != head.grid_width * head.grid_height or seen.u != seen.n or seen.m != seen.n - 1:
        raise ValueError("atlas does not hold each atom once")
    return atoms


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of a bounded frame."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])
