"""Corpus pipeline: each stage works on all rows that its predecessor kept, as a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, ngram_join, sharding, toxicity
from tessera.llm.registry import SHARDS
from tessera.llm.shared import broadcast_if_few, skew_join, small_batches, stored

#: Score from which a document is rejected as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject, as they are: all columns, whatever their names.

    Null, empty and wordless texts score 0 and stay; repeated rows score alike and stay or go together; an empty table
    stays empty. Without labels of both classes the network is a constant.
    """
    net = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, net, TOXIC)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, a similarity of 0.8).

    A document is an id with a text: rows that repeat both are one, of which the smallest in its other columns stays, and
    unlike texts of one id are documents of their own. Rows without an id stay; null and empty texts have no near-duplicates;
    an empty table stays empty. Rows travel as one value, so their columns may have any names.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    named = docs.select(held, key.alias("_key"))
    keys = docs.select("doc_id", key.alias("_key"), "text").where("_key is not null")
    ids = keys.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    # Most components have one document; only the others, and rows that repeat an id and its text, are joined to the rows.
    with small_batches(spark):
        found = ngram_join.ngram_components(keys, id_col="_key").select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_of"))
        groups = stored(found.distinct().join(ids, "_key"), "groups")
    least = stored(groups.groupBy("_of").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_first"), F.count("*").alias("n")).where("n > 1"), "least")
    others = stored(skew_join(groups.select("_key", "_of"), least, "_of").where("_key <> _first").select("_key"), "copies")
    again = broadcast_if_few(stored(groups.where("n > 1").select("_key"), "repeats"))
    kept = named.join(broadcast_if_few(others), "_key", "left_anti")
    one = kept.join(again, "_key", "left_semi").groupBy("_key").agg(F.min("_row").alias("_row"))
    return kept.join(again, "_key", "left_anti").select("_row").unionAll(one.select("_row")).select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item (all words of a shorter one), with all their columns.

    A hit depends on the text alone, so texts are named by a digest of 128 bits, which also names rows without an id;
    null and empty texts have no hit; repeated rows stay or go together; without items all rows stay.
    """
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    with small_batches(spark):
        found = decontamination.decontaminate(docs.select(key.alias("_key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key")
        hit = stored(found.where("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return named.join(broadcast_if_few(hit), "_key", "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; a source beyond its weight loses documents.

    The columns of docs alone, unchanged and whatever their names; null sources are one source; texts without words are
    taken by the same rule as others; an empty table stays empty.
    """
    return mixing.taken(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs with the slot and shard of each row, which take the place of columns of these names.

    Rows of one id, and those without, go to one shard; an empty table stays empty.
    """
    return sharding.place(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: SQL cannot express the trained stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
