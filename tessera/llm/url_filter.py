"""URL rules through a blocked Bloom filter and an exact hash join, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import skew_join, stored

#: Longest filter that is sent to every task, in 64-bit blocks (8 MB); more rules get more bits only up to this.
MOST_BLOCKS = 1 << 20
#: Rule path lengths, and numbers of labels of rule hosts, that are listed in the plan; with more of them every prefix of a
#: path, or every parent of a host, is tried.
MOST_DEPTHS = 4096

SEP = "\x1f"


def host_of(url: F.Column) -> F.Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or url."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.substr(url, F.locate("://", url) + 3), "#", 1))
    host = F.substring_index(F.substring_index(rest, "/", 1), "?", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """What follows the host up to '?', '#' or the end."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _hash(key: F.Column) -> F.Column:
    return F.xxhash64(key)


def _block(h: F.Column, blocks: int) -> F.Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _bits(h: F.Column) -> list[F.Column]:
    """Four bits of a 64-bit block, from 6-bit fields of the hash's upper half."""
    return [F.shiftrightunsigned(h, 34 + 7 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]


def _mask(h: F.Column) -> F.Column:
    one = F.lit(1).cast("long")
    made = [F.call_function("shiftleft", one, bit) for bit in _bits(h)]
    return made[0].bitwiseOR(made[1]).bitwiseOR(made[2]).bitwiseOR(made[3])


def _passes(h: F.Column, table: F.Column, n: int) -> F.Column:
    """Whether all bits of the key are set in its block: a key of the list always passes."""
    word = F.element_at(table, _block(h, n) + 1)
    return F.forall(F.array(*_bits(h)), lambda bit: F.call_function("getbit", word, bit) == 1)


def bloom_blocks(rules: DataFrame, keys_per_block: float = 4.0) -> list[int]:
    """A 64-bit block for about each keys_per_block distinct rule keys (about 2 to 3 % false hits), MOST_BLOCKS at most.

    Blocks are OR-combined where the rules are; what comes to the driver is bounded by MOST_BLOCKS whatever the rules.
    """
    keyed = rules.where(F.col("key").isNotNull()).select(_hash(F.col("key")).alias("h"))
    n = max(1, min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, keyed.count()) / keys_per_block)))))
    made = keyed.select(_block(F.col("h"), n).alias("b"), _mask(F.col("h")).alias("m")).groupBy("b").agg(F.bit_or("m").alias("m")).collect()
    blocks = [0] * n
    for row in made:
        blocks[row.b] = row.m
    return blocks


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table with the exact key of each."""
    rows = spark.createDataFrame(rules, "verdict string, host string, path string")
    return rows.withColumn("key", F.concat("host", F.lit(SEP), "path"))


def candidate_keys(host: F.Column, path: F.Column, depths: list[int] | None, widths: list[int] | None = None) -> F.Column:
    """Keys of all rules that could fit: host and its parents, each with the path's prefixes of the rules' lengths (None: of all lengths).

    widths are the numbers of labels that rules' hosts have (None: any): only parents of so many labels are spelled out.
    """
    labels = F.size(F.split(host, r"\."))
    sizes = F.sequence(F.lit(1), labels) if widths is None else F.filter(F.lit(widths), lambda n: n <= labels)
    hosts = F.transform(sizes, lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    long_enough = F.sequence(F.lit(0), F.length(path)) if depths is None else F.filter(F.lit(depths), lambda n: n <= F.length(path))
    prefixes = F.transform(long_enough, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit(SEP), p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row of pages: id, host, path, rule (its host and path, else null) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest (host and path together,
    then host) wins, and of equal ones block. Urls without a rule get default, a null or relative url too; no rules and
    no pages are fine. Rules with a null host or path fit nothing. A row's possible keys are tried on the Bloom filter;
    only hits go on to the exact join, which removes the false ones, and the hits' winners come back to the rows by a key
    of their own, so repeated rows and null ids are kept as they are. Other columns are not read.
    """
    rules = rules.where("key is not null").dropDuplicates(["key", "verdict"])
    depths = sorted({r.n for r in rules.select(F.length("path").alias("n")).distinct().limit(MOST_DEPTHS + 1).collect()}) or [0]
    widths = sorted({r.n for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().limit(MOST_DEPTHS + 1).collect()}) or [1]
    blocks = bloom_blocks(rules)
    held = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), depths if len(depths) <= MOST_DEPTHS else None, widths if len(widths) <= MOST_DEPTHS else None)
    # One literal that is folded to an array, whatever its length.
    table = F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<bigint>")
    hit = F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), _hash(k).alias("h"))), lambda x: _passes(x.h, table, len(blocks)))
    tried = held.withColumn("hits", F.transform(hit, lambda x: x.key))
    # Pairs (host, path) repeat: the exact join sees each distinct list of hits once.
    lists = tried.where(F.size("hits") > 0).groupBy("hits").agg(F.count("*").alias("n"))
    ranked = rules.select("key", F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    won = lists.withColumn("key", F.explode("hits")).join(ranked, "key").groupBy("hits").agg(F.max("r").alias("r"), F.first("n").alias("n"))
    # A list that very many pages share is broadcast and so no hot group.
    out = skew_join(tried, stored(won, "winners"), "hits")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
