"""Shard placement through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the production table; prime, and over 100 times the shards it is meant for.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _draw(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot.

    Each shard prefers the slots in the order offset, offset + skip, offset + 2 skip, ... modulo the prime number of
    slots, with offset and skip drawn from its name. Shards take turns; each claims the first free slot of its order. So
    the shares differ by at most one slot, and losing a shard moves few slots that were not its own.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be prime and no fewer than the shards")
    at = [_draw(s, "offset") % slots for s in shards]
    skip = [_draw(s, "skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: F.Column, slots: int = SLOTS) -> F.Column:
    """Slot of a key: the first 15 hex digits of the MD5 of its text, modulo slots; a null key is the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id", slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """docs with the slot of each row and its shard, whatever the table's size: no shuffle.

    The lookup table has a row for each slot, a number that is a parameter and does not grow with the data, and is
    broadcast. Equal keys get equal shards; null keys go together; an empty table stays empty. Columns named slot_col or
    shard_col (in any case, as Spark compares names) are replaced; all others stay as they are.
    """
    owner = lookup_table(shards, slots)
    # An Arrow table is read by the JVM; rows of Python would start workers of another kind, which stay for a minute.
    table = docs.sparkSession.createDataFrame(pa.table({"_slot": pa.array(range(slots), pa.int32()), "_shard": pa.array(shards, pa.string()).take(pa.array(owner))}))
    # The rows travel as one value, so that no column of theirs can clash with the table's.
    made = {slot_col.lower(), shard_col.lower()}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in made]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), slot_of(F.col(key), slots).alias("_at"))
    return keyed.join(F.broadcast(table), F.col("_at") == F.col("_slot"), "left").select(*kept, F.col("_at").alias(slot_col), F.col("_shard").alias(shard_col))


def write_shards(placed: DataFrame, path: str, shards: int, shard_col: str = "shard", files: int = 1) -> None:
    """Each shard as a folder of at most files Parquet files; files over 1 spreads a shard over tasks by a row hash."""
    placed.repartition(shards * files, shard_col, F.pmod(F.xxhash64(*placed.columns), F.lit(files))).write.partitionBy(shard_col).parquet(path)
