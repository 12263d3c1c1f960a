"""Seeded draws as column expressions: 64-bit arithmetic that wraps, generators that jump ahead, and alias tables.

Columns are bigints that stand for 64 bits; nothing overflows under ANSI rules. A draw depends on seeds and its number
alone, so partitions do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW32, LOW16 = 0xFFFFFFFF, 0xFFFF
# Increment and multipliers of the seeding generator, shifts of the lanes' generator.
INCREMENT, MULTIPLIERS, SPLIT_SHIFTS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)
LANE_SHIFTS = (23, 18, 5)
#: Lanes of a generator, and steps from one stored state to the next.
LANES, CHUNK = 8, 64


def signed(v: int) -> int:
    """A number of 64 bits as a bigint."""
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def _left(a: Column, n: int) -> Column:
    return F.call_function("shiftleft", a, F.lit(n))


def _right(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(a, n)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def wrapping_add(a: Column, b: Column) -> Column:
    """Sum modulo 2 ** 64."""
    halves = F.struct((a.bitwiseAND(F.lit(LOW32)) + b.bitwiseAND(F.lit(LOW32))).alias("low"), (_right(a, 32) + _right(b, 32)).alias("high"))
    return _let(halves, lambda s: _left(s["high"] + _right(s["low"], 32), 32).bitwiseOR(s["low"].bitwiseAND(F.lit(LOW32))))


def wrapping_mul(a: Column, factor: int) -> Column:
    """Product with a constant modulo 2 ** 64, by parts of which no product leaves 48 bits."""
    fl, fh = factor & LOW32, (factor >> 32) & LOW32
    # Low half of a product of two halves, and the whole of one.
    low = lambda h, f: (h.bitwiseAND(F.lit(LOW16)) * F.lit(f)) + _left((_right(h, 16) * F.lit(f)).bitwiseAND(F.lit(LOW16)), 16)
    whole = lambda h: wrapping_add(h.bitwiseAND(F.lit(LOW16)) * F.lit(fl), _left(_right(h, 16) * F.lit(fl), 16))
    halves = F.struct(a.bitwiseAND(F.lit(LOW32)).alias("low"), _right(a, 32).alias("high"))
    return _let(halves, lambda s: wrapping_add(whole(s["low"]), _left(low(s["high"], fl) + low(s["low"], fh), 32)))


def split_mix(z: Column) -> Column:
    """The seeding generator's mix of 64 bits."""
    mixed = lambda v, k: _let(v, lambda w: wrapping_mul(w.bitwiseXOR(_right(w, SPLIT_SHIFTS[k])), MULTIPLIERS[k]))
    return _let(mixed(mixed(z, 0), 1), lambda w: w.bitwiseXOR(_right(w, SPLIT_SHIFTS[2])))


def lane_seeds(seed: Column, lanes: int = LANES) -> Column:
    """Array of lane seeds: the mix of the seed and the increment, then each the mix of the one before."""
    first = split_mix(wrapping_add(seed, F.lit(signed(INCREMENT))))
    return F.aggregate(F.sequence(F.lit(2), F.lit(lanes)), F.array(first), lambda a, _: F.concat(a, F.array(split_mix(F.element_at(a, -1)))))


def _step(a: Column, b: Column) -> tuple[Column, Column]:
    first = a.bitwiseXOR(_left(a, LANE_SHIFTS[0]))
    return b, _let(first, lambda x: x.bitwiseXOR(_right(x, LANE_SHIFTS[1]))).bitwiseXOR(b).bitwiseXOR(_right(b, LANE_SHIFTS[2]))


@lru_cache
def jump_table(steps: int) -> list[tuple[int, int]]:
    """What each of a lane's 128 bits alone becomes after so many steps: a step is linear over bits, so states add by exclusive or."""
    mask = (1 << 64) - 1
    if steps == 1:
        out = []
        for k in range(128):
            a, b = (1 << k, 0) if k < 64 else (0, 1 << (k - 64))
            x = a ^ (a << LANE_SHIFTS[0]) & mask
            out.append((b, x ^ b ^ x >> LANE_SHIFTS[1] ^ b >> LANE_SHIFTS[2]))
        return out
    half = jump_table(steps // 2)
    out = [_applied(half, s) for s in half]
    return [_applied(jump_table(1), s) for s in out] if steps % 2 else out


def _applied(table: list[tuple[int, int]], state: tuple[int, int]) -> tuple[int, int]:
    a = b = 0
    for k in range(128):
        if state[k // 64] >> (k % 64) & 1:
            a, b = a ^ table[k][0], b ^ table[k][1]
    return a, b


def _jumped(state: Column, steps: int) -> Column:
    """The state (a, b) after so many steps."""
    table = F.lit([x for t in jump_table(steps) for x in (signed(t[0]), signed(t[1]))])

    def add(s: Column, k: Column) -> Column:
        word = F.when(k < 64, state["a"]).otherwise(state["b"])
        on = F.call_function("getbit", word, (k % 64).cast("int")) == 1
        return F.when(on, F.struct(s["a"].bitwiseXOR(F.get(table, 2 * k)).alias("a"), s["b"].bitwiseXOR(F.get(table, 2 * k + 1)).alias("b"))).otherwise(s)

    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0), F.lit(127)), F.struct(zero.alias("a"), zero.alias("b")), add)


def lane_draws(df: DataFrame, seed0: str, seed1: str, batches: str) -> DataFrame:
    """df's columns with lane, batch (from 0) and draw: the eight lanes of a generator for each row, batches of each.

    Lanes are cut into parts of CHUNK steps, each of which starts from its own state, found by jumps of doubling lengths; so a
    long stream is many rows' work and not one's. Rows without batches, or with null seeds, give none.
    """
    parts = F.sequence(F.lit(0), F.floor((F.col(batches) - 1) / CHUNK))
    rows = df.where(F.col(seed0).isNotNull() & F.col(seed1).isNotNull() & (F.col(batches) > 0)).withColumns({"_s0": lane_seeds(F.col(seed0)), "_s1": lane_seeds(F.col(seed1))})
    rows = rows.select(*df.columns, F.posexplode(F.arrays_zip("_s0", "_s1")).alias("lane", "_s")).withColumn("_part", F.explode(parts))
    rows = rows.withColumn("_s", F.struct(F.col("_s._s0").alias("a"), F.col("_s._s1").alias("b")))
    most = rows.agg(F.max("_part")).first()[0] or 0
    for k in range(int(most).bit_length()):
        rows = rows.withColumn("_s", F.when(F.call_function("getbit", F.col("_part"), F.lit(k)) == 1, _jumped(F.col("_s"), CHUNK << k)).otherwise(F.col("_s")))
    here = F.least(F.lit(CHUNK).cast("bigint"), F.col(batches) - F.col("_part") * CHUNK)

    def advance(s: Column, _: Column) -> Column:
        a, b = _step(s["a"], s["b"])
        return F.struct(a.alias("a"), b.alias("b"), F.concat(s["out"], F.array(wrapping_add(s["a"], s["b"]))).alias("out"))

    start = F.struct(F.col("_s.a").alias("a"), F.col("_s.b").alias("b"), F.array().cast("array<bigint>").alias("out"))
    made = rows.withColumn("_out", F.aggregate(F.sequence(F.lit(1).cast("bigint"), here), start, advance, lambda s: s["out"]))
    return made.select(*df.columns, "lane", "_part", F.posexplode("_out").alias("_k", "draw")).select(*df.columns, "lane", (F.col("_part") * CHUNK + F.col("_k")).alias("batch"), "draw")


def noise_field(groups: DataFrame, seed: int, channels: int = 3) -> DataFrame:
    """groups' columns (x0, y0, width, height) with channel, x, y, v: pseudo-random samples from 1 to below 2.

    Each group is seeded by its corner; lines are drawn in segments of 16 samples, the low and the high half of each lane, channel
    after channel from one stream.
    """
    across = F.ceil(F.col("width") / 16).cast("bigint")
    rows = groups.withColumns({"_seed0": F.lit(signed(seed)), "_seed1": _left(F.col("x0").cast("bigint"), 32) + F.col("y0"), "_n": across * F.col("height") * channels})
    drawn = lane_draws(rows, "_seed0", "_seed1", "_n").withColumn("_half", F.explode(F.array(F.lit(0), F.lit(1))))
    bits = _right(F.col("draw"), 9).bitwiseAND(F.lit((1 << 23) - 1))
    high = _right(F.col("draw"), 41)
    line = F.floor(F.col("batch") / across)
    col = (F.col("batch") % across) * 16 + F.col("lane") * 2 + F.col("_half")
    out = drawn.select(*groups.columns, F.floor(line / F.col("height")).cast("int").alias("channel"), (F.col("x0") + col).alias("x"), (F.col("y0") + line % F.col("height")).alias("y"), (1.0 + F.when(F.col("_half") == 0, bits).otherwise(high) / float(1 << 23)).alias("v"), col.alias("_col"))
    return out.where(F.col("_col") < F.col("width")).drop("_col")


# ---- alias tables


def alias_table(masses: Column, total_bits: int = 12) -> Column:
    """Array of (symbol, offset, cutoff) of a power of two of masses that sum to 2 ** total_bits.

    The slots are dealt to equal buckets; a bucket keeps its own symbol below its cutoff and another's above. Symbols with more than a
    bucket and those with less are two stacks: the last of each meet, and what the first has over fills the second. One
    symbol alone has all buckets. A sum that differs raises an error.
    """
    n = F.size(masses)
    bucket = (F.lit(1 << total_bits) / n).cast("bigint")
    own = F.transform(masses, lambda p: p.cast("bigint"))
    index = F.transform(own, lambda _, k: k)
    alone = F.array_position(own, F.lit(1 << total_bits).cast("bigint"))
    put = lambda a, k, v: F.transform(a, lambda x, i: F.when(i == k, v).otherwise(x))
    pop = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    push = lambda a, k, when: F.concat(a, F.when(when, F.array(k)).otherwise(F.array().cast("array<int>")))
    start = F.struct(own.alias("cut"), index.alias("symbol"), F.transform(own, lambda p: F.lit(0).cast("bigint")).alias("offset"), F.filter(index, lambda k: F.get(own, k) > bucket).alias("over"), F.filter(index, lambda k: F.get(own, k) < bucket).alias("under"))

    def meet(s: Column, _: Column) -> Column:
        o, u = F.element_at(s["over"], -1), F.element_at(s["under"], -1)
        left = F.get(s["cut"], o) - (bucket - F.get(s["cut"], u))
        new = F.struct(put(s["cut"], o, left).alias("cut"), put(s["symbol"], u, o).alias("symbol"), put(s["offset"], u, left).alias("offset"), push(pop(s["over"]), o, left > bucket).alias("over"), push(pop(s["under"]), o, left < bucket).alias("under"))
        return F.when((F.size(s["over"]) > 0) & (F.size(s["under"]) > 0), new).otherwise(s)

    done = F.aggregate(F.sequence(F.lit(1), n), start, meet)
    entry = lambda k: F.when(F.get(done["cut"], k) == bucket, F.struct(k.alias("symbol"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("cutoff"))).otherwise(
        F.struct(F.get(done["symbol"], k).alias("symbol"), (F.get(done["offset"], k) - F.get(done["cut"], k)).alias("offset"), F.get(done["cut"], k).alias("cutoff")))
    single = F.transform(index, lambda k: F.struct((alone.cast("int") - 1).alias("symbol"), (bucket * k).alias("offset"), F.lit(0).cast("bigint").alias("cutoff")))
    whole = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, p: a + p)
    return F.when(whole != 1 << total_bits, F.raise_error(F.lit("masses do not sum to the whole"))).when(alone > 0, single).otherwise(F.transform(index, entry))


def alias_symbol(table: Column, slot: Column, total_bits: int = 12) -> Column:
    """(symbol, offset) of a slot: each symbol has as many slots as its mass, with the offsets from 0 on."""
    bucket = (F.lit(1 << total_bits) / F.size(table)).cast("bigint")
    k, at = F.floor(slot / bucket).cast("int"), slot % bucket
    e = F.get(table, k)
    return F.when(at >= e["cutoff"], F.struct(e["symbol"].alias("symbol"), (e["offset"] + at).alias("offset"))).otherwise(F.struct(k.alias("symbol"), at.alias("offset")))
