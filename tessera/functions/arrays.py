"""Permutations, lists, byte strings and vectors as array expressions, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lehmer(order: Column) -> Column:
    """For each number of a permutation of 0 .. n - 1, its place among the numbers not yet used."""
    return F.transform(order, lambda k, i: k - F.size(F.filter(F.slice(order, 1, i), lambda e: e < k)))


def from_lehmer(code: Column) -> Column:
    """The permutation of a Lehmer code: each number is the one at that place of those left."""
    n = F.size(code)
    start = F.struct(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")).alias("left"), F.array().cast("array<int>").alias("out"))
    take = lambda s, k: F.struct(F.filter(s.left, lambda v: v != F.element_at(s.left, (k + 1).cast("int"))).alias("left"), F.array_append(s.out, F.element_at(s.left, (k + 1).cast("int"))).alias("out"))
    return F.aggregate(code, start, take, lambda s: s.out)


def _table(size: int) -> Column:
    return F.sequence(F.lit(0), F.lit(size - 1))


def move_to_front(values: Column, size: int = 256) -> Column:
    """Place of each value in a list 0 .. size - 1, to whose front it then moves."""
    start = F.struct(_table(size).alias("t"), F.array().cast("array<int>").alias("out"))
    step = lambda s, v: F.struct(F.concat(F.array(v.cast("int")), F.filter(s.t, lambda e: e != v)).alias("t"), F.array_append(s.out, (F.array_position(s.t, v.cast("int")) - 1).cast("int")).alias("out"))
    return F.aggregate(values, start, step, lambda s: s.out)


def from_move_to_front(places: Column, size: int = 256) -> Column:
    """The inverse."""
    start = F.struct(_table(size).alias("t"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        v = F.element_at(s.t, (k + 1).cast("int"))
        return F.struct(F.concat(F.array(v), F.filter(s.t, lambda e: e != v)).alias("t"), F.array_append(s.out, v).alias("out"))

    return F.aggregate(places, start, step, lambda s: s.out)


def byte_shuffle(data: Column, width: int) -> Column:
    """Bytes laid out as width rows, the first ones longer by one if they do not divide, read column by column."""
    n = F.octet_length(data)
    base, rest = F.floor(n / width), n % width
    rows = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda r: F.substr(data, (base * r + F.least(r, rest) + 1).cast("int"), (base + F.when(r < rest, 1).otherwise(0)).cast("int")))
    columns = F.transform(F.sequence(F.lit(1).cast("bigint"), base + F.when(rest > 0, 1).otherwise(0)), lambda c: F.aggregate(rows, F.lit(bytearray()), lambda a, row: F.concat(a, F.substr(row, c.cast("int"), F.lit(1)))))
    whole = F.aggregate(columns, F.lit(bytearray()), lambda a, c: F.concat(a, c))
    return F.when((n <= 1) | F.lit(width <= 1), data).otherwise(whole)


def fnv1a64(values: Column) -> Column:
    """FNV-1a of an array of byte values as 16 hexadecimal digits; products are taken in decimals, which do not overflow."""
    offset, prime, whole = "14695981039346656037", "1099511628211", "18446744073709551616"
    number = lambda s: F.lit(s).cast("decimal(38,0)")

    def step(h: Column, b: Column) -> Column:
        low = (h % number("256")).cast("int")
        mixed = h - low.cast("decimal(38,0)") + low.bitwiseXOR(b.cast("int")).cast("decimal(38,0)")
        return ((mixed * number(prime)).cast("decimal(38,0)") % number(whole)).cast("decimal(38,0)")

    h = F.aggregate(values, number(offset), step)
    return F.lower(F.lpad(F.conv(h.cast("string"), 10, 16), 16, "0"))


def zigzag(side: int = 8) -> list[int]:
    """Raster places of a square in zig-zag order: by diagonals, whose direction alternates."""
    cells = [(y, x) for y in range(side) for x in range(side)]
    return [y * side + x for y, x in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))]


def from_zigzag(values: Column, side: int = 8) -> Column:
    """An array in zig-zag order brought to raster order."""
    order = zigzag(side)
    back = [order.index(k) + 1 for k in range(side * side)]
    return F.transform(F.lit(back), lambda k: F.element_at(values, k))


def transpose(values: Column, height: int, width: int) -> Column:
    """A height x width matrix in raster order, transposed."""
    return F.transform(F.lit([y * width + x + 1 for x in range(width) for y in range(height)]), lambda k: F.element_at(values, k))


def standardise(vector: Column, centers: Sequence[float], scales: Sequence[float]) -> Column:
    """(v - center) / scale of each entry."""
    at = F.lit([float(c) for c in centers])
    by = F.lit([float(s) for s in scales])
    return F.zip_with(F.zip_with(vector, at, lambda v, c: v.cast("double") - c), by, lambda v, s: v / s)


def affine(w: Column, x: Column) -> Column:
    """First entry of w and the dot product of the others with x."""
    return F.get(w, F.lit(0)) + F.aggregate(F.zip_with(F.slice(w, 2, F.greatest(F.size(x), F.lit(1))), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def interpolate_knots(values: Column, x: Column, knots: Sequence[float]) -> Column:
    """Linear interpolation of values at falling knots, those of the ends beyond them."""
    out = F.element_at(values, len(knots))
    for k in range(len(knots) - 2, -1, -1):
        a, b = float(knots[k]), float(knots[k + 1])
        va, vb = F.element_at(values, k + 1), F.element_at(values, k + 2)
        line = va if a - b <= 1e-12 else va + (a - x) / (a - b) * (vb - va)
        out = F.when((x <= a) & (x >= b), line).otherwise(out)
    return F.when(x >= float(knots[0]), F.element_at(values, 1)).when(x <= float(knots[-1]), F.element_at(values, len(knots))).otherwise(out)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def thumbnail(values: Column) -> Column:
    """An array with zero mean and unit norm; null if all its entries are equal."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = F.transform(values, lambda x: x.cast("double"))
    apart = bound(v, lambda a: bound(total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean)))
    unit = lambda a, norm: F.when(norm > 0, F.transform(a, lambda x: x / norm))
    return bound(apart, lambda a: bound(F.sqrt(total(F.transform(a, lambda x: x * x))), lambda norm: unit(a, norm)))
