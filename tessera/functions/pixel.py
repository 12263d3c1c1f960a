"""Arithmetic of samples, coefficients and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift(v: Column, bits: int) -> Column:
    """Arithmetic shift right, which floors."""
    return F.shiftright(v, bits)


def rct_forward(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Reversible luma, orange and green differences."""
    co = red - blue
    t = blue + shift(co, 1)
    cg = green - t
    return t + shift(cg, 1), co, cg


def rct_inverse(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - shift(cg, 1)
    green = cg + t
    blue = t - shift(co, 1)
    return blue + co, green, blue


def rct_inverse_any(kind: int, a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The 42 inverse colour transforms: 6 orders of the outputs times 7 ways to undo the differences."""
    order, way = divmod(kind, 7)
    if way == 6:
        out = rct_inverse(a, b, c)
    else:
        third = c + a if way & 1 else c
        half = way >> 1
        second = b + a if half == 1 else b + shift(a + third, 1) if half == 2 else b
        out = (a, second, third)
    # The first three orders are rotations, the others the same with the last two swapped.
    places = [order % 3, (order + 1 + order // 3) % 3, (order + 2 - order // 3) % 3]
    final: list[Column | None] = [None, None, None]
    for value, place in zip(out, places, strict=True):
        final[place] = value
    return tuple(final)


def pack_signed(v: Column) -> Column:
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unpack_signed(u: Column) -> Column:
    return F.when(u.bitwiseAND(F.lit(1)) == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def bit_length(v: Column) -> Column:
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def hybrid_token(v: Column, split_exponent: int = 4, msb: int = 2, lsb: int = 0) -> tuple[Column, Column, Column]:
    """token, number of extra bits and their value of an unsigned value."""
    split = 1 << split_exponent
    n = bit_length(v) - 1
    low = v.bitwiseAND(F.lit((1 << lsb) - 1))
    two = F.lit(1).cast("bigint")
    top = F.call_function("shiftleft", two, n.cast("int"))
    high = F.call_function("shiftright", v - top, (n - msb).cast("int"))
    token = split + F.shiftleft(n - split_exponent, msb + lsb) + F.shiftleft(high, lsb) + low
    bits = n - msb - lsb
    extra = F.shiftright(v, lsb).bitwiseAND(F.call_function("shiftleft", two, bits.cast("int")) - 1)
    small = v < split
    zero = F.lit(0).cast("bigint")
    return F.when(small, v).otherwise(token).cast("bigint"), F.when(small, zero).otherwise(bits.cast("bigint")), F.when(small, zero).otherwise(extra)


def hybrid_value(token: Column, extra: Column, split_exponent: int = 4, msb: int = 2, lsb: int = 0) -> Column:
    split = 1 << split_exponent
    own = token - split
    n = split_exponent + F.shiftright(own, msb + lsb)
    bits = (n - msb - lsb).cast("int")
    high = F.shiftright(own, lsb).bitwiseAND(F.lit((1 << msb) - 1)) + F.lit(1 << msb)
    low = own.bitwiseAND(F.lit((1 << lsb) - 1))
    value = F.shiftleft(F.call_function("shiftleft", high.cast("bigint"), bits) + extra, lsb) + low
    return F.when(token < split, token).otherwise(value)


def gradient(w: Column, n: Column, nw: Column) -> Column:
    """w + n - nw, kept between w and n."""
    return F.least(F.greatest(w + n - nw, F.least(w, n)), F.greatest(w, n))


def tendency(a: Column, b: Column, c: Column) -> Column:
    """Expected residual between neighbours a, b, c if they fall or rise throughout, else 0.

    A rising run is a falling one with its signs changed. The slope's share is kept so that both samples of the pair stay
    between their neighbours.
    """
    sign = F.when((a >= b) & (b >= c), 1).when((a <= b) & (b <= c), -1).otherwise(0).cast("bigint")
    parity = lambda v: v.bitwiseAND(F.lit(1).cast("bigint"))
    share = F.floor((sign * (4 * a - 3 * c - b) + 6) / 12).cast("bigint")
    first, second = 2 * sign * (a - b), 2 * sign * (b - c)
    kept = F.when(share - parity(share) > first, first + 1).otherwise(share)
    return sign * F.when(kept + parity(kept) > second, second).otherwise(kept)


def mirror(at: Column, size: Column) -> Column:
    """An index reflected into 0 .. size - 1, the border sample counted twice."""
    p = F.pmod(at, 2 * size)
    return F.when(p < size, p).otherwise(2 * size - 1 - p)


def srgb_to_linear(v: Column) -> Column:
    a = F.abs(v)
    return F.signum(v) * F.when(a <= 0.04045, a / 12.92).otherwise(F.pow((a + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    a = F.abs(v)
    return F.signum(v) * F.when(a <= 0.0031308, a * 12.92).otherwise(1.055 * F.pow(a, F.lit(1 / 2.4)) - 0.055)


# The opsin absorbance matrix and bias of the XYB colour space.
OPSIN = [[0.30, 0.622, 0.078], [0.23, 0.692, 0.078], [0.24342268924547819, 0.20476744424496821, 0.55180986650955360]]
OPSIN_BIAS = 0.0037930732552754493


def linear_to_xyb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    root = OPSIN_BIAS ** (1 / 3)
    l, m, s = (F.cbrt(F.greatest(F.lit(x) * r + F.lit(y) * g + F.lit(z) * b + OPSIN_BIAS, F.lit(0.0))) - root for x, y, z in OPSIN)
    return (l - m) / 2, (l + m) / 2, s


def xyb_to_linear(x: Column, y: Column, b: Column) -> tuple[Column, Column, Column]:
    import numpy as np

    root, inverse = OPSIN_BIAS ** (1 / 3), np.linalg.inv(np.array(OPSIN))
    cone = [F.pow(v + root, F.lit(3.0)) - OPSIN_BIAS for v in (y + x, y - x, b)]
    return tuple(sum((F.lit(float(w)) * v for w, v in zip(row, cone, strict=True)), F.lit(0.0)) for row in inverse)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Full-range conversion, chroma around 0."""
    return y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def quantize_sample(v: Column, most: int, clamp: bool = True) -> Column:
    """Scaled, rounded half away from zero, with clamp kept in 0 .. most; 0 if not finite."""
    s = v * most
    whole = F.least(F.greatest(F.round(s), F.lit(0.0)), F.lit(float(most))) if clamp else F.round(s)
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")) | s.isNull(), 0).otherwise(whole.cast("int"))


def bias_adjust(q: Column, bias: float, numerator: float) -> Column:
    return F.when(F.abs(q) <= 1, q * bias).otherwise(q - numerator / F.when(q != 0, q))


def residual_bits(q: Column) -> Column:
    return F.when(q == 0, 0).otherwise(bit_length(F.abs(q)) + 1)


def composite8(source: Column, background: Column, alpha: Column) -> Column:
    """Source over background, rounded."""
    return F.floor((source * alpha + background * (255 - alpha) + 127) / 255).cast("int")


def blend(mode: Column, old: Column, new: Column, old_alpha: Column, new_alpha: Column, clamp: bool = True, associated: bool = False) -> Column:
    """replace, add, mul, blend (over) and muladd (new weighted by its alpha); clamp keeps alpha, or mul's sample, in 0 .. 1."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) if clamp else v
    a = unit(new_alpha)
    out = a * (1 - old_alpha) + old_alpha
    over = (1 - a) * old + new if associated else F.when(out == 0, F.lit(0.0)).otherwise((a * new + old_alpha * old * (1 - a)) / F.when(out != 0, out))
    return F.when(mode == "replace", new).when(mode == "add", old + new).when(mode == "mul", old * unit(new)).when(mode == "muladd", old + a * new).when(mode == "blend", over)


def patch_blend(mode: Column, old: Column, new: Column, alpha: Column) -> Column:
    """none, replace, add, mul, and over and weighted sums with either of the two on top."""
    over, under = old + alpha * (new - old), new + alpha * (old - new)
    made = {"none": old, "replace": new, "add": old + new, "mul": old * new, "blend_above": over, "blend_below": under, "muladd_above": old + alpha * new, "muladd_below": new + alpha * old}
    out = F.lit(None).cast("double")
    for name, value in made.items():
        out = F.when(mode == name, value).otherwise(out)
    return out


def orient(orientation: Column, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Where a sample goes under the eight orientations 1 .. 8."""
    fx, fy = width - 1 - x, height - 1 - y
    nx = F.when(orientation.isin(1, 4), x).when(orientation.isin(2, 3), fx).when(orientation.isin(5, 8), y).otherwise(fy)
    ny = F.when(orientation.isin(1, 2), y).when(orientation.isin(3, 4), fy).when(orientation.isin(5, 6), x).otherwise(fx)
    return nx, ny


def mannos_sakrison(f: Column) -> Column:
    """Contrast sensitivity at a frequency in cycles per degree."""
    return 2.6 * (0.0192 + 0.114 * f) * F.exp(-F.pow(0.114 * f, F.lit(1.1)))


def radial_frequency(u: Column, v: Column, side: int) -> Column:
    return F.sqrt(F.pow(u / side, F.lit(2.0)) + F.pow(v / side, F.lit(2.0))) / F.sqrt(F.lit(2.0))


# The metric's published scale, cubic and power.
REMAP_SCALE, REMAP_CUBIC, REMAP_POWER = 0.9562382616834844, (2.326765642916932, -0.020884521182843837, 6.248496625763138e-5), 0.6276336467831387


def score_remap(error: Column) -> Column:
    """Score of a weighted error: 100 less ten times a power of its cubic, 100 where the cubic is not positive."""
    x = error * REMAP_SCALE
    one, two, three = REMAP_CUBIC
    y = three * x * x * x + one * x + two * x * x
    return F.when(y > 0, 100 - 10 * F.pow(y, F.lit(REMAP_POWER))).otherwise(F.lit(100.0))


def truncated(v: Column, by: int | Column) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", v, F.lit(by) if isinstance(by, int) else by)


# The linear part of the Rec.709 transfer and its slope.
REC709_LINEAR, REC709_SLOPE = 0.018, 4.5


def linear_to_rec709(v: Column) -> Column:
    a = F.abs(v)
    return F.signum(v) * F.when(a < REC709_LINEAR, a * REC709_SLOPE).otherwise(1.099 * F.pow(a, F.lit(0.45)) - 0.099)


def linear_to_gamma(v: Column, gamma: float) -> Column:
    """Sign-preserving power: |v| to the power gamma."""
    return F.signum(v) * F.pow(F.abs(v), F.lit(float(gamma)))


def dequantize_lf(q: Column, multiplier: Column, extra_bits: Column) -> Column:
    return q * multiplier / F.pow(F.lit(2.0), extra_bits)


def quant_multiplier(scale: Column) -> Column:
    return F.pow(F.lit(0.8), scale - 2.0)


def apply_chroma_from_luma(x: Column, y: Column, b: Column, kx: Column, kb: Column) -> tuple[Column, Column]:
    """The two chroma values with their share of luma added back."""
    return x + kx * y, b + kb * y


def unassociate_alpha(v: Column, alpha: Column, most: int) -> Column:
    """A premultiplied integer sample divided by its alpha, rounded, at most most; 0 where alpha is 0."""
    return F.when(alpha == 0, F.lit(0).cast("bigint")).otherwise(F.least(truncated(v * most + truncated(alpha, 2), F.when(alpha != 0, alpha)), F.lit(most).cast("bigint")))


def depth_quantize(v: Column, bits: int, clamp: bool = True) -> Column:
    """A sample on the integers of so many bits; clamp keeps one outside 0 .. 1 in their range."""
    return quantize_sample(v, (1 << bits) - 1, clamp)


def noise_strength(v: Column, table: list[float]) -> Column:
    """Piecewise-linear lookup of six times a value in a table of eight, its last entry from 7 on, kept in 0 .. 1."""
    at = F.greatest(v * 6, F.lit(0.0))
    k = F.when(at >= 7, 6).otherwise(F.least(F.floor(at), F.lit(6))).cast("int")
    share = F.when(at >= 7, 1.0).otherwise(at - k)
    lit = F.lit([float(x) for x in table])
    value = F.element_at(lit, k + 1) * (1 - share) + F.element_at(lit, k + 2) * share
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Hue in turns, saturation and value in 0 .. 1."""
    at = (h - F.floor(h)) * 6
    sector = F.floor(at).cast("int") % 6
    f = at - F.floor(at)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *cs: F.element_at(F.array(*cs), sector + 1)
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def edge_weight(distance: Column, inverse_sigma: Column) -> Column:
    """Weight of a neighbour at a distance in value: falls in a straight line to 0."""
    return F.greatest(F.lit(0.0), 1 - distance * inverse_sigma)
