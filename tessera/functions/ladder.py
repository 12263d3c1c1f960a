"""The ladder of quantizers: rungs and the scales that they stand for, bands around a target, and curves of several kinds in one table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest scale of a step of 1, and largest factor on top of it.
MOST_SCALE, MOST_FACTOR = 73_728, 65
#: Points by which a score may exceed its target and still count as met.
BAND = 1.0


def segments() -> list[tuple[int, int]]:
    """For each factor, its first rung and the scale there: the rungs of a factor are those that are finer than all of the factor before."""
    out, rung = [], 0
    for k in range(1, MOST_FACTOR + 1):
        first = (k - 1) * MOST_SCALE // k + 1
        out.append((rung, first))
        rung += MOST_SCALE - first + 1
    return out


#: Rungs of the ladder.
RUNGS = segments()[-1][0] + MOST_SCALE - segments()[-1][1] + 1


def _segment(value: Column, starts: list[int]) -> Column:
    """Number (from 0) of the last start that is not above the value."""
    return F.greatest(F.size(F.filter(F.lit(starts), lambda s: s <= value)) - 1, F.lit(0))


def effective_scale(rung: Column) -> Column:
    """Scale of a rung (from 0), which is a scale of up to MOST_SCALE times a factor, and rises with the rung. Beyond the ladder, its ends."""
    r = F.greatest(F.least(rung.cast("bigint"), F.lit(RUNGS - 1)), F.lit(0))
    k = _segment(r, [s for s, _ in segments()])
    at = lambda j: F.get(F.lit([s[j] for s in segments()]), k)
    return F.when(rung.isNotNull(), (at(1) + r - at(0)) * (k + 1))


def rung_for_scale(scale: Column) -> Column:
    """The finest rung whose scale is not above the rounded one, at least the first; NaN and infinite ones are the first, null is null."""
    top = MOST_SCALE * MOST_FACTOR
    s = F.round(F.greatest(F.least(scale.cast("double"), F.lit(float(top))), F.lit(1.0))).cast("bigint")
    k = F.ceil(s / MOST_SCALE).cast("int") - 1
    at = lambda j: F.get(F.lit([s[j] for s in segments()]), k)
    # Below the factor's first rung, the last one of the factor before.
    found = at(0) + F.greatest(F.floor(s / (k + 1)) - at(1), F.lit(-1))
    odd = F.isnan(scale.cast("double")) | (F.abs(scale.cast("double")) == float("inf"))
    return F.when(odd, F.lit(0).cast("bigint")).when(scale.isNotNull(), found.cast("bigint"))


def met_band(target: Column, reserve: float = 0.0, multiple: float = 0.0, band: float = BAND) -> Column:
    """How far a score may exceed its target: band, or with a multiple, that many reserves of the target's loss, if more."""
    return F.greatest(F.lit(band), multiple * reserve * F.greatest(100.0 - target, F.lit(1e-3)))


def curve_union(parts: Mapping[str, DataFrame], name: str = "source") -> DataFrame:
    """Records of several kinds in one table, with the kind's name; columns that a kind lacks are null there. Its rows keep their number."""
    out = None
    for kind, df in parts.items():
        named = df.withColumn(name, F.lit(kind))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no curves are given")
    return out
