"""Recurrences over bytes and samples: each line or text is one group, and groups are independent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reach of back-references.
WINDOW = 1 << 20


def lz77_tokens(data: bytes, least: int = 4, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(length, distance, byte): references to earlier bytes, or (0, 0, byte); the latest place of four equal bytes is tried."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    while at < len(data):
        key = data[at : at + least]
        place = seen.get(key, -1)
        size = 0
        if len(key) == least and 0 <= place and at - place <= window:
            while at + size < len(data) and data[place + size] == data[at + size]:
                size += 1
        if size >= least:
            out.append((size, at - place, 0))
        else:
            size = 1
            out.append((0, 0, data[at]))
        for k in range(at, min(at + size, len(data) - least + 1)):
            seen[data[k : k + least]] = k
        at += size
    return out


def lz77_bytes(tokens: Iterable[tuple[int, int, int]]) -> bytes:
    """The inverse; a reference may reach into what it is making."""
    out = bytearray()
    for size, distance, byte in tokens:
        if not size:
            out.append(byte)
        else:
            for _ in range(size):
                out.append(out[-distance])
    return bytes(out)


def lz77(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, bytes, tokens, references, longest of each text, with its round trip checked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                data = (t or "").encode()
                tokens = lz77_tokens(data)
                refs = [s for s, _, _ in tokens if s]
                rows.append((k, len(data), len(tokens), len(refs), max(refs, default=0), lz77_bytes(tokens) == data))
            yield pd.DataFrame(rows, columns=["k", "bytes", "tokens", "refs", "longest", "ok"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, bytes bigint, tokens bigint, refs bigint, longest bigint, ok boolean")
    return out.withColumnRenamed("k", key)


# The default parameters of the self-correcting predictor.
CORRECTION_NORTH, CORRECTION_WEST, CORRECTION_MIXED, GUESS_WEIGHTS = 16, 10, (7, 7, 7, 0, 0), (13, 12, 12, 12)


def _floor_log2(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1


def weighted_guesses(v: np.ndarray) -> np.ndarray:
    """Self-correcting prediction of each sample of images of one shape (images x height x width), in eighths of a step.

    Four guesses are weighted by the inverse of how far they missed nearby; the last result's own error feeds back. Each
    sample needs those before it, so the loop is over places and every step does all images. Samples of up to 30 bits.
    """
    m, h, w = v.shape
    v = v.astype(np.int64)
    out = np.zeros((m, h, w), np.int64)
    # One column more on both sides, and one line above: what is missing there falls back below.
    true_error, missed = np.zeros((m, h, w), np.int64), np.zeros((4, m, h, w), np.int64)
    for y in range(h):
        for x in range(w):
            west = v[:, y, x - 1] if x else v[:, y - 1, x] if y else np.zeros(m, np.int64)
            north = v[:, y - 1, x] if y else west
            corner = v[:, y - 1, x - 1] if x and y else west
            east = v[:, y - 1, x + 1] if y and x + 1 < w else north
            above = v[:, y - 2, x] if y > 1 else north
            w3, n3, nw3, ne3, nn3 = (a << 3 for a in (west, north, corner, east, above))
            at = lambda e, dy, dx, y=y, x=x: e[..., y + dy, x + dx] if y + dy >= 0 and 0 <= x + dx < w else None
            zero = np.zeros(m, np.int64)
            ew, en = at(true_error, 0, -1), at(true_error, -1, 0)
            ew, en = zero if ew is None else ew, zero if en is None else en
            enw, ene = at(true_error, -1, -1), at(true_error, -1, 1)
            enw, ene = en if enw is None else enw, en if ene is None else ene
            a, b, c, d, e = CORRECTION_MIXED
            guess = np.stack([w3 + ne3 - n3, n3 - (((ew + en + ene) * CORRECTION_NORTH) >> 5), w3 - (((ew + en + enw) * CORRECTION_WEST) >> 5), n3 - ((enw * a + en * b + ene * c + (nn3 - n3) * d + (nw3 - w3) * e) >> 5)])
            none = np.zeros((4, m), np.int64)
            mw, mn, mww = at(missed, 0, -1), at(missed, -1, 0), at(missed, 0, -2)
            mw, mn, mww = (none if q is None else q for q in (mw, mn, mww))
            mnw, mne = at(missed, -1, -1), at(missed, -1, 1)
            total = mn + mw + (mn if mnw is None else mnw) + mww + (mn if mne is None else mne) + (mw if x + 1 == w else 0)
            total &= 0xFFFFFFFF
            shift = np.maximum(_floor_log2(total + 1) - 5, 0)
            weight = 4 + ((np.array(GUESS_WEIGHTS)[:, None] * ((1 << 24) // ((total >> shift) + 1))) >> shift)
            weight >>= np.maximum(_floor_log2(np.maximum(weight.sum(axis=0), 1)) + 1 - 5, 0)
            share = weight.sum(axis=0)
            s = (share >> 1) - 1 + (guess * weight).sum(axis=0)
            value = (s * ((1 << 24) // np.maximum(share, 1))) >> 24
            inside = np.clip(value, np.minimum(np.minimum(w3, n3), ne3), np.maximum(np.maximum(w3, n3), ne3))
            value = np.where(((en ^ ew) | (en ^ enw)) <= 0, inside, value)
            out[:, y, x] = value
            real = v[:, y, x] << 3
            true_error[:, y, x] = value - real
            missed[:, :, y, x] = (np.abs(guess - real) + 3) >> 3
    return out


def self_correcting(df: DataFrame) -> DataFrame:
    """image, x, y, v and guess, the self-correcting prediction of each sample of rows (image, x, y, v).

    Images are gathered as arrays by one shuffle; those of one shape in a batch are worked on together.
    """
    whole = df.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda e: e.v.cast("bigint")).alias("values"), (F.max("x") + 1).cast("int").alias("width"))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sizes = np.stack([np.asarray(batch.column(1).value_lengths()), np.asarray(batch.column(2))], axis=1)
            for size, width in np.unique(sizes, axis=0).tolist():
                own = pa.array((sizes[:, 0] == size) & (sizes[:, 1] == width))
                v = np.asarray(batch.column(1).filter(own).flatten()).reshape(-1, size // width, width)
                guess = (weighted_guesses(v) + 3) >> 3
                image = batch.column(0).filter(own).take(pa.array(np.repeat(np.arange(len(v)), size)))
                y, x = np.divmod(np.tile(np.arange(size), len(v)), width)
                yield pa.RecordBatch.from_arrays([image, pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(v.ravel()), pa.array(guess.ravel())], names=["image", "x", "y", "v", "guess"])

    kind = dict(df.dtypes)["image"]
    return whole.mapInArrow(run, f"image {kind}, x int, y int, v bigint, guess bigint")


# Gains and feedback of the three cosines whose sum is the truncated Gaussian with a deviation of 1.5.
BLUR_GAIN = (0.05529523572608661, -0.05883668702694998, 0.012955819110517063)
BLUR_FEEDBACK = (1.902113032590307, 1.1755705045849463, 1.2246467991473532e-16)
BLUR_RADIUS = 5


def blur_taps() -> list[float]:
    """Weights of the samples 0, 1, 2, ... away: the cosines' response to one sample, which ends before BLUR_RADIUS."""
    taps = []
    for k in range(BLUR_RADIUS):
        # The response of a cosine to the window's two ends, n steps after the first of them.
        n, total = BLUR_RADIUS - 1 - k, 0.0
        for gain, feedback in zip(BLUR_GAIN, BLUR_FEEDBACK, strict=True):
            before, now = 0.0, 1.0
            for _ in range(n):
                before, now = now, feedback * now - before
            total += gain * now
        taps.append(total)
    return taps


def blur(df: DataFrame) -> DataFrame:
    """Gaussian of deviation 1.5 of rows (image, x, y, v), along lines, then columns, with zeros beyond the border."""
    taps = blur_taps()

    def along(c: str, a: str, b: str) -> Column:
        w = Window.partitionBy("image", a).orderBy(b)
        near = [F.coalesce(f(c, k).over(w), F.lit(0.0)) * t for k, t in enumerate(taps) if k for f in (F.lag, F.lead)]
        return sum(near, F.col(c) * taps[0])

    rows = df.repartition("image").withColumn("v", F.col("v").cast("double"))
    return rows.withColumn("_h", along("v", "y", "x")).withColumn("v", along("_h", "x", "y")).select("image", "x", "y", "v")
