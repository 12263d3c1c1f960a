"""Binary files: signatures, boxes, portable pixmaps and float arrays."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.order import prefix_sums

# How a naked codestream and a container begin.
CODESTREAM = bytes.fromhex("FF0A")
CONTAINER = bytes.fromhex("0000000C4A584C200D0A870A")


def sniff(content: Column, signatures: Sequence[tuple[bytes, str]] = ((CODESTREAM, "codestream"), (CONTAINER, "container"))) -> Column:
    """Name of the first signature that content begins with, else 'unknown'."""
    out = F.lit("unknown")
    for magic, name in reversed(list(signatures)):
        out = F.when(F.startswith(content, F.lit(bytearray(magic))), name).otherwise(out)
    return out


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def offsets(df: DataFrame, by: Sequence[str], order: Sequence[str], length: str, name: str) -> DataFrame:
    """Sum of the lengths before each section, in two levels: a file with very many sections is no single task."""
    out = prefix_sums(df, by, [F.col(c) for c in order], {name: F.col(length)})
    return out.withColumn(name, F.col(name).cast("bigint")).drop(f"{name}_all")


def parse_boxes(data: bytes) -> list[tuple[int, str, int, bytes]]:
    """(position, type, offset, payload) of each box; size 0 reaches to the end, 1 announces 64 bits."""
    out, at = [], 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("box header is cut off")
        size, kind, head = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        end = len(data) if size == 0 else at + size
        if end > len(data) or end < at + head:
            raise ValueError("box reaches beyond the file")
        out.append((len(out), kind, at, data[at + head : end]))
        at = end
    return out


def boxes(files: DataFrame) -> DataFrame:
    """path, position, type, offset, payload of files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, *b) for p, c in zip(pdf["path"], pdf["content"], strict=True) for b in parse_boxes(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "position", "type", "offset", "payload"])

    return files.select("path", "content").mapInPandas(run, "path string, position int, type string, offset bigint, payload binary")


def valid_containers(box_rows: DataFrame) -> DataFrame:
    """path, valid: the signature box is first and alone, the file type second, and there is a codestream."""
    is_a = lambda *kinds: F.col("type").isin(*kinds)
    one = (F.count_if(is_a("JXL ")) == 1) & (F.min(F.when(is_a("JXL "), F.col("position"))) == 0)
    two = (F.count_if(is_a("ftyp")) == 1) & (F.min(F.when(is_a("ftyp"), F.col("position"))) == 1)
    whole, parts = F.count_if(is_a("jxlc")), F.count_if(is_a("jxlp"))
    stream = ((whole == 1) & (parts == 0)) | ((whole == 0) & (parts > 0))
    return box_rows.groupBy("path").agg(F.coalesce(one & two & stream, F.lit(False)).alias("valid"))


def level(box_rows: DataFrame) -> DataFrame:
    """path, level: the first byte of the level box, 5 without one."""
    first = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int")
    return box_rows.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("type") == "jxll", first)), F.lit(5)).alias("level"))


def codestreams(box_rows: DataFrame) -> DataFrame:
    """path, content: the whole stream, or its parts by their index, whose top bit marks the last."""
    index = F.conv(F.hex(F.substring("payload", 1, 4)), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))
    part = F.col("type") == "jxlp"
    rows = box_rows.where(F.col("type").isin("jxlc", "jxlp")).select("path", F.when(part, index).otherwise(0).alias("k"), F.when(part, F.expr("substring(payload, 5)")).otherwise(F.col("payload")).alias("body"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda e: e.body)
    return rows.groupBy("path").agg(F.aggregate(ordered, F.lit(bytearray(b"")), lambda a, b: F.concat(a, b)).alias("content"))


def metadata(box_rows: DataFrame, kinds: Sequence[str] = ("Exif", "xml ", "jumb", "brob", "jxli", "jbrd")) -> DataFrame:
    """path, position, type and body of metadata boxes: an Exif body without the four bytes of its offset, the inner type of
    a compressed box in type_inside."""
    rows = box_rows.where(F.col("type").isin(*kinds))
    inner = F.when(F.col("type") == "brob", F.decode(F.substring("payload", 1, 4), "US-ASCII"))
    skip = F.col("type").isin("Exif", "brob")
    return rows.select("path", "position", "type", inner.alias("type_inside"), F.when(skip, F.expr("substring(payload, 5)")).otherwise(F.col("payload")).alias("body"))


def section_kinds(frames: DataFrame, keys: Sequence[str], lf_groups: str = "lf_groups", groups: str = "groups", passes: str = "passes") -> DataFrame:
    """keys, section, kind, number, pass of each section of a frame: one for all if it has one group and pass, else the
    global one, the low-frequency groups, the global one of high frequencies, and the groups of each pass."""
    lf, g, p = F.col(lf_groups), F.col(groups), F.col(passes)
    single = (g == 1) & (p == 1)
    rows = frames.select(*keys, lf.alias("_l"), g.alias("_g"), single.alias("_one"), F.explode(F.sequence(F.lit(0), F.when(single, 0).otherwise(1 + lf + g * p))).alias("section"))
    at, l = F.col("section"), F.col("_l")
    beyond = at - l - 2
    kind = F.when(F.col("_one"), "everything").when(at == 0, "lf_global").when(at <= l, "lf_group").when(at == l + 1, "hf_global").otherwise("pass_group")
    number = F.when(kind == "lf_group", at - 1).when(kind == "pass_group", beyond % F.col("_g"))
    return rows.select(*keys, "section", kind.alias("kind"), number.alias("number"), F.when(kind == "pass_group", F.floor(beyond / F.col("_g"))).alias("pass"))


def section_bytes(sections: DataFrame, by: Sequence[str], kind: str, length: str) -> DataFrame:
    """by, kind, bytes: the sections' lengths by kind."""
    return sections.groupBy(*by, kind).agg(F.sum(length).alias("bytes"))


def group_rect(index: Column, width: Column, height: Column, side: int) -> Column:
    """Struct x, y, width, height of a group of an image in raster order, cut off at its border; null beyond it."""
    across = F.ceil(width / side)
    x, y = (index % across) * side, F.floor(index / across) * side
    return F.when((index >= 0) & (y < height), F.struct(x.alias("x"), y.alias("y"), F.least(width - x, F.lit(side)).alias("width"), F.least(height - y, F.lit(side)).alias("height")))


def section_slice(content: Column, offset: Column, length: Column) -> Column:
    """The bytes of a section; null if it reaches beyond the content."""
    return F.when(offset + length <= F.octet_length(content), F.substr(content, (offset + 1).cast("int"), length.cast("int")))


def profile_context(position: Column, before: Column, twice_before: Column) -> Column:
    """Context of a byte of a colour profile: 0 up to position 128, then by the classes of the two bytes before."""
    letter = lambda b: b.between(65, 90) | b.between(97, 122)
    digit = lambda b: b.between(48, 57) | b.isin(44, 46)
    first = F.when(letter(before), 0).when(digit(before), 1).when(before <= 1, 2 + before).when(before < 16, 4).when(before.between(241, 254), 5).when(before == 255, 6).otherwise(7)
    second = F.when(letter(twice_before), 0).when(digit(twice_before), 1).when(twice_before < 16, 2).when(twice_before > 240, 3).otherwise(4)
    return F.when(position <= 128, 0).otherwise(1 + first + 8 * second)


def box(kind: str, payload: Column) -> Column:
    """A box around a payload."""
    return F.concat(F.unhex(F.lpad(F.hex(F.length(payload) + 8), 8, "0")), F.lit(bytearray(kind.encode("latin-1"))), payload)


def wrap(content: Column, level: int = 5) -> Column:
    """A container: signature, file type, level if not 5, and the codestream."""
    parts = [F.lit(bytearray(CONTAINER)), box("ftyp", F.lit(bytearray(b"jxl \0\0\0\0jxl ")))]
    if level != 5:
        parts.append(box("jxll", F.lit(bytearray([level]))))
    return F.concat(*parts, box("jxlc", content))


def ppm_header(data: bytes) -> tuple[int, int, int, int]:
    """width, height, largest value and where the samples begin of a P6 file; comments and blanks may be in between."""
    at, found = 2, []
    if data[:2] != b"P6":
        raise ValueError("no P6 file")
    while len(found) < 3:
        m = re.compile(rb"(?:\s+|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("header is cut off")
        found.append(int(m[1]))
        at = m.end()
    return found[0], found[1], found[2], at + 1


def ppm_sizes(files: DataFrame) -> DataFrame:
    """path, width, height, most, from the files' first bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(p, *ppm_header(bytes(c))[:3]) for p, c in zip(pdf["path"], pdf["head"], strict=True)], columns=["path", "width", "height", "most"])

    return files.select("path", F.substring("content", 1, 512).alias("head")).mapInPandas(run, "path string, width int, height int, most int")


def ppm_pixels(files: DataFrame) -> DataFrame:
    """image, c, y, x, v of P6 files, 8 bits or 16 bits big-endian."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                w, h, most, at = ppm_header(bytes(content))
                kind = np.dtype(">u2" if most > 255 else "u1")
                body = bytes(content)[at : at + w * h * 3 * kind.itemsize]
                if len(body) != w * h * 3 * kind.itemsize:
                    raise ValueError(f"{path}: samples are cut off")
                v = np.frombuffer(body, kind).reshape(h, w, 3)
                y, x, c = np.indices(v.shape)
                yield pd.DataFrame({"image": path, "c": c.ravel(), "y": y.ravel(), "x": x.ravel(), "v": v.ravel().astype(np.int64)})

    return files.select("path", "content").mapInPandas(run, "image string, c int, y int, x int, v int")


def npy_pixels(files: DataFrame) -> DataFrame:
    """image, frame, y, x, c, v of float arrays (frames, height, width, channels), little-endian 32 bits in C order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                v = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                if v.ndim != 4 or v.dtype != np.dtype("<f4"):
                    raise ValueError(f"{path}: not four dimensions of 32-bit floats")
                frame, y, x, c = np.indices(v.shape)
                yield pd.DataFrame({"image": path, "frame": frame.ravel(), "y": y.ravel(), "x": x.ravel(), "c": c.ravel(), "v": v.ravel()})

    return files.select("path", "content").mapInPandas(run, "image string, frame int, y int, x int, c int, v float")
