"""File names, stamps and report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings that name a reproduction of the same picture.
NOISE = r"[\s_\-]*(?:\(\d+\)|copy|\d{3,4}x\d{3,4}|small|large|hd)"


def stem(name: Column) -> Column:
    """Lower case, without the last extension, without the endings of NOISE however many there are, trimmed; if nothing is
    left, the whole name in lower case."""
    low = F.lower(name)
    bare = F.regexp_replace(low, r"^(\.*[^.].*)\.[^.]*$", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, rf"(?:{NOISE}\s*)+$", ""), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), low)


def family_key(folder: Column, name: Column) -> Column:
    return F.replace(F.concat_ws("/", folder, stem(name)), F.lit("\\"), F.lit("/"))


def camera_stamp(name: Column) -> Column:
    """Time at the beginning of a name such as 20240131_235959.jpg, null if there is none or it is no time."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"^(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def capture_date(name: Column) -> Column:
    return F.coalesce(F.date_format(camera_stamp(name), "yyyy-MM-dd"), F.lit("unstamped"))


def key_values(line: Column) -> Column:
    """Map of a line of key=value tokens; the first '=' splits, tokens without one are left out."""
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: F.contains(t, F.lit("=")))
    pair = lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substr(t, F.length(F.substring_index(t, "=", 1)) + 2).alias("v"))
    return F.map_from_entries(F.transform(tokens, pair))


def csv_floats(text: Column) -> Column:
    """Positive finite numbers of a comma-separated list, null if any is not."""
    values = F.transform(F.split(text, ","), lambda t: F.trim(t).try_cast("double"))
    return F.when(F.forall(values, lambda v: F.coalesce((v > 0) & (v < float("inf")), F.lit(False))), values)


def metric(line: Column, name: str) -> Column:
    """The number after 'name=' as text ('inf' too), null if missing."""
    return F.nullif(F.regexp_extract(line, rf"(?:^|\s){name}=([-+0-9.eE]+|inf)(?:\s|$)", 1), F.lit(""))


#: Metrics of a report line; a harness adds its own by name.
METRICS = ("psnr_db", "ssimulacra2", "butteraugli", "butteraugli_pnorm3")


def metrics(line: Column, names: Sequence[str] = METRICS) -> Column:
    """Struct of the metrics of a report line as text; 'inf' stays, missing ones are null."""
    return F.struct(*[metric(line, n).alias(n) for n in names])


def quality_line(output: Column) -> Column:
    """Struct of the fields of a coder's summary line, wherever in its output each stands; null unless target, achieved
    score and status are there."""
    field = lambda name: F.nullif(F.regexp_extract(output, rf"(?:^|\s){name}=(\S+)", 1), F.lit(""))
    number = lambda name, kind: field(name).try_cast(kind)
    whole = F.struct(
        number("quality_target", "double").alias("requested_score"), number("achieved", "double").alias("achieved_score"), number("bytes", "bigint").alias("bytes"), field("metric").alias("metric"),
        field("effort").alias("effort"), number("probes", "bigint").alias("probes"), number("prices", "bigint").alias("prices"), field("status").alias("status"),
    )
    return F.when(number("quality_target", "double").isNotNull() & number("achieved", "double").isNotNull() & field("status").isNotNull(), whole)


def named_counters(output: Column, labels: Sequence[str]) -> Column:
    """Map label -> map of counters (as text) of the lines 'label=name=value name=value ...' with a wanted label.

    Tokens without '=' or whose value is no number are left out; of lines with one label the last counts.
    """
    lines = F.filter(F.split(output, r"\r?\n"), lambda t: F.contains(t, F.lit("=")) & F.substring_index(t, "=", 1).isin(*labels))
    body = lambda t: F.substr(t, F.length(F.substring_index(t, "=", 1)) + 2)
    tokens = lambda t: F.filter(F.split(F.trim(body(t)), r"\s+"), lambda x: F.rlike(x, F.lit(r"^[^=]*=[-+]?(\d+|\d*\.?\d+([eE][-+]?\d+)?|\d+\.)$")))
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v"))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps), F.lit(1))), lambda q: q.k == p.k))
    entries = F.transform(lines, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.map_from_entries(last(F.transform(tokens(t), pair))).alias("v")))
    return F.map_from_entries(last(entries))


def capture_stem(path: Column, pattern: str = r"([A-Za-z]+[_-]?\d+)") -> Column:
    """The pattern's group in a path's last part, null if it is not there."""
    return F.nullif(F.regexp_extract(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), pattern, 1), F.lit(""))


#: Formats by their extensions.
FORMATS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "gif": "gif", "ico": "ico", "tga": "tga", "qoi": "qoi", "pgm": "pgm", "ppm": "ppm", "pnm": "pnm"}


def format_of(extension: Column) -> Column:
    """Format of an extension with or without its dot, in any case; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), F.lower(F.ltrim(extension, F.lit("."))))


def status_token(name: Column) -> Column:
    """A name in camel case as snake case."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def valid_score(score: Column) -> Column:
    return score.between(0, 100) & ~F.isnan(score)


def size_bucket(width: Column, height: Column) -> Column:
    """Name of a pixel count's size class."""
    n = width.cast("bigint") * height
    return F.when(n < 64 * 64, "tiny").when(n < 256 * 256, "small").when(n < 1024 * 1024, "medium").when(n < 4096 * 2048, "large").otherwise("xlarge")
