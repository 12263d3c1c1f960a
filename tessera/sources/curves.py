"""Files of measured curves and of labels as a data source: spark.read.format("measured").

Each file is a partition. A curve is a JSON object a line, with the version it is told to have, an image and its points; a
label file has a header line with the version, then a label a line. Filters on the image and, for labels, the target, that
only ask for equality, are applied while reading.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

CURVES = "image_id string, family_id string, split string, rung int, scale double, score double, bytes bigint"
LABELS = "image_id string, family_id string, split string, target double, state string, label_rung int, crossing double, beta double, label_bytes bigint"
#: Longest line; a longer one is no record.
MOST_LINE = 256 << 20


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


def _number(v: object, kind: type, name: str) -> object:
    """v as a number of the column's kind; null stays null, and anything else raises."""
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or (kind is int and v != int(v)):
        raise ValueError(f"{name} is not a number: {v!r}")
    return kind(v)


def curve_rows(text: str, version: str) -> Iterator[tuple]:
    """Points of one curve, by their place in it; another version, or a curve without an image's id or a point's scale, raises."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or raw.get("schema") != version:
        raise ValueError(f"not a curve of version {version}")
    image = raw.get("image") or {}
    if not image.get("id"):
        raise ValueError("a curve has no image")
    for p in raw.get("points") or []:
        if p.get("effective_scale") is None:
            raise ValueError("a point has no scale")
        yield image["id"], image.get("family_id"), image.get("split"), _number(p.get("rung"), int, "rung"), _number(p["effective_scale"], float, "scale"), _number(p.get("score"), float, "score"), _number(p.get("bytes"), int, "bytes")


def label_row(text: str) -> tuple:
    r = json.loads(text)
    if not r.get("image_id") or r.get("target") is None or r.get("state") not in ("crossed", "floor", "censored"):
        raise ValueError("a label has no image, target or state")
    return r["image_id"], r.get("family_id"), r.get("split"), _number(r["target"], float, "target"), r["state"], _number(r.get("label_rung"), int, "label_rung"), _number(r.get("crossing_scale"), float, "crossing_scale"), _number(r.get("beta"), float, "beta"), _number(r.get("label_bytes"), int, "label_bytes")


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, version: str):
        self.path, self.kind, self.version, self.wanted = path, kind, version, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on columns that are known before a row is built; Spark applies the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ({"image_id"} if self.kind == "curves" else {"image_id", "target"}) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        head = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(i.path for i in found if i.type == fs.FileType.File and i.base_name[0] not in "_." and i.base_name.endswith((".json", ".jsonl", ".txt")))
        return [_File(head + n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(partition.uri)
        wanted = [(0 if c == "image_id" else 3, v) for c, v in self.wanted.items()]
        with system.open_input_stream(place) as stream:
            for k, line in enumerate(_lines(stream)):
                try:
                    if self.kind == "labels" and k == 0:
                        if json.loads(line).get("schema") != self.version:
                            raise ValueError(f"not labels of version {self.version}")
                        continue
                    for row in curve_rows(line, self.version) if self.kind == "curves" else [label_row(line)]:
                        if all(row[c] == v for c, v in wanted):
                            yield row
                except (ValueError, AttributeError) as e:
                    raise ValueError(f"{partition.uri}, line {k + 1}: {e}") from e


def _lines(stream) -> Iterator[str]:
    """Lines that are not blank, with no more than one and a step in memory."""
    rest = b""
    while step := stream.read(1 << 20):
        *whole, rest = (rest + step).split(b"\n")
        if len(rest) > MOST_LINE:
            raise ValueError("a line is too long")
        yield from (w.decode() for w in whole if w.strip())
    if rest.strip():
        yield rest.decode()


class Measured(DataSource):
    """Options: path (a file or folder that pyarrow opens), kind (curves or labels) and version."""

    @classmethod
    def name(cls) -> str:
        return "measured"

    def schema(self) -> str:
        return LABELS if self.options.get("kind") == "labels" else CURVES

    def reader(self, schema) -> DataSourceReader:
        kind = self.options.get("kind", "curves")
        if kind not in ("curves", "labels") or not self.options.get("path") or not self.options.get("version"):
            raise ValueError("path, version and a kind, curves or labels, are needed")
        return _Reader(self.options["path"], kind, self.options["version"])


def read(spark: SparkSession, path: str, kind: str, version: str) -> DataFrame:
    """Curves (CURVES) or labels (LABELS) of the files at path. A bad header, version, record or number fails the read, with its file and line.

    Hidden files, and those of other endings than .json, .jsonl and .txt, are passed over; no files give no rows; a repeated
    record is repeated rows.
    """
    spark.dataSource.register(Measured)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("measured").options(path=path, kind=kind, version=version).load()
