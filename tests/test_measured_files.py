"""Curve and label files through the data source."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import curves


def _write(folder, files):
    for name, lines in files.items():
        (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(folder)


def _curve(image, points, version="c/1"):
    return {"schema": version, "image": {"id": image, "family_id": "f"}, "points": [{"rung": r, "effective_scale": s, "score": v, "bytes": b} for r, s, v, b in points]}


def test_curves_with_a_pushed_filter(spark, tmp_path):
    path = _write(tmp_path, {"a.json": [_curve("a", [(1, 10, 5.5, 100), (2, 20, 7, None)]), "", _curve("b", [])], "b.jsonl": [_curve("c", [(1, 3, None, 9)])], "_hidden.json": ["no"], "c.bin": ["no"], "empty.json": []})
    df = curves.read(spark, path, "curves", "c/1")
    assert sorted(map(tuple, df.collect())) == [("a", "f", None, 1, 10.0, 5.5, 100), ("a", "f", None, 2, 20.0, 7.0, None), ("c", "f", None, 1, 3.0, None, 9)]
    assert df.rdd.getNumPartitions() == 3
    assert [r.rung for r in df.where((F.col("image_id") == "a") & (F.col("score") > 6)).collect()] == [2]
    reader = curves._Reader(path, "curves", "c/1")
    left = list(reader.pushFilters([curves.EqualTo(("image_id",), "a"), curves.EqualTo(("score",), 7.0)]))
    assert [f.attribute for f in left] == [("score",)]
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"a"}


def test_labels(spark, tmp_path):
    label = {"image_id": "a", "family_id": "f", "split": "s", "target": 30, "state": "crossed", "label_rung": 4, "crossing_scale": 33.5, "beta": None, "label_bytes": 12}
    path = _write(tmp_path, {"l.jsonl": [{"schema": "l/1"}, label, label | {"target": 50.0, "state": "censored", "label_rung": None}]})
    df = curves.read(spark, path, "labels", "l/1")
    assert [r.label_rung for r in df.orderBy("target").collect()] == [4, None]
    assert df.where("target = 50.0").count() == 1


@pytest.mark.parametrize(
    ("kind", "lines", "what"),
    [
        ("curves", [_curve("a", [(1, 1, 1, 1)], "c/2")], "version"),
        ("curves", [_curve("", [(1, 1, 1, 1)])], "no image"),
        ("curves", [_curve("a", [(1, None, 1, 1)])], "no scale"),
        ("curves", [_curve("a", [(1, "x", 1, 1)])], "not a number"),
        ("curves", ["{"], "line 1"),
        ("labels", [{"schema": "c/2"}], "version"),
        ("labels", [{"schema": "c/1"}, {"image_id": "a", "target": 1, "state": "odd"}], "line 2"),
    ],
)
def test_bad_files_fail_the_read(spark, tmp_path, kind, lines, what):
    path = _write(tmp_path, {"x.json": lines})
    with pytest.raises(Exception, match=what):
        curves.read(spark, path, kind, "c/1").collect()
    with pytest.raises(Exception, match="needed"):
        curves.read(spark, path, "other", "c/1").collect()
