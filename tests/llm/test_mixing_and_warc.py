"""Mixing targets and archives."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, warc


def water(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()) * total, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > sizes[s] * most}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: sizes[s] * most for s in full}
        left -= sum(sizes[s] * most for s in full)
        open_ -= full
    return target


def rows(n=400):
    out = [(k, "w " * (k % 23), ["a", "b", "c", None, "Z"][k % 5] if k % 3 else "hot") for k in range(n)]
    return out + [(n, None, "a"), (None, "x y", "b"), (0, "w", "tiny"), (n + 1, "", "none")]


def test_targets_like_step_by_step(spark):
    d = spark.createDataFrame([(*r, 9) for r in rows()], "doc_id long, text string, source string, size int")
    got = mixing.mix(d).collect()
    sizes = {}
    for _, t, s in rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    assert len(got) == len(rows())
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    assert taken["hot"] == pytest.approx(want["hot"], rel=0.2)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = {(r.doc_id, r.text, r.source): r.copies for r in mixing.mix(d.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text, r.source] == r.copies for r in got)
    assert mixing.repeated(mixing.mix(d)).count() == sum(r.copies for r in got)
    assert mixing.mix(d.limit(0)).count() == 0
    assert {r.copies for r in mixing.mix(d.where("text = ''")).collect()} <= {0}


def test_archives_come_back_whole(spark):
    pages = [(1, "http://a/\r\nX: y", "é<p>"), (2, None, "é<p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n" * 3), (6, "u", "x" * 100_000)]
    d = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    for gz in (True, False):
        path = warc.write_archives(warc.with_record_types(d), gzipped=gz, most=4096)
        names = [r.path for r in warc.read_folder(spark, path).select("path").collect()]
        assert names and all(n.endswith(".warc.gz" if gz else ".warc") for n in names)
        assert spark.read.parquet(f"{path}/_files").agg(F.sum("records")).first()[0] == len(pages) and spark.read.parquet(f"{path}/_files").count() == len(names)
        records = warc.read_archives(warc.read_folder(spark, path))
        assert records.where("problem is not null").count() == 0
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(records).collect()}
        digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        refers = {2: 1, 4: 3}
        assert got == {i: (len((t or "").encode()), digest(t), "revisit" if i in refers else "response", refers.get(i)) for i, _, t in pages}
    least = warc.with_record_types(d, least=1)
    assert {r.page_id for r in least.where("record_type = 'revisit'").collect()} == {2}
    empty = warc.write_archives(warc.with_record_types(d.limit(0)))
    assert warc.resolved(warc.read_archives(warc.read_folder(spark, empty))).count() == 0


def test_salvage_recovers_what_follows_damage():
    parts = [warc._record("response", str(k), "u", base64.b32encode(hashlib.sha1(b"p%d" % k).digest()).decode(), "", b"p%d" % k) for k in range(5)]
    plain = parts[0] + parts[1][:-9] + parts[2].replace(b"p2", b"q2") + b"noise" + parts[3] + parts[4]
    got = list(warc.salvage(plain))
    assert [f["warc-record-id"][-2] for *_, p, f, _ in got if p is None] == ["0", "3", "4"]
    assert [(o, n) for o, n, p, *_ in got if p] == [(len(parts[0]), len(parts[1]) - 9 + len(parts[2]) + 5)]
    members = [gzip.compress(p, mtime=0) for p in parts]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + bytes(broken) + members[2] + members[3][: len(members[3]) // 2] + members[4]
    got = list(warc.salvage(data))
    assert [f["warc-record-id"][-2] for *_, p, f, _ in got if p is None] == ["0", "2", "4"]
    assert sum(n for _, n, *_ in got) == len(data)
    assert list(warc.salvage(b"")) == [] and [p for _, _, p, *_ in warc.salvage(b"junk")] == ["no gzip member"]


def test_salvage_resumes_inside_a_member():
    noise = [hashlib.sha512(b"%d-%d" % (k, j)).digest() for k in range(6) for j in range(400)]
    body = [b"".join(noise[400 * k : 400 * k + 400]) for k in range(6)]
    parts = [warc._record("response", str(k), "u", base64.b32encode(hashlib.sha1(b).digest()).decode(), "", b) for k, b in enumerate(body)]
    name = lambda got: [f["warc-record-id"][-2] for *_, p, f, _ in got if p is None]
    bad = bytearray(parts[2])
    bad[-9] ^= 1
    one = gzip.compress(b"".join([*parts[:2], bytes(bad), *parts[3:]]), mtime=0)
    got = list(warc.salvage(one))
    start = len(parts[0]) + len(parts[1])
    assert name(got) == ["0", "1", "3", "4", "5"] and {(o, n) for o, n, *_ in got} == {(0, len(one))}
    assert [p for _, _, p, *_ in got if p] == [f"payload digest differs, bytes {start} to {start + len(bad)} of the member"]
    whole, last = gzip.compress(b"".join(parts[:5]), mtime=0), gzip.compress(parts[5], mtime=0)
    cut = whole[: len(whole) * 7 // 10]
    for data in (cut, cut + last):
        got = list(warc.salvage(data))
        assert name(got) == ["0", "1", "2"] + ["5"] * (data != cut)
        assert (0, len(cut)) in [(o, n) for o, n, p, *_ in got if p]
    flipped = bytearray(whole)
    flipped[-6] ^= 1
    got = list(warc.salvage(bytes(flipped) + last))
    assert name(got) == ["0", "1", "2", "3", "4", "5"] and any("incorrect data check" in p for _, _, p, *_ in got if p)


def test_word_counts(spark):
    d = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc\u00a0d ",)], "text string")
    assert [r[0] for r in d.select(mixing.word_count(F.col("text"))).collect()] == [0, 0, 3]
