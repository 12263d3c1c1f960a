"""WARC archives: a writer of .warc.gz files with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, skew_join, stored

VERSION = b"WARC/1.1"
START = re.compile(rb"WARC/\d\.\d\r\n")
MEMBER = b"\x1f\x8b\x08"
#: Compressed bytes taken at once.
STEP = 1 << 14
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()

#: Damage: what stands between two valid records, or a record that failed a check.
RECORD = "path string, offset bigint, length bigint, problem string, record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload binary"


def _record(kind: str, name: str, uri: str, digest: str, refers: str, payload: bytes) -> bytes:
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:tessera:{name}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if uri:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers:
        head += [f"WARC-Refers-To: <urn:tessera:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """For each row: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    The payload is the body in UTF-8, null is empty. Of rows with equal payloads of at least least bytes, the one with
    the smallest id is the response, and the others are revisits that refer to it; shorter payloads are all responses.
    Ids must be unique: of equal smallest ids, all are responses. A null id never is the smallest unless all are null.
    Equal payloads are found by digest and length; their smallest id is pre-aggregated before the shuffle. A page copied
    into a third of the rows gets it by broadcast, so its payloads do not meet in one task. Other columns are not read; an
    empty table stays empty.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("_sha", F.sha1("payload"))
    rows = rows.withColumn("_key", F.concat_ws(":", "_sha", "payload_bytes"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("n")).where("n > 1")
    out = skew_join(rows, stored(first, "repeats"), "_key")
    revisit = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")))
    return out.select("page_id", "url", "payload", "payload_bytes", "_sha", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


ARCHIVES = "name string, bytes bigint, records bigint"


def archive_files(typed: DataFrame, path: str, gzipped: bool = True, most: int = 64 << 20) -> DataFrame:
    """Writes typed (of with_record_types) as archive files of about most bytes below path: name, bytes, records of each.

    A task writes its files to a folder of its attempt and moves that to its own place when it is done, in place of what an
    earlier attempt left; so a task that is run again leaves no record twice. Every record is a gzip member of its own if
    gzipped. Revisits carry no payload. path is on a file system that pyarrow opens: local or mounted, HDFS, S3, GCS.
    """

    def files(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, root = fs.FileSystem.from_uri(path)
        own, done = f"{root}/_attempts/{part:05d}-{attempt}", f"{root}/part-{part:05d}"
        made: list[tuple[str, int, int]] = []
        out, size, records = None, 0, 0
        for batch in parts:
            for page, url, payload, sha, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "_sha", "record_type", "refers_to")), strict=True):
                record = _record(kind, "none" if page is None else str(page), url or "", _base32(sha), "" if refers is None else str(refers), payload if kind == "response" else b"")
                record = gzip.compress(record, 4, mtime=0) if gzipped else record
                if out is None:
                    system.create_dir(own, recursive=True)
                    name = f"{len(made):05d}.warc{'.gz' * gzipped}"
                    out, size, records = system.open_output_stream(f"{own}/{name}", compression=None), 0, 0
                out.write(record)
                size, records = size + len(record), records + 1
                if size >= most:
                    out.close()
                    made.append((f"part-{part:05d}/{name}", size, records))
                    out = None
        if out is not None:
            out.close()
            made.append((f"part-{part:05d}/{name}", size, records))
        if made:
            if system.get_file_info(done).type != fs.FileType.NotFound:
                system.delete_dir(done)
            system.move(own, done)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "bytes", "records"])

    return typed.select("page_id", "url", "payload", "_sha", "record_type", "refers_to").mapInArrow(files, ARCHIVES)


def write_archives(typed: DataFrame, path: str | None = None, gzipped: bool = True, most: int = 16 << 20) -> str:
    """Writes the archives of typed to a folder (a new one in the shared folder by default) and gives its path.

    A list of the files is kept beside them, in _files.
    """
    path = path or new_path(typed.sparkSession, "warc")
    archive_files(typed, path, gzipped, most).write.parquet(f"{path}/_files")
    return path


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at a place: where it ends, its fields and payload; or which check it failed."""
    if not START.match(data, at):
        return "no version line"
    # A header may be of any length, but ends before the next version line.
    following = START.search(data, at + 8)
    split = data.find(b"\r\n\r\n", at, following.start() if following else len(data))
    if split < 0:
        return "header runs into another record" if following else "header without end"
    fields = _fields(data[at:split])
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")):
        return "no content length"
    if "warc-type" not in fields or "warc-record-id" not in fields:
        return "a required field is missing"
    end = split + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "payload does not end where it should"
    payload = data[split + 4 : end]
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and fields["warc-type"] != "revisit" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
        return "payload digest differs"
    return end + 4, fields, payload


def _member(data: bytes, at: int) -> tuple[int, bytes, str | None]:
    """The gzip member at a place: where it ends, its content and None; or, with the check it failed, what was inflated before."""
    if data[at : at + 3] != MEMBER:
        return at, b"", "no gzip member"
    inflate, out, place, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not inflate.eof and place < len(data):
            out.append(inflate.decompress(view[place : place + STEP]))
            place += min(STEP, len(data) - place)
    except zlib.error as e:
        # The step that failed gave nothing; taken again byte by byte, it gives what comes before the error.
        inflate = zlib.decompressobj(31)
        for k in range(at, place, STEP):
            inflate.decompress(view[k : k + STEP])
        with contextlib.suppress(zlib.error):
            for k in range(place, min(place + STEP, len(data))):
                out.append(inflate.decompress(view[k : k + 1]))
        return place, b"".join(out), f"gzip: {e}"[:80]
    return (place - len(inflate.unused_data), b"".join(out), None) if inflate.eof else (place, b"".join(out), "gzip member is cut off")


def _inside(content: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """Records and gaps of a member's content, in order: where each begins and ends, problem, fields, payload."""
    at, gap, why = 0, None, ""
    while at < len(content):
        got = _parse(content, at)
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            at = content.find(b"WARC/", at + 1)
            at = len(content) if at < 0 else at
            continue
        if gap is not None:
            yield gap, at, why, {}, b""
            gap = None
        yield at, got[0], None, *got[1:]
        at = got[0]
    if gap is not None:
        yield gap, at, why, {}, b""


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """Records of an archive and its quarantined gaps, in order: offset, length, problem (None for a record), fields, payload.

    After a failed check the reader searches for the next place at which a valid record (or a gzip member with one) begins,
    and logs the bytes up to there with the first check that failed. Bytes are never dropped silently: records and gaps tile
    the file. Within a member's content it searches likewise: rows of one member have its offset and length, and a gap's
    problem names the bytes of the content. A member that is cut off or fails to inflate gives the records of what was
    inflated before; they have its offset, the length that was read, and the file's gap for the damage begins there too.
    """
    at, gap, why = 0, None, ""
    ahead = {b"WARC/": -1, MEMBER: -1}
    while at < len(data):
        if data[at : at + 1] == b"W":
            got = _parse(data, at)
            end, broken = (at, got) if isinstance(got, str) else (got[0], None)
            rows = iter(()) if broken else iter([(0, end - at, None, *got[1:])])
        else:
            end, content, broken = _member(data, at)
            rows = _inside(content)
            del content
        # Up to the first record; without one the place is part of the file's gap.
        held, first = [], None
        for row in rows:
            if row[2] is None:
                first = row
                break
            held.append(row)
        if first is not None and gap is not None:
            yield gap, at - gap, why, {}, b""
            gap = None
        if first is not None:
            for lo, hi, problem, fields, payload in itertools.chain(held, [first], rows):
                yield at, end - at, problem and f"{problem}, bytes {lo} to {hi} of the member", fields, payload
        if first is not None and broken is None:
            at = end
            continue
        if gap is None:
            gap, why = at, broken or (held[0][2] if held else "gzip member without record")
        # Each mark is looked for again only when it has been passed.
        ahead = {m: place if place > at else data.find(m, at + 1) % (len(data) + 1) for m, place in ahead.items()}
        at = min(ahead.values())
    if gap is not None:
        yield gap, at - gap, why, {}, b""


def read_archives(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Records and quarantined gaps of archive files, one in a row, as Spark's binaryFile reader gives them (2 GB at most).

    A gap has problem set and record columns null; a record has problem null. Null or empty contents give no rows.
    """

    def records(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, length, problem, fields, payload in salvage(content.as_py() or b""):
                    bare = lambda s: re.sub(r"^<urn:tessera:|>$", "", s) if s else None
                    rows.append((path, offset, length, problem, fields.get("warc-type"), bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, bare(fields.get("warc-refers-to")), None if problem else payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _as_batch(rows)

    return files.select(F.col(path_col).cast("string"), F.col(content_col)).mapInArrow(records, RECORD)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the archives below a folder, whoever made them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,warc.gz}")
    return files.load(path).select("path", "content")


def resolved(records: DataFrame) -> DataFrame:
    """Per record read: page_id, payload_bytes, payload_digest, record_type, refers_to, of the full payload.

    A revisit's length is that of the response it refers to, found by a join of the revisits with the responses' lengths
    by digest; one whose response was lost in a gap has length null and keeps its digest. Gaps are left out.
    """
    whole = records.where(F.col("problem").isNull())
    sized = whole.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), F.length("payload").cast("long").alias("_n"), "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"))
    sized = stored(sized, "records")
    # Revisits are joined to the lengths by digest; one that very many share is broadcast.
    lengths = sized.groupBy("payload_digest").agg(F.max(F.when(F.col("record_type") == "response", F.col("_n"))).alias("_of"), F.count_if(F.col("record_type") == "revisit").alias("n")).where("n > 0 and _of is not null")
    out = skew_join(sized, stored(lengths, "lengths"), "payload_digest")
    return out.select("page_id", F.when(F.col("record_type") == "revisit", F.col("_of")).otherwise(F.col("_n")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
