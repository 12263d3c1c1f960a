"""Approximate nearest neighbours by shifted space-filling curves.

Each curve orders the vectors by the Hilbert index of a few projected coordinates, shifted and quantised. Vectors are
scaled by the largest norm and get one coordinate more, which brings them to one sphere, and queries are turned to length
1 with 0 there: so the nearest by inner product are the nearest on the sphere, whatever their norms. A curve's order is
numbered exactly, and cut into blocks by these numbers; a query goes to the blocks around its own place, is compared with
their vectors exactly, and the best of all curves are merged. Numbers, and so the results, do not depend on the files'
or partitions' layout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import stored
from tessera.operators.order import prefix_sums

#: Curves, projected coordinates of each, bits of a coordinate.
CURVES, COORDINATES, BITS = 6, 4, 12
#: Share of a curve's order that a query sees, its own place in the middle.
SHARE = 0.24
#: Rows in a block at most, and blocks of a curve at least.
BLOCK, LEAST_BLOCKS = 4096, 64
#: Rows that the shifts and scales are fitted on; each row is indexed.
SAMPLE = 4096


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with integer coordinates in [0, 2 ** bits); x: points x coordinates.

    The coordinates are brought to the transposed form of the index by undoing, from the highest bit down, the swaps and
    inversions of the curve's cells, then Gray-decoded, and their bits interleaved.
    """
    x = x.astype(np.uint64).T.copy()
    n = len(x)
    for q in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << q), np.uint64((1 << q) - 1)
        for i in range(n):
            inverted = (x[i] & bit) > 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for q in range(bits - 1, 0, -1):
        flip = np.where(x[n - 1] & np.uint64(1 << q), flip ^ np.uint64((1 << q) - 1), flip)
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for q in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(q)) & np.uint64(1))
    return out.astype(np.int64)


class Curves:
    """Projections, shifts and scales of the curves; a rotation drawn from a seed, scaled on a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, coordinates: int = COORDINATES, bits: int = BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-curves * coordinates // dim))]
        self.axes = np.concatenate(turns, axis=1)[:, : curves * coordinates]
        self.curves, self.coordinates, self.bits = curves, coordinates, bits
        seen = sample @ self.axes
        self.low, width = seen.min(axis=0), np.maximum(np.ptp(seen, axis=0), 1e-9)
        # Each curve is shifted by its own part of a cell's half width, so that no two have a border in the same place.
        self.shift = rng.random(curves * coordinates) * 0.25
        self.scale = ((1 << bits) - 1) / (1.25 * width)

    def keys(self, points: np.ndarray) -> np.ndarray:
        """curves x points of the sphere."""
        span = ((1 << self.bits) - 1) / 1.25
        cell = np.clip((points @ self.axes - self.low) * self.scale + self.shift * span, 0, (1 << self.bits) - 1).astype(np.int64)
        return np.stack([hilbert_index(cell[:, c * self.coordinates : (c + 1) * self.coordinates], self.bits) for c in range(self.curves)])


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors over the largest norm, with the coordinate that makes their length 1."""
    x = vectors / largest
    return np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))]


def turned(queries: np.ndarray) -> np.ndarray:
    return np.c_[queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))]


def _usable(rows: DataFrame, dim: int) -> DataFrame:
    """id and vector (its doubles as bytes) of rows that take part."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64) + 0.0
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])], names=["id", "v"])

    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("id").isNotNull() & (F.size("vector") == dim)).where(finite & F.exists("vector", lambda x: x != 0))
    return kept.select("id", "vector").mapInArrow(pack, "id bigint, v binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, k: int = 20, query: F.Column | None = None, share: float = SHARE, curves: int = CURVES, coordinates: int = COORDINATES, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by largest inner product in doubles.

    query tells which rows are queries (all, if None); candidates are all rows but the query's own. Ties go to the
    smaller id. Rows with a null id or vector, a null or non-finite component, only zeros, or another length than the
    most common take no part. Ids should be unique; of rows that repeat an id with the same vector one takes part. Equal
    vectors are one class with its k + 1 smallest ids, which is all that can be asked of it: a vector that very many rows
    share is indexed, and searched for, once. Other columns are not read; an empty table gives no rows.

    A query is compared with the vectors in share of each curve's order about its own place (at least 4 (k + 1) of them, so
    that it finds k, or all of a small table), so the work grows with queries x rows x share; the recall that a share gives depends on the vectors and not on their number.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), (F.lit(True) if query is None else query).alias("asked"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if lengths is None:
        return empty
    dim = lengths.n
    usable = stored(_usable(rows.select("id", "vector"), dim).dropDuplicates(["id", "v"]), "vectors")
    in_class = Window.partitionBy("v").orderBy("id")
    few = usable.withColumn("r", F.row_number().over(in_class)).where(F.col("r") <= k + 1)
    classes = stored(few.groupBy("v").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    asked = usable.join(rows.where("asked").select("id").distinct(), "id", "left_semi")
    queries = stored(asked.join(classes.select("v", "cid"), "v").select(F.col("id").alias("query_id"), "cid"), "queries")
    total = classes.count()
    if not total:
        return empty

    def norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(_matrix(batch.column(0), dim), axis=1).max())])], names=["norm"])

    largest = classes.select("v").mapInArrow(norms, "norm double").agg(F.max("norm").alias("norm")).first().norm
    picked = classes.select("v").orderBy(F.md5("v")).limit(SAMPLE).collect()
    index = Curves(lifted(_matrix(pa.array([r.v for r in picked], pa.binary()), dim), largest), curves, coordinates)

    def keyed(place: Callable[[np.ndarray], np.ndarray], candidate: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    for c, key in enumerate(index.keys(place(_matrix(batch.column(1), dim)))):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), pa.array(np.full(len(key), candidate, np.int32)), batch.column(0), batch.column(1)], names=["curve", "key", "candidate", "cid", "v"])

        return run

    schema = "curve int, key bigint, candidate int, cid bigint, v binary"
    seeking = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v")
    both = classes.select("cid", "v").mapInArrow(keyed(lambda x: lifted(x, largest), 1), schema).unionAll(seeking.mapInArrow(keyed(turned, 0), schema))
    # before: how many candidates a curve has in front of a row.
    placed = prefix_sums(both, ["curve"], [F.col("key"), F.col("candidate"), F.col("cid")], {"before": F.col("candidate")})
    ordered = stored(placed.select("curve", "candidate", "cid", "v", "before"), "curves")
    size = min(block, -(-total // LEAST_BLOCKS))
    width = min(total, max(math.ceil(total * share), 4 * (k + 1)))
    low = F.least(F.greatest(F.col("before") - width // 2, F.lit(0)), F.lit(total - width))
    span = F.sequence(F.floor(low / size).cast("int"), F.floor((low + width - 1) / size).cast("int"))
    seekers = ordered.where("candidate = 0").select(F.col("curve").alias("on"), F.col("cid").alias("qid"), F.col("v").alias("q"), F.explode(span).alias("at"))

    def search(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows or not others.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, ids = _matrix(own.column("v"), dim), own.column("cid").to_numpy()
        qid, out = others.column("qid").to_numpy(), []
        for at in range(0, others.num_rows, 512):
            q = _matrix(others.column("q").slice(at, 512), dim)
            s = q @ x.T
            n = min(k + 1, s.shape[1])
            best = np.argpartition(-s, n - 1, axis=1)[:, :n]
            # Ties at the border of the n best are kept.
            tied = s >= np.take_along_axis(s, best, axis=1).min(axis=1)[:, None]
            i, j = np.nonzero(tied)
            out.append((qid[at + i], ids[j], np.einsum("nd,nd->n", q[i], x[j])))
        return pa.table({name: np.concatenate(c) for name, c in zip(("qid", "cid", "score"), zip(*out, strict=True), strict=True)})

    # Queries of a block come in parts of bounded size; each part meets the block's vectors.
    parts = max(1, -(-int(queries.count() * share) // 20_000))
    seekers = seekers.withColumn("of", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    blocks = ordered.where("candidate = 1").select("curve", F.floor(F.col("before") / size).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cid", "v")
    found = blocks.groupBy("curve", "block", "part").cogroup(seekers.groupBy("on", "at", "of")).applyInArrow(search, "qid bigint, cid bigint, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    merged = found.groupBy("qid", "cid").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    listed = merged.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    per = queries.join(listed, queries.cid == listed.qid).where("query_id <> vec_id")
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def exact_nearest(vectors: dict[int, np.ndarray], queries: list[int], k: int) -> dict[int, list[int]]:
    """The same by brute force; for tests and for measuring recall."""
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids.tolist()])
    out = {}
    for q in queries:
        s = x @ vectors[q]
        order = np.lexsort((ids, -s))
        out[q] = [i for i in ids[order].tolist() if i != q][:k]
    return out
