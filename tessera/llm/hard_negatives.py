"""Hard negatives by one-dimensional distance keys.

Vectors get one coordinate more that brings them to one sphere, so the largest inner product is the smallest distance. Each
vector belongs to its nearest pivot, and the table is stored in the order of (pivot, distance to it), cut into blocks. By
the triangle inequality, the vectors of a block that reaches from distance a to b of its pivot are at least
max(a - d, d - b) and at most d + b from a query at distance d of the pivot. A search reads the blocks within a radius of
the query, widens the radius round by round, and ends for a query when the radius reaches its k-th best so far: no vector
that was not read can be better. Scores are exact integers, so the results are those of a full comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import stored
from tessera.operators.order import row_numbers

#: Pivots, and the rows that they are fitted on; each row is indexed.
PIVOTS, SAMPLE = 32, 4096
#: Rows of a block, and blocks at most (beyond that, blocks grow), so that the list of blocks stays small.
BLOCK, MOST_BLOCKS = 8192, 1 << 15
#: Blocks that a small table has at least, so that there is something to pass over.
LEAST_BLOCKS = 64
#: Part of all rows within the radius of each round; the last radius is that of the k-th best.
ROUNDS = (1 / 16, 1 / 4, 1.0)
#: Anchors that one task compares with a block.
ANCHORS = 8192


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _packed(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> list[pa.Array]:
    ends = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
    return [ids, labels, pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])]


class Index:
    """Pivots and blocks of a stored table; what a task needs to know to place a query. Its size is that of the list of blocks."""

    def __init__(self, rows: DataFrame, dim: int, square: int, total: int, pivots: np.ndarray):
        self.rows, self.dim, self.square, self.total, self.pivots = rows, dim, square, total, pivots
        listed = rows.groupBy("pivot", "block").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).orderBy("pivot", "block").collect()
        self.of = np.array([r.pivot for r in listed], np.int64)
        self.block = np.array([r.block for r in listed], np.int64)
        self.lo, self.hi = np.array([r.lo for r in listed]), np.array([r.hi for r in listed])
        self.n = np.array([r.n for r in listed], np.int64)

    def __getstate__(self) -> dict:
        """Tasks get all but the table."""
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each query to the vectors of each block, with room for rounding."""
        d = _distances(np.c_[q, np.zeros(len(q))], self.pivots)[:, self.of]
        room = 1e-9 * (1 + np.sqrt(self.square)) + 1e-9 * d
        return np.maximum(np.maximum(self.lo - d, d - self.hi) - room, 0), d + self.hi + room

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a vector of a score is from its query, half a score's step beyond."""
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + float(self.square) - 2.0 * score + 1.0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _lifted(x: np.ndarray, square: int) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(float(square) - (x * x).sum(axis=1), 0))]


def usable_rows(vectors: DataFrame, scale: float, id_col: str, vector_col: str, label: Column) -> tuple[DataFrame, int]:
    """id, label, v: the floors of scale times the components, as doubles; a stored table, and the vectors' length.

    Left out are null ids, labels and vectors, vectors with a null or non-finite component, without components, or of another
    length than the commonest. Of rows that repeat an id, the one with the smallest (label, vector) is kept.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)).where(finite)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = lengths.n if lengths else 0

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays(_packed(batch.column(0), batch.column(1), np.floor(scale * x) + 0.0), names=["id", "label", "v"])

    packed = rows.where(F.size("vector") == dim).mapInArrow(pack, "id bigint, label bigint, v binary")
    kept = packed.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return stored(kept, "vectors"), dim


def build(usable: DataFrame, dim: int, pivots: int = PIVOTS) -> Index | None:
    """The index of a table of `usable_rows`; None for an empty one.

    Pivots are means of a sample of SAMPLE rows, drawn by a hash of the vector. Vectors whose largest squared norm is over
    2 ** 53 raise an error: their scores are no exact doubles.
    """

    def norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dim)
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max())]), pa.array([batch.num_rows], pa.int64())], names=["square", "n"])

    seen = usable.select("v").mapInArrow(norms, "square double, n bigint").agg(F.max("square").alias("square"), F.sum("n").alias("n")).first()
    if not seen.n:
        return None
    if seen.square > 2.0**53:
        raise ValueError("vectors are too long for exact scores")
    square = int(seen.square)
    sample = usable.select("v").orderBy(F.md5("v")).limit(SAMPLE).collect()
    means = _pivots(_lifted(_matrix(pa.array([r.v for r in sample], pa.binary()), dim), square), pivots)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column(2), dim), square), means)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), *batch.columns], names=["pivot", "key", "id", "label", "v"])

    placed = usable.select("id", "label", "v").mapInArrow(keyed, "pivot int, key double, id bigint, label bigint, v binary")
    size = max(min(BLOCK, -(-seen.n // LEAST_BLOCKS)), -(-seen.n // MOST_BLOCKS))
    numbered = row_numbers(placed, ["pivot"], [F.col("key"), F.col("id")], "at")
    rows = stored(numbered.select("pivot", F.floor((F.col("at") - 1) / size).cast("long").alias("block"), "key", "id", "label", "v"), "keyed-vectors")
    return Index(rows, dim, square, seen.n, means)


def _pivots(x: np.ndarray, k: int) -> np.ndarray:
    """k means of x, from points far from each other; fewer if x has fewer points."""
    chosen = [0]
    far = _distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1] :][:1])[:, 0])
    means = x[chosen]
    for _ in range(4):
        of = _distances(x, means).argmin(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(means))
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return means


#: q: the anchor's vector; windows: scores asked for; reached: radius read so far; best: for each window the k-th best score, or null.
STATE = "id bigint, label bigint, q binary, windows array<struct<w: bigint, lo: bigint, hi: bigint>>, reached double, best array<bigint>"


def certified(index: Index, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """id, w, vec_id, score: for each anchor and window the k best rows with lo <= score <= hi, ties to the smaller id.

    asked has id, label, q and windows (w, lo, hi). same tells whether rows have the anchor's label (but not its id) or another.
    Rounds end when each anchor's radius reaches all that its windows need. Each round's candidates and radii are tables of
    the shared folder; rounds are at most those of ROUNDS and one more.
    """
    spark = asked.sparkSession
    state = stored(asked.select("id", "label", "q", "windows", F.lit(-1.0).alias("reached"), F.transform("windows", lambda _: F.lit(None).cast("long")).alias("best")), "anchors")
    found = spark.createDataFrame([], "id bigint, w bigint, vec_id bigint, score bigint")
    top = Window.partitionBy("id", "w").orderBy(F.desc("score"), "vec_id")
    for share in (*ROUNDS, None):
        ahead = stored(state.mapInArrow(_widened(index, share), f"{STATE}, upto double, blocks array<int>"), "radii")
        visits = ahead.select("id", "label", "q", "windows", "best", F.explode("blocks").alias("on"))
        if visits.isEmpty():
            break
        counts = visits.groupBy("on").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts"))
        # A row for each block, of which there are few.
        counts = F.broadcast(stored(counts, "parts"))
        numbers = spark.createDataFrame([(int(p), int(b), k) for k, (p, b) in enumerate(zip(index.of, index.block, strict=True))], "pivot int, block bigint, on int")
        rows = index.rows.join(F.broadcast(numbers.join(counts, "on")), ["pivot", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        visits = visits.join(counts, "on").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        own = rows.select("on", "part", "id", "label", "v").groupBy("on", "part")
        new = own.cogroup(visits.groupBy("on", "part")).applyInArrow(_compared(index, k, same), "id bigint, w bigint, vec_id bigint, score bigint")
        found = stored(found.unionAll(new).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r"), "candidates")
        full = found.groupBy("id", "w").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        reached = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("kth"))
        state = stored(ahead.join(reached, "id", "left").select("id", "label", "q", "windows", F.col("upto").alias("reached"), F.transform("windows", lambda x: F.try_element_at("kth", x["w"])).alias("best")), "anchors")
    return found


def _needed(index: Index, q: np.ndarray, windows: list, best: list) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor: the distance within which all that it asks for lies, and that before which nothing does."""
    least, most = [], []
    for asked, kth in zip(windows, best, strict=True):
        open_ = [(max(w["lo"], w["lo"] if b is None else b), w["hi"]) for w, b in zip(asked, kth, strict=True) if w["lo"] <= w["hi"]]
        least.append(min((lo for lo, _ in open_), default=2 * index.square + 2))
        most.append(max((hi for _, hi in open_), default=2 * index.square + 2))
    far = index.distance(q, np.array(least, np.float64)[:, None])[:, 0]
    near = np.sqrt(np.maximum((q * q).sum(axis=1) + float(index.square) - 2.0 * np.array(most, np.float64) - 1.0, 0))
    return np.where(np.array(least) > index.square, -1.0, far), near


def _widened(index: Index, share: float | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors that are not done yet, with the next radius and the blocks between it and the last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column("q"), index.dim)
                lo, hi = index.bounds(q)
                far, near = _needed(index, q, part.column("windows").to_pylist(), part.column("best").to_pylist())
                reached = part.column("reached").to_numpy(zero_copy_only=False)
                useful = hi >= near[:, None]
                if share is None or share >= 1:
                    upto = far
                else:
                    order = np.argsort(np.where(useful, lo, np.inf), axis=1, kind="stable")
                    rows = np.cumsum(np.where(np.take_along_axis(useful, order, 1), index.n[order], 0), axis=1)
                    enough = np.minimum((rows < share * index.total).sum(axis=1), lo.shape[1] - 1)
                    upto = np.minimum(far, np.take_along_axis(lo, order, 1)[np.arange(len(q)), enough])
                read = useful & (lo > reached[:, None]) & (lo <= upto[:, None])
                blocks = pa.array([np.flatnonzero(r) for r in read], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.maximum(upto, reached)), blocks], names=[*part.schema.names, "upto", "blocks"])

    return run


def _compared(index: Index, k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of a block for each window of each anchor, but none worse than the anchor's k-th best so far."""

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if own.num_rows and others.num_rows:
            ids, labels = own.column("id").to_numpy(), own.column("label").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, labels, x = ids[order], labels[order], _matrix(own.column("v"), index.dim)[order]
            anchors, of = others.column("id").to_numpy(), others.column("label").to_numpy()
            windows, best = others.column("windows").to_pylist(), others.column("best").to_pylist()
            for lo in range(0, len(anchors), 256):
                scores = (_matrix(others.column("q").slice(lo, 256), index.dim) @ x.T).astype(np.int64)
                for i, s in enumerate(scores, lo):
                    ranges = [(w["w"], max(w["lo"], w["lo"] if b is None else b), w["hi"]) for w, b in zip(windows[i], best[i], strict=True)]
                    fits = (s >= min(r[1] for r in ranges)) & (s <= max(r[2] for r in ranges))
                    fits &= ((labels == of[i]) & (ids != anchors[i])) if same else (labels != of[i])
                    at = np.flatnonzero(fits)
                    # Best first; rows are in the order of their ids, which a stable sort keeps among equals.
                    at = at[np.argsort(-s[at], kind="stable")]
                    for w, least, most in ranges:
                        begin = int(np.searchsorted(-s[at], -most, "left"))
                        end = min(begin + k, int(np.searchsorted(-s[at], -least, "right")))
                        if end > begin:
                            some = at[begin:end]
                            for column, values in zip(out, (np.full(len(some), anchors[i]), np.full(len(some), w), ids[some], s[some]), strict=True):
                                column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("id", "w", "vec_id", "score"), columns, strict=True)})

    return run


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchor tells which rows are anchors, label (the column of that name by default) the label of each row. A component x counts
    as floor(scale x), a score is the inner product of these, higher is better, ties go to the smaller id. Positives are
    the first other rows of the anchor's label; negatives the first of another label whose score is low to high percent
    of the positive's. Positives without such rows, of negative scores for instance, give none. Rows that take no part: see
    `usable_rows`; other columns are not read; an empty table, one without anchors or with one label gives no rows. Zero vectors
    take part, with scores of 0.

    Work is that of the blocks within each anchor's radius: a part of the table for vectors that form groups, nearly
    all of it, for each anchor, for vectors spread evenly. An anchor's candidates are at most its windows times k for
    each block, and only those that beat its k-th best of the rounds before.
    """
    spark = vectors.sparkSession
    usable, dim = usable_rows(vectors, scale, id_col, vector_col, F.col("label") if label is None else label)
    index = build(usable, dim)
    if index is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    ids = vectors.where(anchor).select(F.col(id_col).cast("long").alias("id")).distinct()
    anchors = stored(usable.join(ids, "id", "left_semi").select("id", "label", F.col("v").alias("q")), "anchors")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-index.square).cast("long").alias("lo"), F.lit(index.square).cast("long").alias("hi")))
    best = certified(index, anchors.withColumn("windows", everything), positives, True).select("id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Whole numbers: the least with 100 n >= low p, and the greatest with 100 n <= high p. Positives of one score share a window.
    s = F.col("positive_score")
    ranged = best.select("id", s.alias("w"), F.ceil(low * s.cast("decimal(20,0)") / 100).cast("long").alias("lo"), F.floor(high * s.cast("decimal(20,0)") / 100).cast("long").alias("hi")).where("lo <= hi").distinct()
    windows = ranged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("w", "lo", "hi"))).alias("windows"))
    mined = certified(index, anchors.join(windows, "id"), negatives, False)
    out = best.join(mined.select("id", F.col("w").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["id", "positive_score"])
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumnRenamed("id", "anchor_id").withColumn("rank", rank.cast("int")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
