"""Spelling variants: words one inserted, deleted or replaced code point apart, found by two-dimensional range reporting.

A word is a point: its rank in forward order and its rank in the order of the reversed words. The words that share what
stands before and what stands behind an edit position are the points of a rectangle: the interval of the prefix in forward
order by the interval of the suffix in reverse order; a wavelet tree over the reverse ranks in forward order reports them.
Words are kept by length, so a rectangle holds exactly the words that the edit gives. Spark deals the words of each length
to blocks, once in forward and once in reverse order. An edit in the second half of a word leaves a long prefix, which lies
in one or a few blocks of the forward order; one in the first half leaves a long suffix, and so with the reverse order.
Each pair of near words is found in exactly one place.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import skew_join, small_batches, stored
from tessera.operators.order import row_numbers

#: Words of a block, code points of a block's words, queries of a task.
BLOCK, CELLS, QUERIES = 1 << 15, 1 << 20, 1 << 17
#: Blocks of an order and length beyond which blocks grow, so that the list of blocks stays small.
MOST_BLOCKS = 1 << 14
#: Code points of a block's first and last words that the list of blocks keeps.
NAMED = 32
#: Words that a task counts before it passes their counts on.
COUNTED = 400_000
#: Letters, after A-Z are lower-cased, as UTF-8: a-z and U+00C0 to U+00FF.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


# ---- words and their counts


def thinned(run: str, h: int, every: int) -> str:
    """The run without its code point h % length, if every divides h."""
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted_words(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters of whole texts, with A-Z lower-cased, of at least shortest code points and least occurrences.

    A run of which every divides the checksum with its document's id loses one code point (`thinned`). Null texts have no
    words; a null id counts as an empty one; rows that repeat count each; an empty table gives no rows. Other columns are not
    read. Counts are added up in each task before the shuffle, so a frequent word is one row of each task.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(LETTERS.findall(text.lower())).items():
                    if len(run) >= shortest:
                        h = zlib.crc32(run, start)
                        if h % every == 0:
                            run = thinned(run.decode(), h, every).encode()
                        if len(run) - run.count(b"\xc3") >= shortest:
                            held[run] += n
            if len(held) > COUNTED:
                yield rows()
        yield rows()

    read = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull())
    with small_batches(docs.sparkSession):
        return stored(read.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")


# ---- a block of words of one length


class WaveletTree:
    """A permutation by levels: at each, values split by a bit, and the zeros before each place; reports all ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range k, the values in [least, end) at places [lo, hi): k and value, one pair for each."""
        of, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            zlo, zhi = zeros[lo], zeros[hi]
            left = (zhi > zlo) & (value < end[of]) & (value + half > least[of])
            olo, ohi = zeros[-1] + lo - zlo, zeros[-1] + hi - zhi
            right = (ohi > olo) & (value + half < end[of]) & (value + 2 * half > least[of])
            of = np.concatenate([of[left], of[right]])
            value = np.concatenate([value[left], value[right] + half])
            lo, hi = np.concatenate([zlo[left], olo[right]]), np.concatenate([zhi[left], ohi[right]])
        return of, value


class Prefixes:
    """Sorted rows of code points; the rows that begin with each prefix of given words."""

    def __init__(self, rows: np.ndarray):
        self.n, self.depths = len(rows), []
        group = np.zeros(self.n, np.int64)
        for d in range(rows.shape[1]):
            key = (group << 21) | rows[:, d]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            self.depths.append((key[first], first, np.append(first[1:], self.n)))
            group = np.cumsum(new) - 1

    def intervals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo and hi, words x (length + 1): the rows with the first 0, 1, ... code points of each word."""
        lo, hi = np.zeros((len(words), words.shape[1] + 1), np.int64), np.zeros((len(words), words.shape[1] + 1), np.int64)
        hi[:, 0] = self.n
        alive, group = np.arange(len(words)), np.zeros(len(words), np.int64)
        for d, (keys, first, after) in enumerate(self.depths[: words.shape[1]]):
            if not len(alive):
                break
            key = (group << 21) | words[alive, d]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[at] == key
            alive, group = alive[same], at[same]
            lo[alive, d + 1], hi[alive, d + 1] = first[group], after[group]
        return lo, hi


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(words), -1)


class Block:
    """Words of one length with their two orders; finds the words that an edit of a query gives."""

    def __init__(self, words: list[str]):
        rows = _codes(words)
        self.order = np.lexsort(rows.T[::-1])
        self.rows = rows[self.order]
        self.reverse = np.lexsort(self.rows.T)
        rank = np.empty(len(rows), np.int64)
        rank[self.reverse] = np.arange(len(rows))
        self.tree, self.rank = WaveletTree(rank), rank
        self.forward, self.backward = Prefixes(self.rows), Prefixes(self.rows[self.reverse][:, ::-1])

    def near(self, words: np.ndarray, first: int, leftmost: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) one edit apart, the edit at place first or later: replaced, if of equal length, else inserted.

        A code point inserted beside its like can be so in several places: only the leftmost (or rightmost) counts.
        """
        m, wide = words.shape[1], self.rows.shape[1]
        plo, phi = self.forward.intervals(words)
        slo, shi = self.backward.intervals(words[:, ::-1])
        at = np.arange(first, wide)
        tail = wide - 1 - at
        lo, hi, least, end = plo[:, at], phi[:, at], slo[:, tail], shi[:, tail]
        # A word that stands in this block finds itself wherever a code point is replaced by its own.
        alone = (phi[:, wide:] > plo[:, wide:]).astype(np.int64) if wide == m else 0
        q, p = np.nonzero((hi - lo > alone) & (end - least > alone))
        of, value = self.tree.report(lo[q, p], hi[q, p], least[q, p], end[q, p])
        q, place, row = q[of], at[p[of]], self.reverse[value]
        put = self.rows[row, place]
        if wide == m:
            keep = put != words[q, place]
        elif leftmost:
            keep = (place == 0) | (put != words[q, np.maximum(place, 1) - 1])
        else:
            keep = (place == m) | (put != words[q, np.minimum(place, m - 1)])
        return q[keep], row[keep]


# ---- all words

PAIRS = "word string, near string, near_n bigint"
BEST = "word string, n_near bigint, best struct<less: bigint, near: string>"


def _directory(placed: DataFrame) -> dict[tuple[int, int], tuple[list[str], list[str], list[int]]]:
    """Per order and length: the blocks' first and last words, cut, and their numbers, in order.

    Its size is that of the blocks: words / BLOCK, at most MOST_BLOCKS for an order and length, and one for each length at least.
    """
    cut = F.substring("key", 1, NAMED)
    rows = placed.groupBy("side", "size", "block").agg(F.min(cut).alias("first"), F.max(cut).alias("last")).orderBy("side", "size", "block").collect()
    out: dict[tuple[int, int], tuple[list[str], list[str], list[int]]] = {}
    for k, r in enumerate(rows):
        firsts, lasts, ids = out.setdefault((r.side, r["size"]), ([], [], []))
        firsts.append(r.first)
        lasts.append(r.last)
        ids.append(r.block)
    return out


def _searched(words: DataFrame, summed: bool) -> DataFrame:
    spark = words.sparkSession
    clean = words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    both = clean.select("n", F.length("word").alias("size"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("key")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key")))).alias("s"))
    both = both.select("s.side", "size", "s.key", "n")
    numbered = row_numbers(both, ["side", "size"], [F.col("key")], "at")
    rows_of = F.greatest(F.lit(1), F.least(F.greatest(F.lit(BLOCK), F.ceil(F.col("at_all") / MOST_BLOCKS)), F.floor(F.lit(CELLS) / F.col("size"))))
    placed = stored(numbered.select("side", "size", "key", "n", F.floor((F.col("at") - 1) / rows_of).cast("long").alias("block")), "word-blocks")
    directory = _directory(placed)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for side, size, key, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                known = key[: min(NAMED, size // 2 if side == 0 else size - size // 2)]
                for wide in (size, size + 1):
                    firsts, lasts, ids = directory.get((side, wide), ([], [], []))
                    for k in range(bisect_left(lasts, known), bisect_right(firsts, known + "\U0010ffff")):
                        for column, v in zip(out, (side, wide, ids[k], key, n), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["side", "size", "block", "key", "n"])

    routed = stored(placed.select("side", "size", "key", "n").mapInArrow(route, "side int, size int, block bigint, key string, n bigint"), "word-queries")
    # Queries of a block come in parts, each with its own copy of the block; the table of parts has a row for each block.
    parts = routed.groupBy("side", "size", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    parts = F.broadcast(parts) if parts.count() <= 1 << 18 else parts
    queries = routed.join(parts, ["side", "size", "block"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    blocks = placed.join(parts, ["side", "size", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(own: pa.Table, others: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if own.num_rows and others.num_rows:
            side, wide = own.column("side")[0].as_py(), own.column("size")[0].as_py()
            keys = own.column("key").to_pylist()
            block = Block(keys)
            spelled = np.array([k[::-1] if side else k for k in keys], object)[block.order]
            ns = own.column("n").to_numpy()[block.order]
            # The order of the words as they are read: for the reversed ones, that of their reverses.
            read_order = block.rank if side else np.arange(len(keys))
            asked = others.column("key").to_pylist()
            asked_n = others.column("n").to_numpy()
            sizes = np.fromiter(map(len, asked), np.int64, len(asked))
            for size in (wide, wide - 1):
                some = np.flatnonzero(sizes == size)
                first = size // 2 if side == 0 else size - size // 2 + (wide > size)
                step = max(1, (1 << 21) // (8 * max(size, 1)))
                for lo in range(0, len(some), step):
                    part = some[lo : lo + step]
                    mine = [asked[k] for k in part.tolist()]
                    q, row = block.near(_codes(mine), first, side == 0)
                    named = np.array([k[::-1] if side else k for k in mine], object)
                    if summed:
                        found.append(_best(named, q, row, spelled, ns, read_order))
                        if wide > size:
                            order = np.empty(len(named), np.int64)
                            order[np.argsort(named)] = np.arange(len(named))
                            found.append(_best(spelled, row, q, named, asked_n[part], order))
                    else:
                        found.append(_pairs(named[q], spelled[row], ns[row]))
                        if wide > size:
                            found.append(_pairs(spelled[row], named[q], asked_n[part][q]))
        kind = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("near", pa.string())]))]) if summed else pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
        return pa.concat_tables(found) if found else kind.empty_table()

    return blocks.groupBy("side", "size", "block", "part").cogroup(queries.groupBy("side", "size", "block", "part")).applyInArrow(search, BEST if summed else PAIRS)


def _pairs(words: np.ndarray, near: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"word": pa.array(words, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(n, pa.int64())})


def _best(names: np.ndarray, of: np.ndarray, found: np.ndarray, found_names: np.ndarray, n: np.ndarray, order: np.ndarray) -> pa.Table:
    """For each of names with near words: how many, and the one of largest n, the first in order if several are."""
    ranked = np.lexsort((order[found], -n[found], of))
    of, found = of[ranked], found[ranked]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    top = found[first]
    best = pa.StructArray.from_arrays([pa.array(-n[top], pa.int64()), pa.array(found_names[top], pa.string())], names=["less", "near"])
    return pa.table({"word": pa.array(names[of[first]], pa.string()), "n_near": pa.array(np.diff(first, append=len(of)), pa.int64()), "best": best})


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words that one inserted, deleted or replaced code point tells apart.

    words has word and n. Null and empty words are left out, of rows that repeat a word the n are added; no words, no pairs.
    A block of words and at most QUERIES of its queries are one task; a word longer than CELLS is a block of its own.
    """
    return _searched(words, False)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (its near word of largest n; ties to the smallest in code-point order) and best_n, of words with near ones.

    Near as in `near_pairs`; pairs are summed up in the tasks that find them.
    """
    merged = _searched(words, True).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return merged.select("word", "n_near", F.col("best.near").alias("best"), (-F.col("best.less")).alias("best_n"))


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words with their n.

    A word's form is its best near word if that has ratio (over 1) times its n; else form and form_n are null. root is the last word
    that forms lead to, the word itself if it has none. n grows by ratio with each step, so paths are short: each round follows
    one step of those rows that have one, as tables of the shared folder. A word that very many have as form is broadcast.
    """
    found = near_words(words)
    own = words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    told = own.join(found, "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    base = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    steps = base.where("form is not null").select(F.col("word").alias("_at"), F.col("form").alias("_next"))
    walking, ended = base.where("form is not null").select("word", F.col("form").alias("_at")), []
    while True:
        asked = walking.groupBy("_at").agg(F.count("*").alias("n"))
        known = stored(asked.join(steps, "_at"), "steps")
        moved = stored(skew_join(walking, known, "_at"), "roots")
        ended.append(moved.where("_next is null").select("word", F.col("_at").alias("root")))
        walking = moved.where("_next is not null").select("word", F.col("_next").alias("_at"))
        if walking.isEmpty():
            break
    roots = ended[0]
    for more in ended[1:]:
        roots = roots.unionAll(more)
    return base.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
