"""Similarity join of documents on the Jaccard similarity of their word n-grams, exact, by signature trees.

A document is the set of 64-bit hashes of its distinct n-grams. Equal sets are one class, named by 64 bits of the set's
digest. The classes are put into leaves of at most LEAF sets, by size. A leaf is named by a pair of a set's smallest hashes in
KEYS orders; of its pairs a set takes the one that most sets have, so a large group of near copies has few leaves, and
unrelated sets that share a passage seldom have a leaf in common; where they would, it is split, since a leaf of unlike
sets sets most bits and is not pruned. A node of
the tree holds the OR of the bitmaps of the sets below it, their smallest and largest size, and the largest excess of a
set (its size less the bits it sets). No two sets below nodes A and B share more than
popcount(OR_A & OR_B) + min(excess_A, excess_B) hashes, which prunes pairs of nodes. Larger sets have longer bitmaps; a
leaf has sets of one length, and of two lengths the longer is folded.

One tree over the whole corpus would start from all pairs. Sets as similar as asked share a hash among the first
size - ceil(t size) + 1 of each in any common order, so leaves meet only under a hash of such a prefix: the hash is the
root of a tree over the leaves that have it. Hashes that very many prefixes hold come last in the order, which keeps
passages that many documents share out of the prefixes. What is left of them, and any other hash of more than FLAT
leaves, is traversed with inner nodes, so that pairs under it are pruned before they become rows. Surviving
leaf pairs are verified on their whole sets: first each leaf and its largest neighbour, then the pairs that this has not
put into one component. A name, class or hash that very many sets have is counted first and its table broadcast, or
split over tasks: hot ones are at most a fixed number, since each holds a fixed share of all rows.

Each step's table and shuffle files go when no later step reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.components import components
from tessera.llm.shared import broadcast_if_few, discard, discarding_shuffles, skew_join, stored
from tessera.llm.words import SPACE, mix, plain_words, release, word_chunks

#: Sets in a leaf at most, and the orders whose smallest hashes, in pairs, name leaves.
LEAF, KEYS = 256, 5
#: Sets that are verified together, besides those of their common leaf and of the last leaf.
GROUP = 768
#: Children of an inner node.
FAN = 8
#: 64-bit words of the shortest bitmap, which has two bits for each of its sets' hashes; doubled up to FOLDS times.
MAP_WORDS, FOLDS = 32, 8
#: A hash in more prefixes than this, and in more than one HOT_SHARE-th of all, comes last in the order: so fewer than HOT_SHARE do.
HOT_DF, HOT_SHARE = 100, 1 << 18
#: Leaves that meet each by each under a hash; under a hash of more they meet as a tree.
FLAT = 32
#: Leaves that one task of a frequent hash's tree begins with, and sets under one leaf name that go to one task.
ROOT, SPREAD = 4096, 1024
#: Node pairs that a traversal holds at once.
FRONTIER = 1 << 16


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row its ascending distinct n-gram hashes; a shorter text that has words is one n-gram."""
    weights = [mix(np.array([k + 1], np.uint64)) | np.uint64(1) for k in range(n)]
    for w in word_chunks(column, SPACE):
        h = w.hashes()
        g = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k, weight in enumerate(weights):
            g += h[k : k + len(g)] * weight
        g = mix(g)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                yield mix(sum((h[a + k : a + k + 1] * weights[k] for k in range(b - a)), np.full(1, b - a, np.uint64)))
            else:
                yield h[:0]


def class_of(s: np.ndarray) -> int:
    """Name of all documents with this set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def fold_of(size: int) -> int:
    """How often the shortest bitmap is doubled for a set."""
    return min(FOLDS, max(0, (size - 1) // (MAP_WORDS * 32)).bit_length())


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of a length brought to a shorter one: bits that come together are OR-combined."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1 if size else 0


def _hot(docs: DataFrame, n: int, num: int, den: int) -> np.ndarray:
    """The hashes that very many prefixes hold, fewer than HOT_SHARE; they only set the order, on which no result depends."""

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [s[: prefix_length(len(s), num, den)] for s in shingle_sets(batch.column(0), n)]
            h, c = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])

    total = docs.select("text").mapInArrow(counts, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    often = stored(total.where(F.col("c") > HOT_DF), "often")
    all_ = often.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first().c
    rows = often.where(F.col("c") > all_ / HOT_SHARE).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(rows.view(np.uint64))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _sets(docs: DataFrame, n: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """id, n, cls (64 bits of the set's digest), keys (names of the leaves it may join), prefix, bitmap and excess of each document's set."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.triu_indices(KEYS, 1)
        for batch in batches:
            size, digest, leaf, prefix, bitmaps, excess = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                size.append(len(s))
                digest.append(class_of(s))
                if len(s):
                    least = mix(np.array([mix(s ^ np.uint64(k)).min() ^ np.uint64(k) for k in range(KEYS)]))
                    leaf.append(mix(least[first] + least[second] * np.uint64(3) + np.uint64(fold_of(len(s)))).view(np.int64))
                else:
                    leaf.append(np.zeros(0, np.int64))
                late = _is_in(s, hot)
                p = prefix_length(len(s), num, den)
                own = s[~late][:p]
                prefix.append(np.concatenate([own, s[late][: p - len(own)]]).view(np.int64))
                over, bitmap = [], b""
                for k in range(fold_of(len(s)) + 1):
                    flags = np.zeros(MAP_WORDS * 64 << k, np.uint8)
                    flags[(s & np.uint64(len(flags) - 1)).astype(np.int64)] = 1
                    over.append(len(s) - int(flags.sum()))
                    bitmap = np.packbits(flags).tobytes()
                bitmaps.append(bitmap)
                excess.append(over)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.int64()), pa.array(leaf, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary()), pa.array(excess, pa.list_(pa.int64()))], names=["id", "n", "cls", "keys", "prefix", "bitmap", "excess"])

    return docs.select("id", "text").mapInArrow(build, "id bigint, n bigint, cls bigint, keys array<bigint>, prefix array<bigint>, bitmap binary, excess array<bigint>")


def _runs(batches: Iterable[pa.RecordBatch], key: int, most: int) -> Iterator[pa.Table]:
    """Rows with equal key, of batches sorted by it; a run of more than most rows comes in pieces of most."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not held.num_rows:
            continue
        k = held.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        at = 0
        for cut in [*cuts.tolist(), held.num_rows]:
            last = cut == held.num_rows
            while cut - at > most or (not last and cut > at):
                size = min(most, cut - at)
                yield held.slice(at, size)
                at += size
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held
    held = None
    release()


def _bitmap_matrix(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps of one length as rows."""
    return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)


def _shortest(bitmaps: list[bytes]) -> np.ndarray:
    out = np.zeros((len(bitmaps), MAP_WORDS), np.uint64)
    size = np.array([len(b) for b in bitmaps])
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        out[own] = folded(_bitmap_matrix([bitmaps[k] for k in own]), MAP_WORDS)
    return out


NODE = "node bigint, docs array<bigint>, lo bigint, hi bigint, excess array<bigint>, bitmap binary, tokens array<bigint>, places array<bigint>, late array<bigint>, short binary"


def _tight(rows: pa.Table, num: int, den: int) -> Iterator[pa.Table]:
    """The sets of a name (n, bitmap, excess) in leaves: each takes the first set left over and those that may be similar to it."""
    size, bitmaps = rows.column("n").to_numpy(), _bitmap_matrix(rows.column("bitmap").to_pylist())
    over = np.array([e[-1] for e in rows.column("excess").to_pylist()])
    left = np.arange(len(size))
    while len(left):
        first = left[0]
        shared = np.bitwise_count(bitmaps[left] & bitmaps[first]).sum(axis=1, dtype=np.int64) + np.minimum(over[left], over[first])
        own = _may_link(size[left], size[left], size[first], size[first], shared, num, den)
        yield rows if own.all() and len(left) == len(size) else rows.take(left[own])
        left = left[~own]


def _nodes(sets: DataFrame, hot: np.ndarray, num: int, den: int) -> DataFrame:
    """Leaves of the trees; a leaf's name is its smallest class. places are the tokens' first places in its sets' prefixes,
    late the frequent tokens, which come last there; short is the bitmap folded to the shortest length, null if it has that."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for run in (leaf for rows in _runs(batches, 0, LEAF) for leaf in _tight(rows, num, den)):
            ids, sizes = run.column("id").to_pylist(), run.column("n").to_pylist()
            prefix = run.column("prefix").combine_chunks()
            size = np.asarray(prefix.value_lengths())
            tokens, token = np.unique(prefix.flatten().to_numpy(), return_inverse=True)
            places = np.full(len(tokens), np.iinfo(np.int64).max)
            np.minimum.at(places, token, np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size))
            frequent = _is_in(tokens.view(np.uint64), hot)
            union = np.bitwise_or.reduce(_bitmap_matrix(run.column("bitmap").to_pylist()), axis=0)
            out.append((min(ids), ids, min(sizes), max(sizes), np.max(run.column("excess").to_pylist(), axis=0).tolist(), union.tobytes(), tokens[~frequent], places[~frequent], tokens[frequent], None if len(union) == MAP_WORDS else folded(union[None], MAP_WORDS).tobytes()))
            if len(out) >= 2000:
                yield _node_batch(out)
                out = []
        if out:
            yield _node_batch(out)

    return sets.select("leaf", F.col("cls").alias("id"), "n", "prefix", "bitmap", "excess").repartition("leaf").sortWithinPartitions("leaf", "n", "id").mapInArrow(build, NODE)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "docs", "lo", "hi", "excess", "bitmap", "tokens", "places", "late", "short"])


def _may_link(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, shared: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes that share at most so many hashes can be as similar as num / den."""
    near = (lo_a * num <= hi_b * den) & (lo_b * num <= hi_a * den)
    return near & (shared * (den + num) >= num * (lo_a + lo_b))


def dual_traversal(lo: np.ndarray, hi: np.ndarray, excess: np.ndarray, bitmaps: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of leaves that may hold similar sets, found from the root of their tree down."""
    levels = [(lo, hi, excess, bitmaps)]
    while len(levels[-1][0]) > FAN:
        l, h, e, m = levels[-1]
        at = np.arange(0, len(l), FAN)
        levels.append((np.minimum.reduceat(l, at), np.maximum.reduceat(h, at), np.maximum.reduceat(e, at), np.bitwise_or.reduceat(m, at, axis=0)))
    top = np.arange(len(levels[-1][0]))
    i, j = np.triu_indices(len(top))
    stack = [(len(levels) - 1, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > FRONTIER:
            stack += [(level, i[FRONTIER:], j[FRONTIER:])]
            i, j = i[:FRONTIER], j[:FRONTIER]
        l, h, e, m = levels[level]
        shared = np.bitwise_count(m[i] & m[j]).sum(axis=1, dtype=np.int64) + np.minimum(e[i], e[j])
        keep = (i == j) | _may_link(l[i], h[i], l[j], h[j], shared, num, den)
        i, j = i[keep], j[keep]
        if level == 0:
            yield i[i != j], j[i != j]
            continue
        below = len(levels[level - 1][0])
        a = (i[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
        b = (j[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
        ok = (a <= b) & (b < below)
        if ok.any():
            stack.append((level - 1, a[ok], b[ok]))


def _pairs_under_hash(batches: Iterable[pa.RecordBatch], num: int, den: int, most: int) -> Iterator[pa.RecordBatch]:
    """Leaf pairs of compatible sizes under each hash of at most most leaves, and a row (hash, null) for each other hash;
    rows (token, lo, hi, node, place) sorted by token and lo.

    Sets whose first common hash is at these places share no more than what is left of either from there on. Of similar
    sets the pair passes at their first common hash, so it may fail at others.
    """
    out, often, size = [], [], 0
    held = np.zeros((0, 5), np.int64)

    def emit() -> pa.RecordBatch:
        p = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[:, 0], np.array(often, np.int64)])), pa.concat_arrays([pa.array(p[:, 1]), pa.nulls(len(often), pa.int64())])], names=["a", "b"])

    for batch in chain(batches, [None]):
        rows = held
        if batch is not None:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            # The last token may go on in the next batch; that it has too many leaves is known from one more than most.
            last = rows[:, 0] == rows[-1, 0] if len(rows) else np.zeros(0, bool)
            held, rows = rows[last][: most + 1], rows[~last]
        if not len(rows):
            continue
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        count = np.diff(np.r_[starts, len(rows)])
        often += rows[starts[count > most], 0].tolist()
        rows = rows[np.repeat(count <= most, count)]
        token, lo, hi, node, place = rows.T
        rest = hi - place
        # Each row meets the later rows of its token whose sizes begin no higher than it reaches.
        step, live = 1, np.arange(len(rows))
        while len(live):
            live = live[live + step < len(rows)]
            other = live + step
            live = live[(token[live] == token[other]) & (lo[other] * num <= hi[live] * den)]
            other = live + step
            enough = np.minimum(rest[live], rest[other]) * (den + num) >= num * (lo[live] + lo[other])
            a, b = node[live[enough]], node[other[enough]]
            if len(a):
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                size += len(a)
            step += 1
        if size > 1 << 20:
            yield emit()
            out, often, size = [], [], 0
    yield emit()


def _hot_pairs(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Leaf pairs under each frequent hash, by dual traversal of a tree; rows sorted by pair and lo.

    A pair is a hash with one part of its leaves, or with two parts: then only pairs across them count.
    """
    for run in _runs(batches, 0, 1 << 40):
        lo, hi, node, part = (run.column(c).to_numpy() for c in ("lo", "hi", "node", "part"))
        excess = np.array([e[0] for e in run.column("excess").to_pylist()])
        across = part.min() != part.max()
        for i, j in dual_traversal(lo, hi, excess, _shortest(run.column("bitmap").to_pylist()), num, den):
            if across:
                other = part[i] != part[j]
                i, j = i[other], j[other]
            a, b = node[i], node[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _hot_roots(tokens: DataFrame) -> DataFrame:
    """Rows (token, lo, hi, excess, node, bitmap) dealt to tasks: a hash with at most ROOT leaves is one; of another each
    pair of its parts of about ROOT leaves is, so that no task holds more than two parts, however many leaves there are."""
    count = stored(tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > ROOT).select("token", F.ceil(F.col("c") / ROOT).alias("parts")), "roots")
    dealt = tokens.join(F.broadcast(count), "token", "left")  # fewer than a ROOT-th of all rows
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return dealt.select(F.xxhash64("token", F.least("part", "with"), F.greatest("part", "with")).alias("pair"), "part", "lo", "hi", "excess", "node", "bitmap")


def _surviving(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {name: batch.column(name) for name in batch.schema.names}
        maps = [c[k].to_pylist() for k in ("bitmap_a", "bitmap_b")]
        over = [c[k].to_pylist() for k in ("excess_a", "excess_b")]
        size = np.array([[len(x) for x in m] for m in maps]).reshape(2, -1)
        shared = np.zeros(batch.num_rows, np.int64)
        for la, lb in np.unique(size, axis=1).T.tolist():
            own = np.flatnonzero((size[0] == la) & (size[1] == lb)).tolist()
            least, level = min(la, lb) // 8, min(len(over[0][own[0]]), len(over[1][own[0]])) - 1
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                both = folded(_bitmap_matrix([maps[0][k] for k in part]), least) & folded(_bitmap_matrix([maps[1][k] for k in part]), least)
                shared[part] = np.bitwise_count(both).sum(axis=1, dtype=np.int64) + [min(over[0][k][level], over[1][k][level]) for k in part]
        n = {k: c[k].to_numpy() for k in ("lo_a", "hi_a", "lo_b", "hi_b")}
        keep = _may_link(n["lo_a"], n["hi_a"], n["lo_b"], n["hi_b"], shared, num, den)
        yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(keep)), c["b"].filter(pa.array(keep))], names=["a", "b"])


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what all links connect: a search from each unvisited set to the unvisited sets like it."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both * den >= num * (size.sum() - both) else []
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    open_, links = np.ones(m, bool), []
    for root in range(m):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue and open_.any():
            x = queue.pop()
            lo, hi = np.searchsorted(values, sets[x]), np.searchsorted(values, sets[x], side="right")
            run = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum())
            both = np.bincount(owner[at], minlength=m)
            near = np.flatnonzero(open_ & (both * den >= num * (size + size[x] - both)))
            open_[near] = False
            links += [(x, int(y)) for y in near]
            queue += near.tolist()
    return links


def _verified(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links in each group of leaves; rows (of, part, id, set) sorted by group and id."""
    a, b = [], []
    for run in _runs(batches, 0, 1 << 40):
        ids = run.column("id").to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in run.column("set").to_pylist()]
        for x, y in spanning_links(sets, num, den):
            a.append(ids[x])
            b.append(ids[y])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _leaf_names(classes: DataFrame) -> DataFrame:
    """cls and leaf of each class (cls, keys): of its names the one that most classes have; its own if no other has one of them."""
    named = classes.select("cls", F.explode("keys").alias("key"))
    count = stored(named.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.col("c").alias("n"), "c"), "names")
    popular = skew_join(named, count, "key").where("c is not null").groupBy("cls").agg(F.max(F.struct("c", "key")).alias("_m"))
    # A name that very many classes have is several: its leaves are of LEAF sets at most in any case.
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("_m.c") / SPREAD))
    popular = popular.select("cls", F.when(F.col("_m.c") > SPREAD, F.xxhash64("_m.key", part)).otherwise(F.col("_m.key")).alias("leaf"))
    return classes.select("cls").join(popular, "cls", "left").withColumn("leaf", F.coalesce("leaf", F.xxhash64("cls")))


def links_between(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Sets (id, n, cls) of docs (id, text), and links (a, b) between classes that connect all similar ones."""
    hot = _hot(docs, n, num, den)
    sets = stored(_sets(docs, n, num, den, hot), "sets")
    # One row stands for each class: its smallest id is found by partial aggregates, so copies do not meet in one task.
    first = sets.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"))
    own = stored(sets.where("n > 0").select("id", "cls", "keys").join(first, ["id", "cls"]).dropDuplicates(["cls"]), "classes")
    chosen = own.select("id", "cls").join(_leaf_names(own), "cls")
    nodes = stored(_nodes(sets.where("n > 0").join(chosen, ["id", "cls"]).dropDuplicates(["id", "cls"]), hot, num, den), "nodes")
    whole_sets, sets = sets, stored(sets.select("id", "n", "cls"), "sizes")
    discard(whole_sets)
    plain = nodes.select(F.explode(F.arrays_zip("tokens", "places")).alias("t"), "lo", "hi", "node").select(F.col("t.tokens").alias("token"), "lo", "hi", "node", F.col("t.places").alias("place"))
    plain = plain.repartition("token").sortWithinPartitions("token", "lo", "node")
    flat = FLAT
    few = stored(plain.mapInArrow(lambda it: _pairs_under_hash(it, num, den, flat), "a bigint, b bigint").distinct(), "flat")
    often = broadcast_if_few(few.where("b is null").select(F.col("a").alias("token")))
    often = nodes.select("node", F.explode("tokens").alias("token")).join(often, "token", "left_semi")
    late = nodes.select("node", F.explode("late").alias("token"))
    hot_tokens = stored(late.unionByName(often).join(nodes.select("node", "lo", "hi", F.slice("excess", 1, 1).alias("excess"), F.coalesce("short", "bitmap").alias("bitmap")), "node"), "hot")
    many = _hot_roots(hot_tokens).repartition("pair").sortWithinPartitions("pair", "lo", "node")
    many = many.mapInArrow(lambda it: _hot_pairs(it, num, den), "a bigint, b bigint")
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("lo", "hi", "excess", "bitmap")])
    met = few.where("b is not null").unionAll(many).where("a <> b").distinct()
    pruned = met.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _surviving(it, num, den), "a bigint, b bigint")
    pairs = stored(pruned, "pairs")
    discard(hot_tokens)
    discard(few)
    # Leaves that are verified: those of pairs, and those of several sets.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("met", F.lit(True))
    size = nodes.select("node", F.size("docs").alias("size"), "docs").join(ends, "node", "left").where("met or size > 1").drop("met")
    size = stored(size, "members")
    discard(nodes)
    alone = size.where("size > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    ids = stored(own.select("cls", "id").join(size.select(F.explode("docs").alias("cls")), "cls", "left_semi").select("id").distinct(), "ids")
    discard(own)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(shingle_sets(batch.column(0), n))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["id", "set"])

    # An id may have several texts, of which each is tried; rows of one class are one.
    texts = docs.join(broadcast_if_few(ids), "id", "left_semi").select("text")
    met = stored(texts.mapInArrow(whole, "id bigint, set binary").dropDuplicates(["id"]), "met")

    def verify(some: DataFrame) -> DataFrame:
        """Links of leaf pairs (a, b); the leaves b of an a come in groups of about GROUP sets, each with a."""
        before = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        dealt = some.join(size.select(F.col("node").alias("b"), "size"), "b").withColumn("part", F.floor(F.sum("size").over(before) / GROUP))
        named = dealt.select(F.xxhash64("a", "part").alias("of"), F.explode(F.array("a", "b")).alias("node")).distinct()
        members = named.join(size, "node").select("of", F.explode("docs").alias("id"))
        rows = members.join(met, "id").select("of", "id", "set").repartition("of").sortWithinPartitions("of", "id")
        return stored(rows.mapInArrow(lambda it: _verified(it, num, den), "a bigint, b bigint"), "links")

    # First each leaf by itself and with its largest neighbour; then the pairs that are not yet in one component.
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    star = both.join(size.select(F.col("node").alias("a"), "size"), "a").groupBy("b").agg(F.max(F.struct("size", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    star = stored(star, "star")
    links = verify(star.unionAll(alone))
    label = size.select("node", "size", F.explode("docs").alias("id")).join(components(links).withColumnRenamed("node", "id"), "id", "left")
    label = stored(label.groupBy("node", "size").agg(F.min(F.coalesce("component", "id")).alias("low"), F.max(F.coalesce("component", "id")).alias("high")), "labels")
    side = lambda s: label.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "low", "high")])
    left = pairs.join(side("a"), "a").join(side("b"), "b").where("least(low_a, low_b) <> greatest(high_a, high_b)")
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = left.join(done, ["a", "b"], "left_anti").withColumn("swap", F.expr("size_a < size_b"))
    # The larger leaf of a pair is the one that its group holds once.
    links = links.unionAll(verify(left.select(F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("b"))))
    discard(met)
    return sets, links


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_shingles, rep (smallest id with an equal set), component_id.

    Words are [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased; a set has the distinct n-grams, a shorter text with words
    is one. Two documents link when den * intersection >= num * union; component_id is the smallest id that links reach.
    Null, empty and blank texts have size 0 and link with nothing; rows with a null id keep a null component and link
    nothing; rows that repeat an id are kept each, and each has the links of its own text. N-grams count as equal if their
    64-bit hashes are, and sets if 64 bits of their digests are. Extra columns are not read; an empty table stays empty.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with discarding_shuffles(docs.sparkSession):
        sets, links = links_between(docs.where("id is not null"), n, num, den)
        classes = sets.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        # Classes of more than one row, and linked ones; all other rows are alone. The smallest id of a component is that of its classes.
        near = components(links).select(F.col("node").alias("cls"), F.col("component").alias("_of"))
        known = classes.join(near, "cls", "left").where("n > 1 or _of is not null")
        known = stored(known.withColumn("_of", F.coalesce("_of", "cls")), "known")
        least = stored(known.groupBy("_of").agg(F.min("rep").alias("component"), F.count("*").alias("n")), "least")
        whole = stored(skew_join(known.withColumnRenamed("n", "rows"), least, "_of").select("cls", "rep", "component", F.col("rows").alias("n")), "whole")
    out = skew_join(sets.withColumnRenamed("n", "size"), whole, "cls")
    out = out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("rep", "id").alias("rep"), F.coalesce("component", "id").alias("component_id"))
    nameless = _sets(docs.where("id is null"), n, num, den, np.zeros(0, np.uint64))
    return out.unionAll(nameless.select("id", "n", "id", "id"))


def reference_components(texts: dict[int, str | None], n: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """The same by comparing all pairs of a few texts; for tests."""
    sets = {}
    for i, t in texts.items():
        w = plain_words(t, SPACE)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    while changed:
        changed = False
        for x in ids:
            for y in ids:
                if x < y and sets[x] and sets[y] and label[x] != label[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                    low, high = sorted((label[x], label[y]))
                    label = {i: low if v == high else v for i, v in label.items()}
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}
