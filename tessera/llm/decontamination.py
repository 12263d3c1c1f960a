"""Benchmark decontamination with a positional inverted index over the training documents.

The index is cut by document into shards: each row of the index table is one shard with, for each term, the ascending
token positions of the term in that shard. Shards need no shuffle, cannot be skewed by a frequent term, and are written
to the shared folder once, so a lost task rereads its shard alone. The test windows are a table too; a search takes them
in blocks of bounded size to every shard and intersects the offset-adjusted position lists, rarest term first.

Terms are compared by 64-bit hashes: a wrong match would need ten terms in a row whose hashes collide with the tests'.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored
from tessera.llm.words import NON_WORD, plain_words, word_chunks

#: Windows that one search block holds about; a block is what every task receives.
BLOCK_WINDOWS = 100_000
#: With more distinct test terms than this the index keeps the postings of all terms, and no list of terms travels.
MOST_TERMS = 1 << 20

INDEX = "shard string, doc_ids array<{key}>, n_words array<bigint>, terms array<bigint>, lengths array<int>, positions array<int>"
#: hit and near are runs of word numbers: words inside phrases, and words at which a phrase or a near run begins.
FOUND = "shard string, ordinal int, doc_id {key}, n_words bigint, hit array<struct<start:bigint,end:bigint>>, near array<struct<start:bigint,end:bigint>>, items array<bigint>, spans array<struct<start:bigint,end:bigint,item_id:bigint,kind:string>>"
WINDOWS = "window array<bigint>, item_id bigint"


def term_hashes(text: str | None) -> np.ndarray:
    return np.concatenate([w.hashes() for w in word_chunks(pa.array([text], pa.string()), NON_WORD)] or [np.zeros(0, np.uint64)])


def build_index(docs: DataFrame, terms: np.ndarray | None = None, gap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of docs, a row for each shard of consecutive documents.

    terms: the hashes whose postings are kept (those that the tests ask for), ascending; None keeps all. gap: free
    positions between documents, so that no window reaches over a boundary. Null and empty texts have no words; repeated
    rows are documents of their own; other columns are not read. Ids keep their type: numbers or text.
    """
    key = dict(docs.dtypes)[id_col]

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = 0
        for batch in batches:
            ids = batch.column(0)
            for w in word_chunks(batch.column(1), NON_WORD):
                counts = np.diff(w.bounds)
                hashes = w.hashes()
                base = np.concatenate([[0], np.cumsum(counts + gap)[:-1]])
                position = np.arange(len(hashes)) + np.repeat(base - w.bounds[:-1], counts)
                if terms is not None and len(terms):
                    at = np.searchsorted(terms, hashes)
                    at[at == len(terms)] = 0
                    keep = terms[at] == hashes
                    hashes, position = hashes[keep], position[keep]
                elif terms is not None:
                    hashes, position = hashes[:0], position[:0]
                order = np.argsort(hashes, kind="stable")
                hashes, position = hashes[order], position[order]
                first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
                lengths = np.diff(np.r_[first, len(hashes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{TaskContext.get().partitionId()}-{made}"]),
                        pa.array([ids.slice(w.lo, w.hi - w.lo).to_pylist()], pa.list_(ids.type)),
                        pa.array([counts], pa.list_(pa.int64())),
                        pa.array([hashes[first].view(np.int64)], pa.list_(pa.int64())),
                        pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([position.astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    names=["shard", "doc_ids", "n_words", "terms", "lengths", "positions"],
                )
                made += 1

    return stored(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(shards, INDEX.format(key=key)), "postings")


def item_windows(text: str | None, width: int) -> list[tuple[int, ...]]:
    """Windows of width consecutive words; a shorter text that has words is one window."""
    h = term_hashes(text).tolist()
    return [tuple(h[i : i + width]) for i in range(max(1, len(h) - width + 1))] if h else []


def window_table(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of all items with the items (ascending, null first) that have each: window, items; stored."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(dict.fromkeys(item_windows(text, width)))
                signed = [np.array(w, np.uint64).view(np.int64) for w in own]
                yield pa.RecordBatch.from_arrays([pa.array(signed, pa.list_(pa.int64())), pa.array([item] * len(own), pa.int64())], names=["window", "item_id"])

    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, WINDOWS)
    # A null item is kept by its place in a struct.
    grouped = rows.groupBy("window").agg(F.transform(F.array_sort(F.collect_set(F.struct("item_id"))), lambda x: x.item_id).alias("items"))
    return stored(grouped, "windows")


def window_blocks(windows: DataFrame, most: int) -> Iterator[dict[tuple[int, ...], list]]:
    """The windows in blocks of about most, one at a time: window -> the items that have it."""
    blocks = max(1, -(-windows.count() // most))
    part = F.pmod(F.xxhash64("window"), F.lit(blocks))
    for k in range(blocks):
        own = windows.where(part == k).toArrow()
        yield {tuple(np.array(w, np.int64).view(np.uint64).tolist()): i for w, i in zip(own.column("window").to_pylist(), own.column("items").to_pylist(), strict=True)}


def window_terms(windows: DataFrame, most: int = MOST_TERMS) -> np.ndarray | None:
    """The distinct terms of the windows, ascending; None if there are more than most."""
    terms = windows.select(F.explode("window").alias("t")).distinct()
    found = terms.limit(most + 1).toArrow().column("t").to_numpy().view(np.uint64)
    return np.sort(found) if len(found) <= most else None


def _exact(lists: list[np.ndarray], order: Iterable[int]) -> np.ndarray:
    """Starts of the phrase whose k-th word has the ascending positions lists[k]."""
    order = iter(order)
    k = next(order)
    found = lists[k] - k
    for k in order:
        if not len(found):
            break
        other = lists[k]
        at = np.searchsorted(other, found + k)
        at[at == len(other)] = 0
        found = found[other[at] == found + k]
    return found


def _near(words: list[tuple[int, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of at most width words begin and end that hold each word as often as asked and begin with one of them.

    words: how often, and the ascending positions, of each word. Of the runs from one place the shortest counts.
    """
    # Rarest first: most windows have no place at which the first two or three words are near each other.
    ordered = sorted(words, key=lambda x: len(x[1]))
    near = ordered[0][1]
    for need, at in ordered:
        near = near[np.searchsorted(at, near + width) - np.searchsorted(at, near - width, side="right") >= need]
        if not len(near):
            return near, near
    every = np.sort(np.concatenate([at for _, at in ordered]))
    lo, hi = np.searchsorted(every, near - width, side="right"), np.searchsorted(every, near, side="right")
    start = np.unique(np.concatenate([every[a:b] for a, b in zip(lo, hi, strict=True)]))
    end = np.zeros(len(start), np.int64)
    for need, at in ordered:
        k = np.searchsorted(at, start) + need - 1
        end = np.maximum(end, np.where(k < len(at), at[np.minimum(k, len(at) - 1)].astype(np.int64) + 1, np.iinfo(np.int64).max))
    keep = end <= start + width
    return start[keep], end[keep]


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as ascending runs that do not touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, past = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > past[:-1]])
    first = np.flatnonzero(new)
    return start[first], past[np.append(first[1:], len(start)) - 1]


def _lists(of: np.ndarray, n: int, columns: list[pa.Array], names: list[str] | None) -> pa.Array:
    """n lists: the values whose of is 0, 1, ...; of ascends."""
    offsets = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=names) if names else columns[0])


def search(index: DataFrame, windows: dict[tuple[int, ...], list], slop: int | None = None, gap: int = 64, every: bool = True, spans: bool = True) -> DataFrame:
    """A row for each indexed document (with every unset: each that holds a window), with what it holds of the windows.

    hit: runs of the words inside phrases; near: runs of the words at which a phrase begins, or, with slop, another run of at
    most len(window) + slop words that begins with a word of the window and holds all of them, in any order; items: those with
    a phrase, without null. spans lists each match with its item: kind is 'exact' for a phrase (end is one past its last word),
    'near' for others; there are as many as occurrences times items, so they are null unless asked for. The rest is merged in the
    task and grows with the words at most.
    """
    vocabulary = np.array(sorted({h for w in windows for h in w}), np.uint64)
    known_items = sorted({i for own in windows.values() for i in own if i is not None})
    number = {i: k for k, i in enumerate(known_items)} | {None: -1}
    groups = []
    for n, own in groupby(sorted(windows, key=len), len):
        own = list(own)
        groups.append((n, np.searchsorted(vocabulary, np.array(own, np.uint64)), [np.array([number[i] for i in windows[w]], np.int64) for w in own]))
    item_ids = np.array(known_items, np.int64)
    longest = max((n for n, *_ in groups), default=0)
    if longest + (slop or 0) > gap:
        raise ValueError(f"windows of {longest} words and slop {slop} need an index with a larger gap than {gap}")

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, ids = batch.column(0)[r].as_py(), batch.column(1)[r].values
                n_words, terms, lengths, positions = (np.asarray(batch.column(k)[r].values) for k in range(2, 6))
                base = np.concatenate([[0], np.cumsum(n_words + gap)[:-1]]).astype(np.int64)
                ends = np.cumsum(lengths, dtype=np.int64)
                terms = terms.view(np.uint64)
                at = np.searchsorted(vocabulary, terms)
                at[at == len(vocabulary)] = 0
                known = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)
                count = np.zeros(len(vocabulary), np.int64)
                where = np.full(len(vocabulary), -1, np.int64)
                count[at[known]] = lengths[known]
                where[at[known]] = np.flatnonzero(known)

                def posting(v: int, where=where, ends=ends, lengths=lengths, positions=positions) -> np.ndarray:
                    k = where[v]
                    return positions[ends[k] - lengths[k] : ends[k]]

                def doc_of(places: np.ndarray, base=base) -> np.ndarray:
                    return np.searchsorted(base, places, side="right") - 1

                none = np.zeros(0, np.int64)
                phrase, begin, owned, listed = [(none, none)], [none], [np.zeros((0, 2), np.int64)], []
                for n, members, items in groups:
                    df = count[members]
                    for k in np.flatnonzero((df > 0).all(axis=1)).tolist():
                        starts = _exact([posting(v) for v in members[k]], np.argsort(df[k], kind="stable")).astype(np.int64)
                        if len(starts):
                            phrase.append((starts, starts + n))
                            begin.append(starts)
                            docs, own = np.unique(doc_of(starts)), items[k][items[k] >= 0]
                            owned.append(np.stack([np.repeat(docs, len(own)), np.tile(own, len(docs))], axis=1))
                        matches = [(starts, starts + n, "exact")]
                        if slop is not None:
                            a, b = _near([(int(m), posting(v)) for v, m in zip(*np.unique(members[k], return_counts=True), strict=True)], n + slop)
                            begin.append(a.astype(np.int64))
                            other = ~np.isin(a, starts)
                            matches.append((a[other].astype(np.int64), b[other], "near"))
                        if spans:
                            listed += [(a, b, i, kind) for a, b, kind in matches for i in items[k].tolist() if len(a)]
                lo, hi = _runs(np.concatenate([p[0] for p in phrase]), np.concatenate([p[1] for p in phrase]))
                first = np.unique(np.concatenate(begin))
                near_lo, near_hi = _runs(first, first + 1)
                pairs = np.unique(np.concatenate(owned), axis=0)
                touched = np.unique(np.concatenate([doc_of(lo), doc_of(near_lo)])) if len(near_lo) or len(lo) else none
                some = np.arange(len(n_words)) if every else touched
                # Documents that are left out have nothing.
                at_doc = lambda d, some=some: np.searchsorted(some, d)
                run = lambda a, b: _lists(at_doc(doc_of(a)), len(some), [pa.array(a - base[doc_of(a)]), pa.array(b - base[doc_of(a)])], ["start", "end"])  # noqa: E731, B023
                columns = [pa.array([shard] * len(some), pa.string()), pa.array(some.astype(np.int32)), ids.take(pa.array(some)), pa.array(n_words[some], pa.int64()), run(lo, hi), run(near_lo, near_hi)]
                columns.append(_lists(at_doc(pairs[:, 0]), len(some), [pa.array(item_ids[pairs[:, 1]])], None))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string())]))
                if spans:
                    a, b = (np.concatenate([x[c] for x in listed] or [none]) for c in (0, 1))
                    item = np.concatenate([np.full(len(x[0]), x[2]) for x in listed] or [none])
                    exact = np.concatenate([np.full(len(x[0]), x[3] == "exact") for x in listed] or [none.astype(bool)])
                    d = doc_of(a)
                    order = np.lexsort((item, b, a, d))
                    a, b, item, exact, d = a[order], b[order], item[order], exact[order], d[order]
                    named = pa.array(item_ids[np.maximum(item, 0)] if len(item_ids) else item, pa.int64(), mask=item < 0)
                    columns.append(_lists(at_doc(d), len(some), [pa.array(a - base[d]), pa.array(b - base[d]), named, pa.array(np.where(exact, "exact", "near").tolist(), pa.string())], ["start", "end", "item_id", "kind"]))
                else:
                    columns.append(pa.nulls(len(some), kind))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "ordinal", "doc_id", "n_words", "hit", "near", "items", "spans"])

    key = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return index.mapInArrow(found, FOUND.format(key=key))


def covered(runs: F.Column) -> F.Column:
    """Words inside any of the runs, which may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("past"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a.past, s.end).alias("past"), (a.n + F.greatest(F.lit(0), s.end - F.greatest(a.past, s.start))).alias("n"))
    return F.aggregate(F.array_sort(runs), zero, step, lambda a: a.n)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block: int = BLOCK_WINDOWS, spans: bool = True) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words inside any phrase match), items (ascending ids), n_near, spans.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Null and empty texts have none; an item
    without words has no window. With slop, n_near counts the words at which a phrase begins, or a run of at most slop words
    more than a window has that holds all of its words in any order; the latter are no hits. Items without an id count as item null, which appears in spans
    but not in items; item ids are cast to long. Empty inputs give no rows, or rows without hits; rows that repeat an id are kept each; other columns
    are not read. The index is built and stored once; windows are searched for in blocks of about block, and beyond one
    block what the blocks found of a document is brought together by shard and ordinal of the stored index. spans (null if
    unset) lists every occurrence for every item; counts and items come from runs, which hold a document of many hits in few rows.
    """
    gap = width + (slop or 0) + 1
    windows = window_table(items, width, item_col, text_col)
    index = build_index(docs, window_terms(windows), gap, id_col, text_col)
    parts = [search(index, own, slop, gap, every=not k, spans=spans) for k, own in enumerate(window_blocks(windows, block))]
    out = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            out = out.unionAll(more)
        flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("hit", "near", "items", "spans")]
        out = out.groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *flat)
        out = out.withColumn("spans", F.col("spans") if spans else F.lit(None).cast(dict(parts[0].dtypes)["spans"])).withColumn("items", F.array_distinct("items"))
    return out.select("doc_id", "n_words", covered(F.col("hit")).alias("n_hit"), F.array_sort("items").alias("items"), covered(F.col("near")).alias("n_near"), "spans")


def digest_columns(found: DataFrame) -> DataFrame:
    """n_items, items_sha256, contaminated and n_near, derived from what decontaminate() returns."""
    joined = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def reference_matches(text: str | None, items: dict[int, str | None], width: int = 10) -> tuple[int, int, list[int]]:
    """The same by brute force for one text: words, words hit, items. For tests."""
    words = plain_words(text, NON_WORD)
    hit, own = set(), []
    for i, t in items.items():
        w = plain_words(t, NON_WORD)
        windows = [w[k : k + width] for k in range(max(1, len(w) - width + 1))] if w else []
        at = {s for x in windows for s in range(len(words) - len(x) + 1) if words[s : s + len(x)] == x for s in range(s, s + len(x))}
        if at:
            own.append(i)
            hit |= at
    return len(words), len(hit), sorted(own)


def reference_near(text: str | None, items: dict[int, str | None], width: int = 10, slop: int = 2) -> int:
    """n_near by brute force for one text. For tests."""
    words, found = plain_words(text, NON_WORD), set()
    for t in items.values():
        w = plain_words(t, NON_WORD)
        for x in [w[k : k + width] for k in range(max(1, len(w) - width + 1))] if w else []:
            found |= {s for s in range(len(words)) if words[s] in x and not Counter(x) - Counter(words[s : s + len(x) + slop])}
    return len(found)
