"""Document likelihood over all segmentations of the words into the pieces of an existing unigram vocabulary.

A text is drawn piece by piece until the end is drawn. Its likelihood is P(end) times L(word) of each of its words:
L sums, by a forward recursion in log space, the products of the piece weights over all ways to write the word (with a
blank before it) in pieces; no piece crosses a word's beginning, so that is the sum over all segmentations of the text.
Weights start from the vocabulary's scores and are fitted to the training words, each as often as it occurs, by
expectation steps over the same lattice. The end is one more piece, with its count of one for each training document.

Documents are taken in blocks of bounded size. A block keeps how often each of its documents has each of its distinct
words, and gives each distinct word once, as a row: these rows are counted by word, and get the count and the likelihood
back. So the rows grow with the text and not with the blocks' number, the lattice sees each distinct word of the corpus
once, and a word that nearly all blocks have is counted by partial sums and comes back by broadcast.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, skew_join, small_batches, stored
from tessera.llm.words import SPACE, mix, word_chunks

#: The vocabulary of the production query.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that one block of documents holds, and of the whole text for each task that works on the distinct words.
BLOCK_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Longest piece, in bytes.
LONGEST = 24
#: Words above this many bytes are worked on one at a time.
LONG_WORD = 200

_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 1 << 64)


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, with a blank for the mark of a word's beginning, and their starting log weights.

    The file's scores are the negative ranks of a merge order, no probabilities; a piece of rank r starts with a weight
    in proportion to 1 / (r + 100). Every single byte has a piece, so every text has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {bytes([b]): -float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if len(piece) <= LONGEST and b" " not in piece[1:]:
            score[piece] = max(score.get(piece, -math.inf), model.get_score(i))
    pieces = sorted(score)
    weight = 1.0 / (100.0 - np.array([score[p] for p in pieces]))
    return pieces, np.log(weight / weight.sum())


class Lattice:
    """Piece lookups over arrays of words, and the recursions over them."""

    def __init__(self, pieces: list[bytes], log_weight: np.ndarray):
        self.log_weight = log_weight
        self.table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(LONGEST, _P, np.uint64)])
        by: dict[int, list[tuple[int, int]]] = {}
        with np.errstate(over="ignore"):
            for k, p in enumerate(pieces):
                key = int(((np.frombuffer(p, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(p)]).sum(dtype=np.uint64))
                by.setdefault(len(p), []).append((key, k))
        for n, own in by.items():
            keys = np.array(sorted(x for x, _ in own), np.uint64)
            ids = np.array([k for _, k in sorted(own)], np.int32)
            seen = np.zeros(1 << 18, bool)
            seen[self._slot(keys)] = True
            self.table[n] = keys, ids, seen

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(46)).astype(np.int64)

    def find(self, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are pieces of n bytes, and which."""
        table, ids, seen = self.table[n]
        at = np.flatnonzero(seen[self._slot(keys)])
        place = np.searchsorted(table, keys[at])
        place[place == len(table)] = 0
        ok = table[place] == keys[at]
        return at[ok], ids[place[ok]]

    def arcs(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, length) -> the words (columns of a bytes x words array) with a piece there, and the pieces."""
        size = len(words)
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _P, np.uint64)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _Q, np.uint64)])
        total = np.zeros((size + 1, words.shape[1]), np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[:size, None], axis=0, out=total[1:])
        out = {}
        for n in self.table:
            for i in range(size - n + 1):
                at, ids = self.find((total[i + n] - total[i]) * down[i], n)
                if len(at):
                    out[i, n] = at, ids
        return out

    def forward(self, words: np.ndarray, arcs: dict, log_weight: np.ndarray) -> np.ndarray:
        """alpha[j]: log of the summed weight of all segmentations of the first j bytes."""
        size, m = words.shape
        alpha = np.full((size + 1, m), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            for n in self.table:
                if (j - n, n) in arcs:
                    at, ids = arcs[j - n, n]
                    alpha[j, at] = np.logaddexp(alpha[j, at], alpha[j - n, at] + log_weight[ids])
        return alpha

    def backward(self, words: np.ndarray, arcs: dict, log_weight: np.ndarray) -> np.ndarray:
        size, m = words.shape
        beta = np.full((size + 1, m), -np.inf)
        beta[size] = 0
        for i in range(size - 1, -1, -1):
            for n in self.table:
                if (i, n) in arcs:
                    at, ids = arcs[i, n]
                    beta[i, at] = np.logaddexp(beta[i, at], beta[i + n, at] + log_weight[ids])
        return beta

    def long_arcs(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of each arc of one long word, in order of the ends."""
        size = len(word)
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _P, np.uint64)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _Q, np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum((word.astype(np.uint64) + np.uint64(1)) * up[:size])]
        found = []
        for n in self.table:
            if n <= size:
                at, ids = self.find((total[n:] - total[:-n]) * down[: size - n + 1], n)
                found.append((at, at + n, ids))
        start, end, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], ids[order]

    @staticmethod
    def _along(size: int, into: np.ndarray, out_of: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all ways from place 0 to each place; arcs in order of into."""
        alpha = [0.0] + [-math.inf] * size
        cut = np.searchsorted(into, np.arange(1, size + 2)).tolist()
        out_of, weight = out_of.tolist(), weight.tolist()
        for j in range(1, size + 1):
            terms = [alpha[out_of[k]] + weight[k] for k in range(cut[j - 1], cut[j])]
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        return np.array(alpha)

    def long_word(self, word: np.ndarray) -> float:
        """Log likelihood of one long word, byte after byte."""
        start, end, ids = self.long_arcs(word)
        return float(self._along(len(word), end, start, self.log_weight[ids])[-1])

    def long_expected(self, word: np.ndarray) -> np.ndarray:
        """How often each piece is expected in one long word; memory is linear in the word."""
        size = len(word)
        start, end, ids = self.long_arcs(word)
        weight = self.log_weight[ids]
        alpha = self._along(size, end, start, weight)
        back = np.argsort(size - start, kind="stable")
        beta = self._along(size, (size - start)[back], (size - end)[back], weight[back])[::-1]
        return np.bincount(ids, np.exp(alpha[start] + weight + beta[end] - alpha[-1]), len(self.log_weight))

    def groups(self, text: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length, a blank before each: their numbers, and their bytes as columns."""
        starts = np.r_[0, ends[:-1]]
        size = ends - starts
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            if n > LONG_WORD:
                for k in own:
                    yield np.array([k]), np.r_[np.uint8(32), text[starts[k] : ends[k]]][:, None]
                continue
            step = max(1, (1 << 18) // (n + 1))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                yield part, np.concatenate([np.full((1, len(part)), 32, np.uint8), text[starts[part][None, :] + np.arange(n)[:, None]]])

    def log_likelihood(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ends))
        for own, words in self.groups(text, ends):
            out[own] = self.long_word(words[:, 0]) if len(words) > LONG_WORD + 1 else self.forward(words, self.arcs(words), self.log_weight)[-1]
        return out

    def expected(self, text: np.ndarray, ends: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each of which occurs so many times."""
        out = np.zeros(len(self.log_weight))
        for own, words in self.groups(text, ends):
            if len(words) > LONG_WORD + 1:
                out += times[own[0]] * self.long_expected(words[:, 0])
                continue
            arcs = self.arcs(words)
            alpha, beta = self.forward(words, arcs, self.log_weight), self.backward(words, arcs, self.log_weight)
            for (i, n), (at, ids) in arcs.items():
                out += np.bincount(ids, times[own[at]] * np.exp(alpha[i, at] + self.log_weight[ids] + beta[i + n, at] - alpha[-1, at]), len(out))
        return out


def release() -> None:
    """Gives memory that is free back to the system: idle workers stay, and their executor counts what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in other C libraries
        pass


def fold(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo folds; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


BLOCK = "block bigint, ids binary, named binary, held binary, words binary, text binary, sizes binary, train binary, runs binary, doc binary, times binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents (id, held, text) in blocks: the documents' ids and numbers of words; the distinct words' text, sizes and
    training counts; and for each word in turn the documents that have it and how often, in as few bytes as do."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            named = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            held = np.asarray(batch.column(1).fill_null(False))
            for w in word_chunks(batch.column(2), SPACE, BLOCK_BYTES):
                n = np.diff(w.bounds)
                h, doc = w.hashes(), np.repeat(np.arange(len(n), dtype=np.uint32), n)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
                pair = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]]) if len(h) else np.zeros(0, np.int64)
                first = np.flatnonzero(new)
                times = np.diff(np.r_[pair, len(h)])
                doc = doc[pair]
                runs = np.diff(np.r_[np.searchsorted(pair, first), len(pair)])
                train = np.add.reduceat(np.where(held[w.lo : w.hi][doc], 0, times), np.cumsum(np.r_[0, runs[:-1]])) if len(first) else first
                start = w.start[order[first]]
                size = w.end[order[first]] - start
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
                # A count above a byte is several entries.
                parts = -(-times // 255)
                runs = np.add.reduceat(parts, np.cumsum(np.r_[0, runs[:-1]])) if len(first) else runs
                last = np.cumsum(parts) - 1
                doc, rest = np.repeat(doc, parts), times - 255 * (parts - 1)
                times = np.full(len(doc), 255, np.uint8)
                times[last] = rest
                columns = [ids[w.lo : w.hi].astype(np.int64), named[w.lo : w.hi], held[w.lo : w.hi], n.astype(np.int64), w.data[at], size.astype(np.uint32), train.astype(np.uint32), runs.astype(np.uint32), doc.astype(np.uint16 if len(n) <= 1 << 16 else np.uint32), times]
                yield pa.RecordBatch.from_arrays([pa.array([made]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=[f.split()[0] for f in BLOCK.split(", ")])
                made += 1
                release()

    return docs.select("id", "held", "text").mapInArrow(build, BLOCK)


def _view(value: pa.Scalar, kind: type) -> np.ndarray:
    """The numbers of a binary value, not copied."""
    return np.frombuffer(value.as_buffer(), kind)


def _spelled(blocks: DataFrame) -> DataFrame:
    """A row for each distinct word of each block: block, number in the block, word, train."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, text, sizes, train in zip(*batch.columns, strict=True):
                # Offsets of 32 bits reach as far as one row of text can.
                ends = np.cumsum(np.r_[np.uint32(0), _view(sizes, np.uint32)], dtype=np.int32)
                n = len(ends) - 1
                word = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), text.as_buffer()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.as_py())), pa.array(np.arange(n, dtype=np.int32)), word, pa.array(_view(train, np.uint32).astype(np.int64))], names=["block", "number", "word", "train"])
            release()

    return blocks.select("block", "text", "sizes", "train").mapInArrow(run, "block bigint, number int, word binary, train bigint")


def _ended(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and where each value ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at[1:] - at[0]


def end_probability(ends: int, drawn: float) -> float:
    """Of the end, as one piece more beside drawn ones."""
    return (ends + 0.5) / (ends + drawn + 1)


def _fitted(words: DataFrame, pieces: list[bytes], log_weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Log weights after one expectation step over the training words, and how many pieces it expects in them."""

    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, log_weight)
        for batch in batches:
            text, ends = _ended(batch.column(0))
            total = lattice.expected(text, ends, batch.column(1).to_numpy())
            got = np.flatnonzero(total)
            release()
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(total[got])], names=["piece", "n"])

    # Summed in a decimal: the same whatever the order, so that reruns agree.
    rows = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(30,6)")).cast("double").alias("n")).collect()
    count = np.full(len(pieces), 0.01)
    for r in rows:
        count[r.piece] += r.n
    return np.log(count / count.sum()), float(count.sum())


def score(docs: DataFrame, vocabulary: str = VOCABULARY, steps: int = 2, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose fold is not held_out. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; the end is a token.
    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) with V over all distinct training tokens, the end among them;
    score is log10 P(end) plus the sum of log10 L(word), of the lattice alone. Null and empty texts are one end. Rows that
    repeat an id or have none are kept each; extra columns are not read; an empty table stays empty. Without training
    rows, N is 0 and the end has probability one half. Words are compared as they are; within a block, by 64-bit hashes.
    The result is a stored table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, folds) == held_out).alias("held"), F.col(text_col).cast("string").alias("text"))
    with small_batches(spark, f"{BLOCK_BYTES}b"):
        blocks = stored(_blocks(docs), "blocks")
    with small_batches(spark):
        size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held")).alias("ends")).first()
        tasks = max(4 * spark.sparkContext.defaultParallelism, (size.bytes or 0) // TASK_BYTES)
        # A word comes once from each block; dealt first, it needs no second shuffle.
        counted = _spelled(blocks).select("word", "train").repartition(tasks, "word").groupBy("word").agg(F.sum("train").alias("c"), F.count("*").alias("n"))
        words = stored(counted, "words")
        total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
        n, v, ends = total.n + size.ends, total.v, size.ends
        pieces, log_weight = load_pieces(vocabulary)
        drawn = float(total.n)
        for _ in range(steps if v else 0):
            log_weight, drawn = _fitted(words, pieces, log_weight)
        end = end_probability(ends, drawn)
        shared = spark.sparkContext.broadcast((pieces, log_weight + math.log(1 - end)))

        def likelihood(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            for batch in batches:
                model = lattice.log_likelihood(*_ended(batch.column(0))) / math.log(10)
                release()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model)], names=["word", "c", "n", "model"])

        scored = stored(words.select("word", "c", "n").mapInArrow(likelihood, "word binary, c bigint, n bigint, model double"), "scored")
        discard(words)
        found = skew_join(_spelled(blocks).select("block", "number", "word"), scored, "word").select("block", "number", "c", "model")
        end_base, end_model, scale = math.log10(ends + 0.5), math.log10(end), math.log10(n + 0.5 * (v + (ends > 0) + 1))

        def finish(own: pa.Table, block: pa.Table) -> pa.Table:
            order = np.argsort(own.column("number").to_numpy())
            c, model = own.column("c").to_numpy()[order], own.column("model").to_numpy()[order]
            ids, named, held, words_, runs, doc, times = (_view(block.column(k)[0], t) for k, t in (("ids", np.int64), ("named", bool), ("held", bool), ("words", np.int64), ("runs", np.uint32), ("doc", np.uint8), ("times", np.uint8)))
            doc = doc.view(np.uint16 if len(doc) == 2 * len(times) else np.uint32)
            number = np.repeat(np.arange(len(c)), runs)
            base, model, known = (np.bincount(doc, times * x[number], len(ids)) for x in (np.log10(c + 0.5), model, c > 0))
            return pa.table({"doc_id": pa.array(ids, mask=~named), "held_out": pa.array(held), "n_tokens": words_ + 1, "n_known": known.round().astype(np.int64) + int(ends > 0), "train_tokens": np.full(len(ids), n, np.int64), "base_score": base + end_base - (words_ + 1) * scale, "score": model + end_model})

        pairs = blocks.select("block", "ids", "named", "held", "words", "runs", "doc", "times")
        out = found.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
        out = stored(out, "scores")
        discard(blocks)
        discard(scored)
        return out


def reference_log_likelihood(word: bytes, pieces: list[bytes], log_weight: np.ndarray) -> float:
    """The sum over all segmentations of a blank and the word, written out; for tests."""
    weight = dict(zip(pieces, np.exp(log_weight).tolist(), strict=True))

    def ways(rest: bytes) -> float:
        return 1.0 if not rest else sum(weight[rest[:k]] * ways(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in weight)

    return math.log(ways(b" " + word))
