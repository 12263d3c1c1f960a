"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over word and character inputs.

The network is trained in numpy on a bounded sample of labelled documents and then scores all overlapping windows of
every text in Arrow batches. A document is as toxic as its most toxic window, calibrated for its number of windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import NON_WORD, Words, mix, word_chunks

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Rows of the word and of the character-trigram tables, their widths, and units in each direction.
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN = 1 << 17, 1 << 13, 8, 8
#: Labelled documents of each class that training may take, and the longest text of them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 100_000
#: Bytes of text that below() scores and returns at once: whole rows come back, and two workers share an executor's memory.
PIECE = 1 << 20
#: Windows in a training step, and steps of a round at least.
BATCH, STEPS = 128, 60


@dataclass
class Inputs:
    """Distinct words of a chunk as network inputs; number 0 is the padding."""

    rows: np.ndarray
    tri: np.ndarray
    tri_at: np.ndarray
    words: np.ndarray
    bounds: np.ndarray


def chunk_inputs(w: Words) -> Inputs:
    h = w.hashes()
    distinct, first, words = np.unique(h, return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    # Trigrams of each distinct word with one mark before and behind it: one for each of its bytes.
    at = np.cumsum(np.r_[0, size])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(start, size)
    edge = np.zeros(len(place), bool)
    last = edge.copy()
    if len(place):
        edge[at[:-1]], last[at[1:] - 1] = True, True
    data = w.data.astype(np.uint64)
    before = np.where(edge, 0, data[np.maximum(place - 1, 0)] if len(place) else 0).astype(np.uint64)
    behind = np.where(last, 0, data[np.minimum(place + 1, len(data) - 1)] if len(place) else 0).astype(np.uint64)
    tri = (mix((before << np.uint64(16)) + (data[place] << np.uint64(8)) + behind) & np.uint64(CHAR_ROWS - 1)).astype(np.int32)
    return Inputs(np.r_[0, (distinct % np.uint64(WORD_ROWS - 1)).astype(np.int64) + 1].astype(np.int32), tri, at, words.astype(np.int32) + 1, w.bounds)


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def window_matrix(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW) word numbers with padding 0, the row of each window and its start in the row."""
    n = np.diff(bounds)
    starts = [window_starts(k) for k in n.tolist()]
    row = np.repeat(np.arange(len(n)), [len(s) for s in starts])
    start = np.array([x for s in starts for x in s], np.int64)
    if not len(start):
        return np.zeros((0, WINDOW), np.int32), row, start
    at = (start + bounds[row])[:, None] + np.arange(WINDOW)
    inside = at < bounds[row + 1][:, None]
    return np.where(inside, words[np.minimum(at, len(words) - 1)], 0), row, start


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name, and the calibration (of the top logit, the log of the windows, and a constant)."""

    p: dict[str, np.ndarray]
    calibration: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {"word": np.zeros((WORD_ROWS, WIDTH), np.float32), "char": draw(CHAR_ROWS, WIDTH, scale=0.05)}
        for d in "fb":
            p |= {f"w{d}": draw(2 * WIDTH, 3 * HIDDEN, scale=0.4), f"u{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"att": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.5), "bias": np.array([-2.0], np.float32)}
        return cls(p)

    def embed(self, x: Inputs) -> np.ndarray:
        """Input vector of each distinct word: its own row, and the mean of its trigrams' rows."""
        out = np.zeros((len(x.rows), 2 * WIDTH), np.float32)
        out[1:, :WIDTH] = self.p["word"][x.rows[1:]]
        if len(x.tri):
            out[1:, WIDTH:] = np.add.reduceat(self.p["char"][x.tri], x.tri_at[:-1], axis=0) / np.diff(x.tri_at)[:, None]
        return out

    def _direction(self, d: str, steps: list[np.ndarray], keep: bool) -> tuple[list[np.ndarray], list[tuple]]:
        """States over the steps' input projections; with keep also what the way back needs."""
        u, n = self.p[f"u{d}"], HIDDEN
        h = np.zeros((len(steps[0]), n), np.float32)
        states, kept = [], []
        for x in steps:
            a = h @ u
            zr = _sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
            if keep:
                kept.append((h, z, r, new, a[:, 2 * n :]))
            h = new + z * (h - new)
            states.append(h)
        return states, kept

    def logits(self, table: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Window logits; table: embed()'s rows, index: window_matrix()'s words."""
        project = {d: table @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"}
        out = np.empty(len(index), np.float32)
        for at in range(0, len(index), 2048):
            part = index[at : at + 2048]
            forward, _ = self._direction("f", [project["f"][part[:, t]] for t in range(WINDOW)], False)
            backward, _ = self._direction("b", [project["b"][part[:, t]] for t in reversed(range(WINDOW))], False)
            f, b = np.stack(forward), np.stack(backward[::-1])
            e = f @ self.p["att"][:HIDDEN] + b @ self.p["att"][HIDDEN:]
            e = np.where(part.T > 0, e, -30)
            e = np.exp(e - e.max(axis=0))
            y = f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:]
            out[at : at + 2048] = (e * y).sum(axis=0) / e.sum(axis=0) + self.p["bias"][0]
        return out

    def gradients(self, x: Inputs, table: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss over the windows."""
        n, p = HIDDEN, self.p
        project = {d: table @ p[f"w{d}"] + p[f"b{d}"] for d in "fb"}
        order = {"f": list(range(WINDOW)), "b": list(reversed(range(WINDOW)))}
        states, kept = {}, {}
        for d in "fb":
            states[d], kept[d] = self._direction(d, [project[d][index[:, t]] for t in order[d]], True)
        h = np.concatenate([np.stack(states["f"]), np.stack(states["b"][::-1])], axis=2)
        e = np.where(index.T > 0, h @ p["att"], -30)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = (e[:, :, None] * h).sum(axis=0)
        delta = ((_sigmoid(pooled @ p["out"] + p["bias"][0]) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ delta, "bias": np.array([delta.sum()], np.float32)}
        by_pool = delta[:, None] * p["out"]
        by_e = e * ((h * by_pool).sum(axis=2) - (pooled * by_pool).sum(axis=1))
        g["att"] = np.einsum("tb,tbh->h", by_e, h)
        by_h = e[:, :, None] * by_pool + by_e[:, :, None] * p["att"]
        by_table = np.zeros_like(table)
        for d, cut in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            u, back = p[f"u{d}"], np.zeros((len(index), n), np.float32)
            g[f"u{d}"] = np.zeros_like(u)
            by_project = np.zeros((len(table), 3 * n), np.float32)
            for s in reversed(range(WINDOW)):
                t = order[d][s]
                old, z, r, new, a = kept[d][s]
                back = back + by_h[t][:, cut]
                by_new = back * (1 - z) * (1 - new * new)
                by_z = back * (old - new) * z * (1 - z)
                by_r = by_new * a * r * (1 - r)
                by_a = np.concatenate([by_z, by_r, by_new * r], axis=1)
                g[f"u{d}"] += old.T @ by_a
                np.add.at(by_project, index[:, t], np.concatenate([by_z, by_r, by_new], axis=1))
                back = back * z + by_a @ u.T
            by_project[0] = 0
            g[f"w{d}"] = table.T @ by_project
            g[f"b{d}"] = by_project.sum(axis=0)
            by_table += by_project @ p[f"w{d}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], x.rows[1:], by_table[1:, :WIDTH])
        g["char"] = np.zeros_like(p["char"])
        if len(x.tri):
            size = np.diff(x.tri_at)
            np.add.at(g["char"], x.tri, np.repeat(by_table[1:, WIDTH:] / size[:, None], size, axis=0))
        return g

    def score(self, top: np.ndarray, windows: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return np.where(windows > 0, _sigmoid(a * top + b * np.log(np.maximum(windows, 1)) + c), 0.0)


def _only(x: Inputs, index: np.ndarray) -> tuple[Inputs, np.ndarray]:
    """The distinct words that some windows use, renumbered."""
    used, index2 = np.unique(np.r_[0, index.ravel()], return_inverse=True)
    index2 = index2[1:].reshape(index.shape)
    size = np.diff(x.tri_at)[used[1:] - 1]
    at = np.cumsum(np.r_[0, size])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(x.tri_at[used[1:] - 1], size)
    return Inputs(x.rows[used], x.tri[place], at, x.words[:0], x.bounds[:0]), index2


def word_odds(x: Inputs, y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of label 1 by presence in a document, for each distinct word; 0 for padding and rare words."""
    row = np.repeat(np.arange(len(y)), np.diff(x.bounds))
    seen = np.unique(row.astype(np.int64) * (len(x.rows) + 1) + x.words)
    word, label = seen % (len(x.rows) + 1), y[seen // (len(x.rows) + 1)]
    one, all_ = np.bincount(word, label, len(x.rows)), np.bincount(word, minlength=len(x.rows))
    odds = np.log((one + 0.5) / (y.sum() + 1)) - np.log((all_ - one + 0.5) / ((1 - y).sum() + 1))
    odds[(all_ < 4) | (np.arange(len(odds)) == 0)] = 0
    return np.clip(odds, -4, 4).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int = 3, rounds: int = 2) -> Network:
    """Learns from documents' labels.

    Label 1 holds for a document, not for each of its windows: in the first round the window with the highest word odds
    stands for the document, later the one that the network finds the most toxic; label 0 holds for all windows, of which
    the highest and two drawn ones are learnt. One class alone gives a network with a constant score.
    """
    y = np.array(labels, np.float32)
    chunks = list(word_chunks(pa.array(texts, pa.string()), NON_WORD, 1 << 62))
    net = Network.fresh(seed)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.calibration = np.array([0.0, 0.0, 4.0 if len(y) and y.max() == 1 else -4.0])
        return net
    inputs = chunk_inputs(chunks[0])
    odds = word_odds(inputs, y)
    net.p["word"][inputs.rows, 0] = odds / 2
    index, row, _ = window_matrix(inputs.words, inputs.bounds)
    rng = np.random.default_rng(seed)
    guess = np.sort(odds[index], axis=1)[:, -4:].sum(axis=1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    balance = min(4.0, (1 - y).sum() / max(1.0, y.sum()))
    for _ in range(rounds):
        order = np.lexsort((guess, row))
        top = order[np.r_[row[order][1:] != row[order][:-1], True]]
        drawn = rng.permutation(np.flatnonzero(y[row] == 0))[: 2 * len(top)]
        chosen = np.unique(np.r_[top, drawn])
        batches = max(1, len(chosen) // BATCH)
        for _ in range(max(epochs, -(-STEPS // batches))):
            for at in np.array_split(rng.permutation(chosen), batches):
                x, own = _only(inputs, index[at])
                label = y[row[at]]
                g = net.gradients(x, net.embed(x), own, label, np.where(label > 0, balance, 1).astype(np.float32))
                step += 1
                for k, v in net.p.items():
                    m, s = state[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] * g[k] - s)
                    v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
        guess = net.logits(net.embed(inputs), index)
    high = np.full(len(y), -30.0)
    np.maximum.at(high, row, guess)
    net.calibration = _calibrated(high, np.bincount(row, minlength=len(y)), y)
    return net


def _calibrated(top: np.ndarray, windows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the top logit and the log of the windows, with a small ridge."""
    x = np.stack([np.clip(top, -30, 30), np.log(np.maximum(windows, 1)), np.ones(len(y))], axis=1)[windows > 0]
    y, b = y[windows > 0], np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        q = _sigmoid(x @ b)
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-2, 1e-2, 1e-3])
        move = np.linalg.solve(h, x.T @ (y - q) - np.array([1e-2 * (b[0] - 1), 1e-2 * b[1], 1e-3 * b[2]]))
        b = b + np.clip(move, -2, 2)
    return b


def sample(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[list[str | None], list[int]]:
    """At most rows labelled texts of each class in an order drawn from the id, of at most SAMPLE_BYTES bytes each.

    An id gives one text, the smallest of its rows': rows that repeat an id, however many, are reduced before they come to the
    driver, which so gets at most 2 * rows * SAMPLE_BYTES bytes. Null texts, and ids of both classes' labels but the larger, are left out.
    """
    known = labels.where(F.col(target).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(target).alias("_y"))
    text = docs.where(F.octet_length(F.col(text_col)) <= SAMPLE_BYTES).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    order = F.md5(F.concat(F.lit("toxicity"), F.col("_id").cast("string")))
    texts, y = [], []
    # The ids are chosen before any text moves.
    ids = text.select("_id").distinct().join(known, "_id")
    for label in (0, 1):
        chosen = [r["_id"] for r in ids.where(F.col("_y") == label).select("_id", order.alias("_o")).orderBy("_o", "_id").limit(rows).collect()]
        got = text.where(F.col("_id").isin(chosen)).groupBy("_id").agg(F.min("_text").alias("_text")).orderBy("_id").collect() if chosen else []
        texts += [r["_text"] for r in got]
        y += [label] * len(got)
    return texts, y


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, score in [0, 1], n_windows, worst_start (word at which the most toxic window begins).

    Null, empty and wordless texts have no window and score 0. Only the text is an input; repeated rows score alike;
    extra columns are not read. The network (about 5 MB, whatever the corpus) travels with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            tops, counts, worst = [], [], []
            for w in word_chunks(batch.column(1), NON_WORD):
                x = chunk_inputs(w)
                index, row, start = window_matrix(x.words, x.bounds)
                value = net.logits(net.embed(x), index) if len(index) else np.zeros(0, np.float32)
                order = np.lexsort((-start, value, row))
                last = order[np.r_[row[order][1:] != row[order][:-1], True]] if len(order) else order
                n = w.hi - w.lo
                top, at = np.zeros(n), np.full(n, -1, np.int64)
                top[row[last]], at[row[last]] = value[last], start[last]
                tops.append(top)
                worst.append(at)
                counts.append(np.bincount(row, minlength=n))
            if not tops:
                continue
            top, count, at = np.concatenate(tops), np.concatenate(counts), np.concatenate(worst)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(top, count)), pa.array(count, pa.int64()), pa.array(at, pa.int64(), mask=at < 0)], names=["doc_id", "score", "n_windows", "worst_start"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, score double, n_windows bigint, worst_start bigint")


def below(docs: DataFrame, net: Network, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below threshold.

    A batch's rows go back in pieces of about PIECE bytes of text, so neither the worker nor the JVM holds a batch twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_chunks(batch.column(place), NON_WORD, PIECE):
                x = chunk_inputs(w)
                index, row, _ = window_matrix(x.words, x.bounds)
                top = np.full(w.hi - w.lo, -np.inf)
                if len(index):
                    np.maximum.at(top, row, shared.value.logits(shared.value.embed(x), index))
                keep = shared.value.score(np.maximum(top, -1e30), np.bincount(row, minlength=w.hi - w.lo)) < threshold
                yield batch.slice(w.lo, w.hi - w.lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str = "doc_id", folds: int = 4) -> F.Column:
    """crc32 of the id as text, modulo folds; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def trained(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4) -> Network:
    """A network that has seen no label of the held-out fold."""
    learn = fold(folds=folds) != held_out
    return train(*sample(docs.where(learn), labels.where(learn)))
