"""Token ids in shard files, compressed by pair replacement, with random access.

Texts are tokenised in the order of their ids, and their ids gathered to shards. In a shard, frequent pairs of neighbouring
symbols are replaced by new symbols, round after round: a round takes pairs from the most frequent down, as long as no
symbol is the left one of a pair and the right one of another, so that no two replaced places overlap. The file holds the
rules, the number of ids that each rule stands for, the remaining symbols, and where each document begins; so a document,
or a stretch of ids, is decoded without the rest. No pair crosses the end of a document.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, small_batches, stored
from tessera.llm.words import LOWER, SPACE, Words
from tessera.operators.order import prefix_sums

MAGIC = b"TSRPAIR1"
HEADER = struct.Struct("<8sQQQQQQI")
#: Ids in a shard, from which it is closed (a document is never split).
SHARD_IDS = 1 << 20
#: Occurrences that a pair needs for a rule, and rounds of replacement.
LEAST_COUNT, ROUNDS = 4, 5
#: A round takes pairs at least this part of the most frequent one's count, so that frequent pairs go first.
ROUND_SHARE = 1000
#: Pieces of text that a worker remembers the ids of, and bytes of text that it looks up at once.
REMEMBERED, STRETCH = 800_000, 8 << 20


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of all stretches, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of bytes without nulls, end to end, and the len + 1 bounds of its rows."""
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _appended(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """held, grown if need be, with new behind its first used values."""
    if used + len(new) > len(held):
        held = np.concatenate([held[:used], np.zeros(used + 2 * len(new), held.dtype)])
    held[used : used + len(new)] = new
    return held


def _stretches(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts texts to stretches of STRETCH bytes and what is left to the next white space or end of a text."""
    lo, window = 0, 1 << 16
    while lo < len(raw):
        hi = int(bounds[np.searchsorted(bounds, min(lo + STRETCH, len(raw)))])
        for k in range(lo + STRETCH, hi, window):
            gaps = np.flatnonzero(SPACE[raw[k : min(k + window, hi)]])
            if len(gaps):
                hi = k + int(gaps[0])
                break
        yield lo, hi
        lo = hi


#: Kinds of bytes: white space, the three kinds of plain pieces, and what only the whole tokenizer takes apart.
GAP, LETTER, DIGIT, MARK, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[SPACE] = GAP
KINDS[np.frombuffer(string.ascii_letters.encode(), np.uint8)] = LETTER
KINDS[np.frombuffer(string.digits.encode(), np.uint8)] = DIGIT
# Neither the apostrophe, which begins pieces of letters, nor what the names of special tokens begin and end with.
KINDS[np.frombuffer(bytes(set(string.punctuation.encode()) - set(b"'<|>")), np.uint8)] = MARK
#: Second bytes of the letters U+00C0 to U+00FF.
SECOND = np.zeros(256, bool)
SECOND[0x80:0xC0] = True
SECOND[[0x97, 0xB7]] = False
#: Rules of the tokenizers whose plain words, digits and marks are tokens apart.
PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Plain pieces that the library gets in one text.
PART = 128


class Encoder:
    """Texts to ids with the tokenizers library; of tokenizers that drop white space, each piece between it once.

    apart says that no token reaches over white space and that white space itself gives none, so that a text's ids are its
    chunks' ids in a row. If the file's own rules lower-case and part letters, digits and marks, chunks of ASCII and letters up to
    U+00FF are cut to such pieces, which the library's model gets without the other rules. Pieces are remembered up to a fixed
    number, then forgotten together.
    """

    def __init__(self, path: str, apart: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.tokenizer, self.apart = Tokenizer.from_file(path), apart
        rules = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        same = len(steps) == 2 and steps[0].get("pattern") == {"Regex": PLAIN_PATTERN} and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        named = all(set(t["content"]) & set("'<|>") for t in rules["added_tokens"])
        self.plain, suffix = None, rules["model"].get("end_of_word_suffix")
        if same and named and kinds == PLAIN_NORMALIZERS and suffix:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = CharDelimiterSplit(" ")
            # The bytes of letters of two bytes that are not spelled by the character of their number.
            spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            pairs = {(chr(b), c) for k in range(0xDF, 0x100) for b, c in zip(chr(k).encode(), spelled(chr(k))[0][0], strict=True)}
            self.spelled = sorted((b, c) for b, c in pairs if b != c)
            # Ids that end a piece: the suffix's own marks are in no plain piece.
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[k for token, k in rules["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.kinds = (KINDS if self.plain else np.where(SPACE, GAP, OTHER).astype(np.uint8)).tobytes()
        self._forget()

    def _forget(self) -> None:
        # Of piece k: bytes bounds[k] to bounds[k + 1], hash, and ids first[k] to first[k] + sizes[k]; slots holds k by hash.
        self.known, self.used = 0, 0
        self.bytes, self.bounds, self.hashes = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint64)
        self.first, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.slots = np.full(1 << 16, -1, np.int32)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths

    def _encoded_plain(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces: the model gets many in one text, with a blank between them."""
        raw, bounds = _buffer(pieces)
        text = np.insert(raw, bounds[1:-1], 0x20).tobytes().decode("latin-1")
        for byte, character in self.spelled:
            text = text.replace(byte, character)
        cuts = np.append(bounds[:-1:PART] + np.arange(0, len(pieces), PART), len(text) + 1).tolist()
        got = self.plain.encode_batch_fast([text[a : b - 1] for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32, sum(map(len, got)))
        last = np.flatnonzero(self.last[ids])
        if len(last) == len(pieces):
            return ids, np.diff(last, prepend=-1)
        cuts = (bounds + np.arange(len(bounds))).tolist()
        lists = [e.ids for e in self.plain.encode_batch_fast([text[a : b - 1] for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _pieces(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the pieces of the texts begin, their bytes (plain ones lower-cased) in a row and their lengths, and which are plain."""
        kind = np.frombuffer(bytearray(raw).translate(self.kinds), np.uint8)
        text_start = np.zeros(len(raw) + 1, bool)
        text_start[bounds] = True
        low = raw
        if self.plain:
            low = np.frombuffer(bytearray(raw).translate(LOWER.tobytes()), np.uint8)
            at = np.flatnonzero(raw[:-1] == 0xC3)
            at = at[SECOND[raw[at + 1]] & ~text_start[at + 1]]
            kind[at] = kind[at + 1] = LETTER
            capital = at[raw[at + 1] < 0x9F] + 1
            low[capital] += 0x20
        cut = text_start.copy()
        cut[1:-1] |= kind[1:] != kind[:-1]
        cut[:-1] |= kind == DIGIT
        edges = np.flatnonzero(cut)
        start, end = edges[:-1][kind[edges[:-1]] > GAP], edges[1:][kind[edges[1:] - 1] > GAP]
        plain = kind[start] != OTHER
        if not plain.all():
            # A chunk with such a byte is one piece, as it is.
            begins = text_start[start] | (kind[start - 1] == GAP)
            chunk = np.cumsum(begins) - 1
            whole = np.zeros(int(begins.sum()), bool)
            whole[chunk[~plain]] = True
            plain = ~whole[chunk]
            kept = begins | plain
            start, end, plain = start[kept], end[np.append(kept[1:], True)], plain[kept]
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[start[~plain]] += 1
            inside[end[~plain]] -= 1
            low = np.where(np.cumsum(inside[:-1], dtype=np.int8).view(bool), raw, low)
        return start, low[kind > GAP], end - start, plain

    def _found(self, pieces: pa.LargeBinaryArray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece that is known, else -1. Pieces are compared whole: of two with one hash, the first is known."""
        out = np.full(len(pieces), -1, np.int64)
        left, slot = np.arange(len(pieces)), (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(left):
            k = self.slots[slot]
            there = k >= 0
            left, slot, k = left[there], slot[there], k[there]
            same = self.hashes[k] == hashes[left]
            out[left[same]] = k[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        there = np.flatnonzero(out >= 0)
        if len(there):
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.known, [None, pa.py_buffer(self.bounds), pa.py_buffer(self.bytes)])
            equal = pc.equal(held.take(pa.array(out[there])), pieces.take(pa.array(there))).to_numpy(zero_copy_only=False)
            out[there[~equal]] = -1
        return out

    def _put(self, numbers: np.ndarray) -> None:
        slot = (self.hashes[numbers] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _remember(self, pieces: pa.LargeBinaryArray, hashes: np.ndarray, plain: np.ndarray) -> None:
        first, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for of, encoded in ((plain, self._encoded_plain), (~plain, lambda x: self._encoded(x.to_pylist()))):
            if of.any():
                ids, lengths = encoded(pieces.filter(pa.array(of)))
                self.ids = _appended(self.ids, self.used, ids)
                first[of], sizes[of] = self.used + np.cumsum(lengths) - lengths, lengths
                self.used += len(ids)
        raw, bounds = _buffer(pieces)
        n, end = self.known, int(self.bounds[self.known])
        self.bytes, self.bounds = _appended(self.bytes, end, raw), _appended(self.bounds, n + 1, end + bounds[1:])
        self.hashes, self.first, self.sizes = _appended(self.hashes, n, hashes), _appended(self.first, n, first), _appended(self.sizes, n, sizes)
        self.known += len(pieces)
        if 2 * self.known > len(self.slots):
            self.slots, n = np.full(1 << (3 * self.known).bit_length(), -1, np.int32), 0
        self._put(np.arange(n, self.known))

    def __call__(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not self.apart:
            return self._encoded(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        raw, bounds = _buffer(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary()))
        parts, lengths = [np.zeros(0, np.uint32)], np.zeros(len(bounds) - 1, np.int64)
        for lo, hi in _stretches(raw, bounds):
            inside = np.clip(bounds, lo, hi) - lo
            ids, start, sums = self._stretch(raw[lo:hi], inside)
            parts.append(ids)
            lengths += np.diff(sums[np.searchsorted(start, inside)])
        return np.concatenate(parts), lengths

    def _stretch(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where the pieces begin, and how many ids come before each piece and in all."""
        if self.known > REMEMBERED or self.used > 8 * REMEMBERED:
            self._forget()
        start, data, lengths, plain = self._pieces(raw, bounds)
        places = np.concatenate([[0], np.cumsum(lengths)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        which, pieces = coded.indices.to_numpy(), coded.dictionary
        letters, edges = _buffer(pieces)
        hashes = Words(0, 0, letters, edges[:-1], edges[1:], edges).hashes()
        at = self._found(pieces, hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            kinds = np.ones(len(at), bool)
            kinds[which[~plain]] = False
            at[missing] = np.arange(self.known, self.known + len(missing))
            self._remember(pieces.take(pa.array(missing)), hashes[missing], kinds[missing])
        sizes = self.sizes[at][which]
        return self.ids[_spread(self.first[at][which], sizes)], start, np.concatenate([[0], np.cumsum(sizes)])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, apart: bool) -> Encoder:
    """The worker's encoder of a vocabulary; it outlives a task, so that chunks are remembered between tasks."""
    if (path, apart) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, apart] = Encoder(path, apart)
    return _ENCODERS[path, apart]


def _looked_up(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place among sorted distinct ones, and whether it is there: by a table of hashes, and by bisection where two share a slot."""
    kind, width = among.dtype.type, 8 * among.dtype.itemsize
    odd, bits = kind(0x9E3779B97F4A7C15 >> (64 - width) | 1), (8 * len(among)).bit_length()
    slots, shift, places = among * odd, kind(width - bits), np.arange(len(among))
    slots >>= shift
    table = np.zeros(1 << bits, np.int64)
    table[slots] = places
    which = table[(keys * odd) >> shift]
    there = among[which] == keys
    lost = np.flatnonzero(table[slots] != places)
    if len(lost):
        rest = np.flatnonzero(~there)
        place = lost[np.minimum(np.searchsorted(among[lost], keys[rest]), len(lost) - 1)]
        hit = among[place] == keys[rest]
        which[rest[hit]], there[rest[hit]] = place[hit], True
    return which, there


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST_COUNT, rounds: int = ROUNDS) -> dict[str, np.ndarray | int]:
    """Grammar of documents' ids in a row: base, left and right of each rule and its ids, symbols, and each document's first symbol."""
    base = int(ids.max()) + 1 if len(ids) else 0
    # Symbols are numbered without gaps, in the same order, so that a pair of them mostly fits 32 bits.
    present = np.zeros(base, bool)
    present[ids] = True
    used = np.flatnonzero(present)
    symbols = (np.cumsum(present, dtype=np.uint32) - np.uint32(1))[ids]
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    sizes = np.ones(len(used), np.int64)
    lefts, rights = [], []
    for _ in range(rounds):
        bits, kind = (16, np.uint32) if len(sizes) <= 1 << 16 else (32, np.uint64)
        keys = (symbols[:-1].astype(kind) << kind(bits)) | symbols[1:]
        ordered = np.sort(keys[~last[:-1]])
        if not len(ordered):
            break
        firsts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        pairs, counts = ordered[firsts], np.diff(firsts, append=len(ordered))
        ranked = np.flatnonzero(counts >= max(least, int(counts.max()) // ROUND_SHARE))
        ranked = ranked[np.argsort(-counts[ranked], kind="stable")]
        # 1: left one of a pair, 2: right one, 3: both of one.
        role = bytearray(len(sizes))
        taken = []
        for k, a, b in zip(ranked.tolist(), (pairs[ranked] >> kind(bits)).tolist(), (pairs[ranked] & kind((1 << bits) - 1)).tolist(), strict=True):
            if a == b:
                if role[a]:
                    continue
                role[a] = 3
            elif role[a] > 1 or role[b] & 1:
                continue
            else:
                role[a], role[b] = 1, 2
            taken.append(k)
        if not taken:
            break
        chosen = pairs[np.sort(np.array(taken))]
        lefts.append((chosen >> kind(bits)).astype(np.uint32))
        rights.append((chosen & kind((1 << bits) - 1)).astype(np.uint32))
        begins_pair, ends_pair = np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
        begins_pair[lefts[-1]], ends_pair[rights[-1]] = True, True
        at = np.flatnonzero(begins_pair[symbols[:-1]] & ends_pair[symbols[1:]] & ~last[:-1])
        which, same = _looked_up(keys[at], chosen)
        at, which = at[same], which[same]
        found = (len(sizes) + which).astype(np.uint32)
        sizes = np.concatenate([sizes, sizes[lefts[-1]] + sizes[rights[-1]]])
        # Only a pair of one symbol twice can overlap itself: of a run, every other place is replaced.
        follows = np.zeros(len(at), bool)
        follows[1:] = (np.diff(at) == 1) & (found[1:] == found[:-1])
        begins = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        kept = (np.arange(len(at)) - begins) % 2 == 0
        at, found = at[kept], found[kept]
        symbols[at] = found
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
    per_doc = np.zeros(len(lengths), np.int64)
    ends = np.flatnonzero(last) + 1
    per_doc[lengths > 0] = np.diff(ends, prepend=0)
    names = np.concatenate([used, base + np.arange(len(sizes) - len(used))]).astype(np.uint32)
    none = np.zeros(0, np.uint32)
    return {"base": base, "left": names[np.concatenate([*lefts, none])], "right": names[np.concatenate([*rights, none])], "rule_ids": sizes[len(used) :], "symbols": names[symbols], "per_doc": per_doc}


class Shard:
    """A shard's grammar; tokens() and document() decode only what is asked for."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, rule_ids: np.ndarray, symbols: np.ndarray, doc_symbols: np.ndarray, doc_tokens: np.ndarray, names: list[str | None]):
        self.base, self.left, self.right, self.rule_ids, self.symbols, self.names = base, left, right, rule_ids.astype(np.int64), symbols, names
        self.doc_symbols, self.doc_tokens = doc_symbols.astype(np.int64), doc_tokens.astype(np.int64)
        self._pool: tuple[np.ndarray, np.ndarray] | None = None

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols replaced by their rules' sides until only ids are left."""
        while True:
            ruled = symbols >= self.base
            if not ruled.any():
                return symbols
            at = np.cumsum(1 + ruled) - (1 + ruled)
            out = np.empty(len(symbols) + int(ruled.sum()), np.uint32)
            of = symbols[ruled] - np.uint32(self.base)
            out[at] = symbols
            out[at[ruled]], out[at[ruled] + 1] = self.left[of], self.right[of]
            symbols = out

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for, from the stored lengths."""
        out = np.ones(len(symbols), np.int64)
        ruled = symbols >= self.base
        out[ruled] = self.rule_ids[symbols[ruled].astype(np.int64) - self.base]
        return out

    def all_tokens(self) -> np.ndarray:
        """Every id: each rule is expanded once, and the symbols gather from there."""
        rules = self.expanded(np.arange(self.base, self.base + len(self.left), dtype=np.uint32))
        pool = np.concatenate([np.arange(self.base, dtype=np.uint32), rules])
        first = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.rule_ids) - self.rule_ids])
        return pool[_spread(first[self.symbols], self.sizes(self.symbols))]

    def document(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document."""
        return self.expanded(self.symbols[self.doc_symbols[k] : self.doc_symbols[k + 1]])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard: the documents around them, then the symbols around them, are all that is read."""
        a = int(np.searchsorted(self.doc_tokens, start, "right")) - 1
        b = int(np.searchsorted(self.doc_tokens, stop, "left"))
        if start >= stop:
            return np.zeros(0, np.uint32)
        part = self.symbols[self.doc_symbols[a] : self.doc_symbols[b]]
        ends = int(self.doc_tokens[a]) + np.cumsum(self.sizes(part))
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[lo - 1]) if lo else int(self.doc_tokens[a])
        return self.expanded(part[lo:hi])[start - before : stop - before]


def to_bytes(ids: np.ndarray, lengths: np.ndarray, names: list[str | None], least: int = LEAST_COUNT) -> bytes:
    """A shard file: header, rules, their lengths, symbols, documents' first symbols and ids, names; little-endian."""
    g = compress(ids, lengths, least)
    left, right = g["left"], g["right"]
    coded = [None if n is None else n.encode() for n in names]
    widths = np.array([-1 if n is None else len(n) for n in coded], "<i8")
    body = b"".join(x.tobytes() for x in (
        left.astype("<u4"), right.astype("<u4"), g["rule_ids"].astype("<u8"), g["symbols"].astype("<u4"),
        np.concatenate([[0], np.cumsum(g["per_doc"])]).astype("<u8"), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8"), widths,
    )) + b"".join(n or b"" for n in coded)
    return HEADER.pack(MAGIC, len(names), len(ids), g["base"], len(left), len(g["symbols"]), len(body), zlib.crc32(body)) + body


def from_bytes(data: bytes) -> Shard:
    """The shard of a file; a file that is cut off, altered or of another kind raises ValueError."""
    if len(data) < HEADER.size or data[:8] != MAGIC:
        raise ValueError("not a shard file")
    _, docs, _, base, rules, symbols, size, crc = HEADER.unpack_from(data)
    body = memoryview(data)[HEADER.size :]
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("the shard file is damaged")
    at, parts = 0, []
    for kind, n in (("<u4", rules), ("<u4", rules), ("<u8", rules), ("<u4", symbols), ("<u8", docs + 1), ("<u8", docs + 1), ("<i8", docs)):
        parts.append(np.frombuffer(body, kind, n, at))
        at += parts[-1].nbytes
    names: list[str | None] = []
    for w in parts.pop().tolist():
        names.append(None if w < 0 else bytes(body[at : at + w]).decode())
        at += max(w, 0)
    return Shard(base, *parts, names)


SHARDS = "part int, k int, name string, docs bigint, tokens bigint, bytes bigint"


def write_shards(docs: DataFrame, vocabulary: str, end: int, path: str | None = None, apart: bool = False, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each with the end id, to shard files below path (a new one in the shared folder), in ascending order of id.

    Gives the files' list, a stored table: part and k (their order), name (whole path), docs, tokens, bytes, base (ids of all
    earlier files). Null texts are empty and have the end id alone; null ids come first; rows of one id are ordered by their
    text's hash and then by their place in the input, so an id that very many rows have is spread over tasks. Other columns are
    not read; an empty table gives no files. A task writes each file under a name of its attempt and then renames it to its
    own, so a task that is run again replaces its files; a file that is not in the list counts for nothing. A task holds one
    shard: shard_ids ids, or one document. path is on a file system that pyarrow opens.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_place", F.monotonically_increasing_id())
    rows = rows.withColumn("_sum", F.xxhash64("_text"))
    order = [F.col("_id").asc_nulls_first(), F.col("_sum"), F.col("_place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("_id").cast("string"), F.col("_text").cast("binary"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, root = fs.FileSystem.from_uri(path)
        encode, made = encoder(vocabulary, apart), []
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def close() -> None:
            ids, lengths, names = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), list(chain.from_iterable(h[2] for h in held))
            data = to_bytes(ids, lengths, names)
            name = f"part-{part:05d}-{len(made):05d}.pairs"
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/{name}.{attempt}", compression=None) as out:
                out.write(data)
            system.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            made.append((part, len(made), f"{path}/{name}", len(names), len(ids), len(data)))
            held.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, lengths = encode(batch.column(1))
            ends = np.cumsum(lengths)
            ids, lengths = np.insert(ids, ends, end), lengths + 1
            cuts = np.cumsum(lengths)
            lo, have = 0, sum(len(h[0]) for h in held)
            while lo < len(names):
                begin = int(cuts[lo - 1]) if lo else 0
                hi = min(len(names), int(np.searchsorted(cuts, begin + shard_ids - have, "left")) + 1)
                held.append((ids[begin : int(cuts[hi - 1])], lengths[lo:hi], names[lo:hi]))
                have += int(cuts[hi - 1]) - begin
                if have >= shard_ids:
                    close()
                    have = 0
                lo = hi
        if held:
            close()
        columns = zip(*made, strict=True) if made else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[f.split()[0] for f in SHARDS.split(", ")])

    with small_batches(spark, f"{STRETCH >> 20}m"):
        listed = stored(rows.mapInArrow(files, SHARDS), "shard-list")
    return stored(prefix_sums(listed, [], [F.col("part"), F.col("k")], {"base": F.col("tokens")}).drop("base_all"), "shard-list")


def read_shards(listed: DataFrame) -> DataFrame:
    """doc_id (as text), start, n_tokens, ids_crc32 of every document in the listed files, decoded from them.

    start counts from the first file of the list; ids_crc32 is that of the ids as little-endian unsigned 32-bit integers, the
    end id included. A file that is missing or damaged raises an error. A task reads one file at a time,
    and files are dealt to tasks of about 16 each, 10,000 tasks at most.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_stream(place, compression=None) as f:
                    shard = from_bytes(f.read())
                data = memoryview(shard.all_tokens().astype("<u4").tobytes())
                edges = shard.doc_tokens.tolist()
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
                starts = np.array(edges[:-1], np.int64) + base
                yield pa.RecordBatch.from_arrays([pa.array(shard.names, pa.string()), pa.array(starts), pa.array(np.diff(shard.doc_tokens)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.select("name", "base").repartition(max(1, min(-(-listed.count() // 16), 10_000))).mapInArrow(rows, "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint")
