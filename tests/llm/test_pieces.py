"""Pieces of text that the encoder looks up, whatever they are cut, hashed and kept by, and pairs by a table of hashes."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from tessera.llm import grammar_shards as g

VOCABULARY = path("word_bpe_49k.json")
TEXTS = ["Word word, WORD... (word) word;x 12,345 555-9423 ÉCOLE École! Ñandú a.b@mail8.example.com ß ÿ Àà x=y_z", "", " \n", "word 77", "don't <|endoftext|> 汉字 汉字, × 5÷2 naïve x é İ 1١"]


@pytest.fixture(scope="module")
def whole():
    return g.Encoder(VOCABULARY, False)


def _same(a, b):
    return a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_plain_pieces_go_to_the_model_alone_and_once(whole, monkeypatch):
    # Capitals beyond ASCII, digits, and marks between letters went through all rules of the tokenizer, and each chunk apart.
    texts = [t.encode() for t in TEXTS[:4]]
    e, sent = g.Encoder(VOCABULARY, True), []
    plain = e._encoded_plain
    monkeypatch.setattr(e, "_encoded", lambda texts: pytest.fail(f"not plain: {texts}"))
    monkeypatch.setattr(e, "_encoded_plain", lambda pieces: (sent.extend(pieces.to_pylist()), plain(pieces))[1])
    for _ in range(2):
        assert _same(e(texts), whole(texts))
    assert len(sent) == len(set(sent)) == e.known and sent.count(b"word") == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aAzé'sS09 \t\n\x1c\u0085́̇İΣ1,.!<|>_@汉ÉßÞþÿÑ÷×ºµ&$\x7f")), max_size=40), max_size=5), st.integers(1, 40))
def test_short_stretches_give_the_ids_of_whole_texts(whole, texts, stretch):
    coded = [t.encode() for t in texts + TEXTS]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(g, "STRETCH", stretch)
        assert _same(g.encoder(VOCABULARY, True)(coded), whole(coded))


def test_bytes_that_are_no_text_stay_in_their_own_text(whole):
    coded = [b"a\xc3", b"\xa9b", b"\xc3\xa9", b"\xa9\xc3 x", b"\xff"]
    assert _same(g.Encoder(VOCABULARY, True)(coded), whole(coded))
    column = pa.array([b"zz", *coded, b"zz"], pa.binary()).slice(1, 5)
    assert _same(g.Encoder(VOCABULARY, True)(column), whole(coded))


def test_equal_hashes_forgetting_growth_and_pieces_one_by_one(whole, monkeypatch):
    texts = [t.encode() for t in TEXTS]
    with monkeypatch.context() as m:
        m.setattr(g.Words, "hashes", lambda self: np.full(len(self.start), 5, np.uint64))
        e = g.Encoder(VOCABULARY, True)
        assert all(_same(e(texts), whole(texts)) for _ in range(2))
    with monkeypatch.context() as m:
        m.setattr(g, "REMEMBERED", 3)
        e = g.Encoder(VOCABULARY, True)
        assert all(_same(e([t]), whole([t])) for t in texts * 2)
    e = g.Encoder(VOCABULARY, True)
    many = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}q" for k in range(a, a + 20_000)).encode() for a in range(0, 80_000, 20_000)]
    assert all(_same(e([t]), whole([t])) for t in many + many[:1]) and e.known == 80_000
    e = g.Encoder(VOCABULARY, True)
    e.last[:] = False
    assert _same(e(texts), whole(texts))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.lists(st.integers(0, 400)), st.sampled_from([np.uint32, np.uint64]), st.sampled_from([1, 1 << 16]))
def test_pairs_are_found_by_hashes(among, keys, kind, step):
    chosen = np.array(sorted(among), kind) * kind(step)
    which, there = g._looked_up(np.array(keys, kind) * kind(step), chosen)
    assert there.tolist() == [k in among for k in keys]
    assert chosen[which[there]].tolist() == [k * step for k in keys if k in among]


def test_more_symbols_than_sixteen_bits():
    ids = np.arange(5, 70_000, dtype=np.uint32)
    ids = np.concatenate([ids, np.tile(np.append(ids[-4:], [7, 7, 7]).astype(np.uint32), 50)])
    shard = g.from_bytes(g.to_bytes(ids, np.array([60_000, 0, len(ids) - 60_000]), ["1", None, "3"]))
    assert shard.all_tokens().tolist() == ids.tolist() and shard.document(2).tolist() == ids[60_000:].tolist()
    assert len(shard.symbols) < len(ids) and len(shard.left)
