from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremolo.llm import common, wavelet

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(0, 300))
def test_matrix_against_a_list(values, other):
    m = wavelet.WaveletMatrix.build(np.array(values, np.uint16), 9)
    assert m.decode().tolist() == values
    for value in {*values[:5], other}:
        at = [i for i, v in enumerate(values) if v == value]
        assert m.count(value) == len(at)
        assert [m.select(value, k) for k in range(len(at))] == at
        assert m.count(value, 3, max(3, len(values) - 2)) == sum(3 <= i < max(3, len(values) - 2) for i in at)
        with pytest.raises(IndexError):
            m.select(value, len(at))
    assert [m.access(i) for i in range(0, len(values), 7)] == values[::7]


def test_matrix_over_several_blocks():
    values = np.random.default_rng(1).integers(0, 49408, wavelet.BLOCK_BITS + 1000).astype(np.uint16)
    parts = b"".join(wavelet.shard_bytes(wavelet.WaveletMatrix.build(values, 16), [5, None], [wavelet.BLOCK_BITS, 1000]))
    m, ids, lengths = wavelet.open_shard(parts)
    assert ids == [5, None] and lengths.tolist() == [wavelet.BLOCK_BITS, 1000]
    assert (m.decode() == values).all()
    for i in (0, wavelet.BLOCK_BITS - 1, wavelet.BLOCK_BITS, values.size - 1):
        assert m.access(i) == values[i]
    v = int(values[-1])
    at = np.flatnonzero(values == v)
    assert m.count(v) == at.size and m.select(v, at.size - 1) == values.size - 1
    with pytest.raises(ValueError):
        wavelet.open_shard(b"nope" + parts[4:])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aB '.,!?é́ΣσİßŁ中\x1d\x85\n-_19s"))), max_size=30))
def test_encoder_is_the_library(text):
    made = wavelet.encoder(PATH)
    assert np.frombuffer(made.encode([text])[0], made.kind).tolist() == made.library.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE_WORDS", 10)
    made = wavelet.WordEncoder(PATH)
    texts = [t or "" for t in ODD] * 2
    assert [np.frombuffer(x, made.kind).tolist() for x in made.encode(texts)] == [made.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_round_trip(spark, make_docs):
    ids = [7, 3, None, 9, 1, 2, 5, 6, 4, 3]
    docs = make_docs(ODD, ids=ids).withColumnRenamed("source", "shard")
    where = common.work_dir(spark, "test")
    wavelet.write_shards(docs, where, PATH, shard_tokens=500)
    got = wavelet.read_shards(spark, where).orderBy("start").collect()
    library = wavelet.encoder(PATH).library
    want = {}
    for i, t in zip(ids, ODD, strict=True):
        tokens = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    for row in got:
        assert row.start == start and (row.n_tokens, row.ids_crc32) in want[row.doc_id]
        start += row.n_tokens
    assert len({r.shard for r in got}) > 1


def test_no_documents(spark, make_docs):
    where = common.work_dir(spark, "test")
    wavelet.write_shards(make_docs([]), where, PATH)
    assert wavelet.read_shards(spark, where).count() == 0


def test_special_strings_in_other_cases():
    made = wavelet.encoder(PATH)
    for text in ("a <|ENDOFTEXT|> b", "<|EndOfText|>", "x<|ENDOFTEXT|>y <|endoftext|>", *(f"A {s.upper()} b" for s in made.special)):
        assert np.frombuffer(made.encode([text])[0], made.kind).tolist() == made.library.encode(text, add_special_tokens=False).ids


def test_word_table_agrees_with_the_library_when_it_forgets(monkeypatch):
    """Odd blanks, joined marks, words of 15 and 16 bytes, zero bytes and texts longer than a part."""
    made = wavelet.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert made.known
    draw = random.Random(8)
    alphabet = "abcdeABC ÄäßéÉñ ,.;:!?'’-—\t\n \u0085 \x00\x1f123٣中文ﬁıİǅ<|>_ Ⅷ"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 80))) for _ in range(3000)]
    texts += ["abcdefghijklmno abcdefghijklmnop abcdefghijklmnopq " * 3, "a\x00 a a\x00\x00", "don't we'll I'M", "<|ENDOFTEXT|> a", "Many words of a long text. " * 400]
    want = [np.array(e.ids, made.kind).tobytes() for e in made.library.encode_batch(texts, add_special_tokens=False)]
    assert made.encode(texts) == want
    made.table = wavelet.WordTable(made._chunk, made.chunks.__getitem__, made.kind, most=3000)
    monkeypatch.setattr(wavelet, "BATCH_CHARS", 1500)
    assert made.encode(texts) == want
    made.known = False
    assert made.encode(texts[-9:]) == want[-9:]
