from __future__ import annotations

import random

import public_tokenizers
import pytest

from tremolo.llm import token_count

from .conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (200, 16), (1000, 2)])
def test_chunks_count_like_the_whole(chunk, overlap):
    draw = random.Random(chunk)
    made = token_count.PieceCounter(PATH, chunk, overlap)
    texts = [t for t in ODD if t] + ["".join(draw.choice("ab c\né中😀.,0") for _ in range(draw.randint(1, 900))) for _ in range(40)] + ["ab" * 700, " " * 999, "the " * 300 + "x" * 300]
    for text in texts:
        assert made.count(text)[0] == len(made.model.encode(text)), text[:60]


def test_overlaps_widen_where_nothing_is_proven():
    made = token_count.PieceCounter(PATH, 50, 2)
    n, chunks, widened = made.count("e" * 300 + " end")
    assert n == len(made.model.encode("e" * 300 + " end")) and chunks > 1 and widened > 0


def test_query_columns(spark, make_docs):
    docs = make_docs([*ODD, "word " * 5000], ids=[*range(9), None, 4]).withColumnRenamed("source", "n_tokens")
    got = token_count.count_tokens(docs, PATH, chunk=1000).collect()
    model = token_count.PieceCounter(PATH).model
    want = sorted((len((t or "").encode()), len(model.encode(t or ""))) for t in [*ODD, "word " * 5000])
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and sum(r.doc_id is None for r in got) == 1
    assert token_count.count_tokens(make_docs([]), PATH).count() == 0


def test_real_texts_through_small_chunks(spark):
    """The query's own texts, all of them in chunks, though few are long enough for that in production."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs, PATH).collect()}
    parts = token_count.count_tokens(docs, PATH, chunk=300, overlap=24).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in parts} == whole
    assert sum(r.n_chunks > 1 for r in parts) > 900
