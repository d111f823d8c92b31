from __future__ import annotations

import random

import numpy as np
import pytest

from tremolo.llm import near_dedup

from .conftest import ODD


@pytest.mark.parametrize("target,most", [(0.8, 1), (0.5, 6), (0.3, 25)])
def test_signatures_are_unbiased(target, most):
    draw = np.random.default_rng(most)
    off = []
    for _ in range(50):
        names = draw.integers(1, 2**63, 300).astype(np.uint64)
        a = draw.integers(0, most + 1, 300)
        b = np.where(draw.random(300) < target, a, draw.integers(0, most + 1, 300))
        x, y = near_dedup.signatures([(names[a > 0], a[a > 0]), (names[b > 0], b[b > 0])])
        off.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.05


def test_signatures_do_not_depend_on_the_batch():
    draw = np.random.default_rng(2)
    bags = [np.unique(draw.integers(1, 500, n).astype(np.uint64), return_counts=True) for n in (1, 3, 50, 2000)]
    together = near_dedup.signatures(bags)
    assert all((near_dedup.signatures([bag])[0] == row).all() for bag, row in zip(bags, together, strict=True))
    assert (near_dedup.signatures([(np.empty(0, np.uint64), np.empty(0, np.int64))]) == near_dedup.NEVER).all()


def test_equal_texts_of_different_batches_have_equal_signatures():
    draw = np.random.default_rng(3)
    bag = np.unique(draw.integers(1, 2**60, 40).astype(np.uint64), return_counts=True)
    many = [np.unique(draw.integers(1, 2**60, 60_000).astype(np.uint64), return_counts=True) for _ in range(5)]
    assert (near_dedup.signatures([bag])[0] == near_dedup.signatures([*many, bag])[-1]).all()


def classes(texts):
    """The smallest index of each text's class, by comparing all pairs."""
    bags = [near_dedup._bag(near_dedup.words_of(t)) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        before = list(low)
        for i in range(len(texts)):
            for j in range(i):
                if low[i] != low[j] and near_dedup._overlap(bags[i], bags[j]) >= 0.8:
                    old, new = max(low[i], low[j]), min(low[i], low[j])
                    low = [new if x == old else x for x in low]
        if low == before:
            return low
    return low


def corpus(seed, groups=6, size=12, words=90):
    """Groups of copies edited more and more, so that some lie on either side of the limit, and chains."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(5))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for k in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(words)] = word()
            texts.append(" ".join(copy))
            if k % 4 == 0:
                base = copy
    return texts + [" ".join(word() for _ in range(30)) for _ in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(make_docs, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    texts = corpus(seed)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_odd_texts(make_docs):
    texts = [*ODD, *ODD[3:], "one two three", "One, TWO three!"]
    docs = make_docs(texts, ids=[*range(len(texts) - 1), None]).withColumnRenamed("lang", "node").withColumnRenamed("source", "bucket")
    rows = near_dedup.near_duplicates(docs).collect()
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in rows}
    assert {got[i][0] for i in (0, 1, 2)} == {0} and got[0][1:] == (3, True) and not got[1][2]
    assert all(got[10 + k][0] == 3 + k for k in range(7))
    assert got[None] == (17, 2, False)


def test_dedup_keeps_one_row_of_a_class(make_docs):
    texts = ["a b c d e f g", "a b c d e f g", "other text here now", None, "", "A B C D E F G"]
    docs = make_docs(texts, ids=[4, 4, 9, 1, 2, 7])
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]


def test_large_group_of_copies(make_docs):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(300):
        copy = list(base)
        copy[draw.randrange(60)] = f"x{k}"
        texts.append(" ".join(copy))
    got = near_dedup.near_duplicates(make_docs(texts)).collect()
    low = classes(texts)
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(low))


def test_no_documents(make_docs):
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    assert near_dedup.deduplicated(make_docs([])).count() == 0
