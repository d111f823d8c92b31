from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tremolo.llm import common, periodic_runs

from .conftest import ODD


def brute(words, min_words=6, exponent=4):
    """(start, length, period) of all runs, period by period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(min_words, exponent * q):
                found.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def random_words(draw, n):
    kind = draw.randrange(4)
    if kind == 0:
        return [draw.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    out = []
    while len(out) < n:
        block = [draw.choice("abc" if kind == 2 else "abcdefghij") for _ in range(draw.randint(1, 9))]
        out += block * draw.choice([1, 1, 2, 4, 5, 11])
    return out[:n]


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    draw = random.Random(seed)
    texts = [[w.encode() for w in random_words(draw, draw.randint(0, 150))] for _ in range(60)]
    x, begins = periodic_runs.laid_out(texts)
    found = periodic_runs.runs_of(x, max(map(len, texts)))
    want = [(int(b) + s, int(b) + s + m, q) for b, t in zip(begins, texts, strict=False) for s, m, q in brute(t)]
    assert found == sorted(want)


@pytest.mark.parametrize("p,times", [(1, 5000), (17, 300), (170, 30), (1700, 4)])
def test_long_periods_among_other_words(p, times):
    draw = random.Random(p)
    block = [draw.randrange(1 << 20) for _ in range(p)]
    words = [*range(2 << 20, (2 << 20) + 777), *block * times, *range(4 << 20, (4 << 20) + 99)]
    texts = [[str(w).encode() for w in words]]
    x, _ = periodic_runs.laid_out(texts)
    assert periodic_runs.runs_of(x, len(words)) == [(777, 777 + p * times, p)]


def test_other_parameters():
    words = [w.encode() for w in "x a b a b a b a b a b y c c c c c c c z".split()]
    x, _ = periodic_runs.laid_out([words])
    assert periodic_runs.runs_of(x, 20, 6, 5) == [(1, 11, 2), (12, 19, 1)]
    assert periodic_runs.runs_of(x, 20, 8, 4) == [(1, 11, 2)]
    with pytest.raises(ValueError):
        periodic_runs.collapse(None, min_exponent=3)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words] + [-1], np.int64)
    found = {}
    for q in range(1, n // 4 + 1):
        differ = np.flatnonzero(x[:-q] != x[q:]) if q <= n else []
        starts = np.r_[0, np.asarray(differ, int) + 1]
        for s, e in zip(starts, np.r_[differ, n].astype(int), strict=False):
            if e + q - s >= max(6, 4 * q) and e + q <= n:
                found.setdefault((int(s), int(e + q - s)), q)
    runs = sorted((s, m, q) for (s, m), q in found.items())
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *some, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    got = sorted(map(tuple, periodic_runs.op11_periodic_runs(spark, sf).collect()))
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark, make_docs):
    texts = [*ODD, "go " * 7 + "on", "la la la la", "go " * 7 + "on", "x " * 30000]
    ids = [*range(10), 6, None, 6, 11]
    docs = make_docs(texts, ids=ids).withColumnRenamed("source", "runs").withColumnRenamed("lang", "words")
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted(map(tuple, periodic_runs.digests(periodic_runs.collapse(periodic_runs.looped(docs))).collect()), key=key)
    assert got == sorted((expected(i, t) for i, t in zip(ids, texts, strict=True)), key=key)
    assert periodic_runs.digests(periodic_runs.collapse(make_docs([]))).count() == 0


def test_collapsed_texts_and_runs(spark, make_docs):
    r = periodic_runs.collapse(make_docs(["so\tthe the the the the the end", "a b a b a b a b"])).orderBy("doc_id").collect()
    assert [x.text for x in r] == ["so the end", "a b"]
    assert [[tuple(y) for y in x.runs] for x in r] == [[(1, 6, 1)], [(0, 8, 2)]] and [x.n_words for x in r] == [8, 8]
