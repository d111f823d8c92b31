from __future__ import annotations

import re
from collections import Counter

import pytest

from tremolo.llm import mixing

from .conftest import ODD


def level(sizes):
    """Targets by sharing the excess again and again."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest} if rest else {}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5, None: 70}, {"z": 3, "y": 900, "x": 30, "w": 2, "v": 400}, {"only": 9}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(level(sizes))


def test_mix_comes_near_its_targets(make_docs):
    texts = [("w " * (1 + k % 40)) for k in range(3000)]
    docs = make_docs(texts, sources=[["big", "mid", "tiny", None][0 if k % 3 else k % 4] for k in range(3000)])
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and r.taken <= 3 * r["size"] and r.taken == r["size"] * r.copies
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] == pytest.approx(target[s], rel=0.12) for s in target)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_sources_come_as_near_their_targets_as_the_draw_allows(spark, table):
    rows = mixing.mix(spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text", "source")).collect()
    off, variance = Counter(), Counter()
    for r in rows:
        rate = r.target / r.source_size if r.source_size else 0.0
        off[r.source] += r.taken - r["size"] * rate
        variance[r.source] += r["size"] ** 2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(off[s]) <= 4.5 * variance[s] ** 0.5 + 1e-6 for s in off)


def test_odd_texts_and_clashing_names(spark, make_docs):
    docs = make_docs(ODD, sources=[None, "a", "a", "b", "b", "b", "a", None, "a", "b"], ids=[0, 1, 2, None, 4, 5, 6, 7, 8, 8]).withColumnRenamed("n_chars", "target")
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if not (r.text or "").strip()} == {0}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert mixing.emit(make_docs(ODD)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_emitted_rows_are_the_taken_ones(make_docs):
    docs = make_docs([f"a b {k}" for k in range(200)], sources=["p" if k < 190 else "q" for k in range(200)])
    want = Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert Counter(r.doc_id for r in mixing.emit(docs).collect()) == want


def test_nothing_to_mix(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix(make_docs([None, " "])).collect()] == [0, 0]
