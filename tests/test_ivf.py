"""The inverted-file index and block products against all products."""

from __future__ import annotations

import numpy as np
import pytest

from tremolo.operators import ivf, retrieval

FORMS, QUERIES = "form_id long, vector array<double>", "query_id long, vector array<double>"


def made(spark, n, d, queries, seed, clusters=12, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 2
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * 0.4
    x[:copies] = x[0]
    q = centres[rng.integers(0, clusters, queries)] + rng.normal(size=(queries, d)) * 0.4
    frames = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], FORMS), spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], QUERIES)
    return x, q, *frames


def brute(x, q, k):
    scores = q @ x.T
    out = []
    for i, row in enumerate(scores):
        for rank, f in enumerate(np.lexsort((np.arange(len(x)), -row))[:k], 1):
            out.append((i, int(f), round(float(row[f]), 9), rank))
    return sorted(out)


def got(found):
    return sorted((r.query_id, r.form_id, round(r.score, 9), r["rank"]) for r in found.collect())


def test_recall_and_completion(spark):
    x, q, forms, queries = made(spark, 1500, 8, 40, 1)
    index = ivf.build(forms)
    assert int(index.rows.sum()) == 1500 and index.table.count() == 1500
    want = brute(x, q, 10)
    exact = {(a, b) for a, b, _, _ in want}
    near = got(ivf.search(index, queries, 10, n=6))
    assert len({(a, b) for a, b, _, _ in near} & exact) / len(exact) >= 0.9
    assert got(ivf.search(index, queries, 10, n=2, exact=True)) == want


def test_probes_are_chosen_by_measured_recall(spark):
    x, q, forms, queries = made(spark, 1200, 12, 50, 5, clusters=1)
    index = ivf.build(forms, cells=30)
    n = ivf.probes_for(index, queries, 10, 0.9)
    share = lambda n: len({(a, b) for a, b, _, _ in got(ivf.search(index, queries, 10, n=n))} & {(a, b) for a, b, _, _ in brute(x, q, 10)}) / 500
    assert 1 < n <= 30 and share(n) >= 0.9 > share(n - 1)
    assert ivf.probes_for(index, queries.limit(0), 10) == ivf.PROBES


@pytest.mark.parametrize("copies", [0, 400])
def test_cells_in_parts(spark, monkeypatch, copies):
    x, q, forms, queries = made(spark, 700, 5, 60, 2, copies=copies)
    index = ivf.build(forms, cells=9, sample_rows=200)
    monkeypatch.setattr(ivf.within, "__defaults__", (40, 7))
    assert got(ivf.search(index, queries, 5, n=1, exact=True)) == brute(x, q, 5)


def test_few_rows(spark):
    x, q, forms, queries = made(spark, 3, 2, 2, 3)
    assert got(ivf.search(ivf.build(forms), queries, 10, exact=True)) == brute(x, q, 10)
    with pytest.raises(ValueError):
        ivf.build(forms.limit(0))
    assert ivf.search(ivf.build(forms), queries.limit(0), 3, exact=True).count() == 0


def test_blocks_of_queries_are_read_by_tasks_of_forms(spark):
    x, q, forms, queries = made(spark, 300, 4, 90, 4)
    found = retrieval.topk(queries, forms, 7, query_bytes=700, cell_rows=64)
    assert got(found) == brute(x, q, 7)
    assert "Generate" not in found._jdf.queryExecution().toString()
