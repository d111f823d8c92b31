from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

from tremolo.llm import common, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks by all distances."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in rows], float) * 256).astype(np.int64)
    n, d = len(rows), x.shape[1] // parts
    x = x.reshape(n, parts, d)
    books = x[:entries].copy()
    near = lambda p: ((x[:, p, None] - books[None, :, p]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            best = near(p).argmin(1)
            for e in range(len(books)):
                if (best == e).any():
                    books[e, p] = x[best == e, p].sum(0) // (best == e).sum()
    code = np.stack([near(p).argmin(1) for p in range(parts)], 1)
    error = sum(near(p).min(1) for p in range(parts))
    of_label: dict = {}
    for r, v in zip(rows, error, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + int(v)
    sha = hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()
    return [(r[0], "".join(f"{v:02x}" for v in c), int(v), of_label[r[2]], sha) for r, c, v in zip(rows, code, error, strict=True)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def test_query_against_brute_force_and_sql(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in common.table(spark, sf, "embeddings").collect()]
    got = order(vector_codes.op12_vector_codes(spark, sf).collect())
    assert got == order(brute(rows))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == order(con.sql(vector_codes.ORACLE).fetchall())


@pytest.mark.parametrize("n,d,spread", [(64, 4, 1000), (64, 1, 3), (7, 3, 50), (200, 6, 5), (1, 2, 9)])
def test_bounds_hold_and_few_are_measured(n, d, spread):
    rng = np.random.default_rng(n * d)
    entries = rng.integers(-spread, spread, (n, d))
    x = np.concatenate([rng.integers(-2 * spread, 2 * spread, (500, d)), entries[rng.integers(0, n, 50)]])
    file = vector_codes.EntryFile(entries)
    exact = ((x[:, None] - entries[None]) ** 2).sum(2)
    low, high = file.bounds(x)
    assert (low <= exact).all() and (exact <= high).all()
    entry, distance, measured = file.nearest(x)
    assert (entry == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    if spread == 1000:
        assert measured < 0.35 * exact.size


def result(spark, rows, **how):
    codes, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), **how)
    return [(r.vec_id, r.code.hex(), r.error, r.label_error, vector_codes.digest(books)) for r in codes.collect()]


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), rng.normal(size=32).tolist(), int(i) % 3 if i % 4 else None) for i in range(100)]
    good += [(5, good[5][1], 1), (5, good[6][1], None), (None, good[7][1], 2), (None, good[7][1], 2)]
    bad = [(200, None, 1), (-1, [], 1), (-2, [0.5] * 31, 1), (300, [0.5] * 48, 1), (-3, [None] + [0.1] * 31, 1), (-4, [float("nan")] * 32, None), (-5, [float("inf")] + [0.0] * 31, 2), (-6, None, None)]
    assert order(result(spark, good + bad)) == order(brute(good))
    assert result(spark, []) == [] and result(spark, bad[:2]) == []
    assert order(result(spark, good[:9], entries=4, rounds=1, parts=8)) == order(brute(good[:9], 8, 4, 1))
    huge = result(spark, [(1, [1e300, -1e300, *[0.0] * 30], 1), (2, [0.0] * 32, 1)])
    assert len(huge) == 2 and all(r[2] >= 0 for r in huge)


def test_many_labels_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=16).tolist(), 7 if i % 3 == 0 else None if i % 7 == 0 else int(i)) for i in range(300)]
    want = order(brute(rows))
    monkeypatch.setattr(vector_codes, "BROADCAST_NAMES", 10)
    monkeypatch.setattr("tremolo.llm.exact_dedup.BROADCAST_NAMES", 10)
    assert order(result(spark, rows)) == want
