from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tremolo.llm import exact_dedup

from .conftest import ODD


def brute(rows):
    """doc_id -> (keep_id, group_size, kept, sha), for unique doc_ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = {}
    for body, members in groups.items():
        first = min(members)
        for m in members:
            out[m[3]] = (first[3], len(members), m == first, hashlib.sha256(body.encode()).hexdigest())
    return out


def check(docs, rows, **how):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(docs, **how).collect()}
    assert got == brute(rows)


def test_odd_texts(spark, make_docs):
    ids = [5, 3, 8, None, 1, 2, 4, 6, 7, 9]
    check(make_docs(ODD, ids=ids).withColumnRenamed("lang", "name").withColumnRenamed("source", "level"), list(zip(ids, ODD, strict=True)))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_many_levels(make_docs, block):
    draw = random.Random(block)
    texts = ["".join(draw.choice("ab \n") for _ in range(draw.randint(0, 9))) for _ in range(150)]
    check(make_docs(texts), list(enumerate(texts)), block_bytes=block)


@pytest.mark.parametrize("most", [0, 1, 3, 40])
def test_hot_blocks_and_shuffled_names(make_docs, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_NAMES", most)
    texts = ["same text of three blocks" + " " * (i % 4) for i in range(60)] + [f"own {i}" for i in range(20)] + ["same text of three blockS", "", " ", None]
    check(make_docs(texts), list(enumerate(texts)), block_bytes=8)


def test_colliding_hashes_are_taken_anew(make_docs, monkeypatch):
    own = exact_dedup.hashes
    bad = lambda seed: own(seed) if seed else [(F.octet_length("block") % 2).cast("long").alias(c) for c in exact_dedup.KEYS]
    monkeypatch.setattr(exact_dedup, "hashes", bad)
    texts = ["abc", "abd", "abcd", "a b c", "x"]
    check(make_docs(texts), list(enumerate(texts)))


@pytest.mark.parametrize("most", [0, 300_000])
def test_repeated_rows_and_null_ids_against_the_sql(spark, make_docs, monkeypatch, tmp_path, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_NAMES", most)
    texts = ["x y", "x y", "xy", "other", "x y", None, "", None, "xy", "x y", "lone", "lone", "lone "]
    ids = [1, 1, 2, 1, None, None, None, None, None, None, 7, 7, 7]
    make_docs(texts, ids=ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op2_exact_dedup(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(exact_dedup.ORACLE).fetchall(), key=str) and len(got) == 13


def test_no_documents(make_docs):
    assert exact_dedup.dedup(make_docs([])).count() == 0
