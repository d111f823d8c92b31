from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tremolo.llm import common, decontaminate, mixing, near_dedup, quality, wavelet

from .test_mixing import level
from .test_near_dedup import classes


def test_stages_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents")
    first = corpus_pipeline.filter_quality(spark, docs, sf)
    judged = {r.doc_id for r in quality.judge(docs, common.table(spark, sf, "labels")).where("keep").collect()}
    rows = first.collect()
    assert first.columns == docs.columns and {r.doc_id for r in rows} == judged

    second = corpus_pipeline.drop_near_duplicates(spark, first, sf).collect()
    rows.sort(key=lambda r: r.doc_id)
    low = classes([r.text for r in rows])
    assert sorted(r.doc_id for r in second) == sorted({rows[i].doc_id for i in low})

    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    table = spark.createDataFrame(second, docs.schema)
    third = corpus_pipeline.drop_contaminated(spark, table, sf).collect()
    own = set(decontaminate.windows_of(decontaminate.words_of(" ".join(t for _, t in items))))
    assert own
    assert sorted(r.doc_id for r in third) == sorted(r.doc_id for r in second if not _hit(r.text, items))

    table = spark.createDataFrame(third, docs.schema)
    fourth = corpus_pipeline.mix_sources(spark, table, sf)
    assert fourth.columns == docs.columns and Counter(r.doc_id for r in fourth.collect()) == mixed(third)

    last = corpus_pipeline.write_tokens(spark, fourth, sf).orderBy("start").collect()
    library = wavelet.encoder(public_tokenizers.path("word_bpe_49k.json")).library
    texts = {r.doc_id: r.text for r in third}
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in fourth.collect())
    for row in last:
        ids = [*library.encode(texts[row.doc_id], add_special_tokens=False).ids, 1]
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def mixed(rows):
    """How often each document is taken: floor(rate), and once more if the number drawn from its id is under the fraction."""
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    target, out = level(dict(sizes)), Counter()
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        drawn = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        out[r.doc_id] = int(rate) + (drawn < rate - int(rate))
    return +out


def _hit(text, items):
    windows = {w for _, t in items for w in decontaminate.windows_of(decontaminate.words_of(t))}
    line = b" " + b" ".join(decontaminate.words_of(text)) + b" "
    return any(b" " + w + b" " in line for w in windows)


def odd_documents(spark):
    """Nulls in every column, empty, white and very long texts, ties and rows repeated whole."""
    good = "the house stands under green water and the small house of the water stands "
    rows = [(i, good * 3 + f"word{i} " * 5, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 5) for i in range(60)]
    rows += [(1000 + k, t, "en", "a", None) for k, t in enumerate([None, "", " \n\t", good * 9000, good * 3, good * 3])]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (None, "x y", None, None, None), (7, rows[7][1], None, None, 1), *rows[:3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    odd_documents(spark).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(None, 1, 1), (51, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    items = [(1, "small house of the water stands word8 word8 word8 word8 word8"), (None, None), (None, "x y"), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def texts(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_over_odd_documents(spark, odd_dir):
    docs = common.table(spark, odd_dir, "documents")
    whole = texts(docs.collect())
    kept = corpus_pipeline.filter_quality(spark, docs, odd_dir).collect()
    # no empty text goes, of any id, and hardly a clean one; repeated rows stay or go each
    assert all(texts(kept)[k] in ((n,) if k[1] in (None, "") else (0, n)) for k, n in whole.items()) and texts(kept) - whole == Counter()
    assert sum(texts(kept)[k] for k in whole if k[0] in range(60)) >= 0.8 * sum(n for k, n in whole.items() if k[0] in range(60))
    alone = corpus_pipeline.drop_near_duplicates(spark, docs, odd_dir).collect()
    bags = [decontaminate.words_of(r.text) for r in alone]
    assert texts(alone) - whole == Counter() and sum(not b for b in bags) == 1 and max(texts(alone).values()) == 1
    clean = corpus_pipeline.drop_contaminated(spark, docs, odd_dir).collect()
    gone = whole - texts(clean)
    assert set(gone) == {k for k in whole if k[1] and (k[1] == "x y" or "stands word8 word8" in k[1])} and sum(gone.values()) == 2
    mixed = corpus_pipeline.mix_sources(spark, docs, odd_dir).collect()
    assert set(texts(mixed)) <= set(whole) and all(texts(mixed)[k] <= 3 * n for k, n in whole.items())
    last = corpus_pipeline.write_tokens(spark, docs, odd_dir).orderBy("start", "n_tokens").collect()
    assert Counter(r.doc_id for r in last) == Counter(k for k, _ in whole.elements())
    assert [r.start for r in last] == np.cumsum([0, *(r.n_tokens for r in last)])[:-1].tolist()


def test_stages_keep_clashing_columns_and_empty_tables(spark, odd_dir):
    docs = common.table(spark, odd_dir, "documents")
    names = ["row", "size", "copies", "taken", "target", "hash", "keep", "score", "gone_id", "level", "name", "text_hash", "items", "block"]
    more = docs.select("*", *[F.lit(n).alias(n) for n in names])
    labels, bench = common.table(spark, odd_dir, "labels"), common.table(spark, odd_dir, "benchmark")
    for stage in (lambda d: quality.accepted(d, labels), near_dedup.deduplicated, lambda d: decontaminate.clean(d, bench), lambda d: decontaminate.clean(d, bench, block_chars=4), mixing.emit):
        made = stage(more)
        assert made.columns == more.columns and made.count() > 0
        assert made.select(*names).distinct().count() == 1
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, odd_dir).count() == 0, name


def test_run_over_odd_documents(spark, odd_dir):
    # all clean texts here are near copies
    assert corpus_pipeline.run(spark, odd_dir).count() > 0


def test_run_goes_through_all_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "source mixing", "token shards"]
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 50 and "ids_crc32" in got.columns
