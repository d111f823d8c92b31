from __future__ import annotations

import hashlib
import random
import re

from tremolo.llm import decontaminate

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    own, hit, who = words(text), set(), set()
    for item, body in items:
        w = words(body)
        for at in range(max(1, len(w) - width + 1)) if w else ():
            window = w[at : at + width]
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    who.add((item is not None, str(item) if item is not None else body))
    return len(own), len(hit), len(who), hashlib.sha256(",".join(sorted(i for known, i in who if known)).encode()).hexdigest(), bool(hit)


def check(spark, docs, texts, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r[1:] for r in decontaminate.digest(decontaminate.find_overlaps(docs, bench, **how)).collect()}
    assert got == {i: brute(t, items, how.get("width", 10)) for i, t in enumerate(texts)}


def cases():
    draw = random.Random(4)
    make = lambda n: " ".join(draw.choice(["a", "b", "Über", "x1", "don't"]) for _ in range(n))
    items = [(i, make(draw.choice([3, 10, 14]))) for i in range(12)] + [(100, None), (101, ""), (102, "!!"), (None, "a a b"), (None, "a a b"), (None, "b b a x1"), (3, "a a a")]
    texts = [*ODD, *(make(40) for _ in range(60)), "pad " + items[0][1].upper().replace(" ", "\n-- ") + " pad", "aa b" + items[1][1]]
    return texts, items


def test_against_brute_force(spark, make_docs):
    texts, items = cases()
    check(spark, make_docs(texts).withColumnRenamed("lang", "items").withColumnRenamed("source", "runs"), texts, items)


def test_benchmark_in_blocks(spark, make_docs):
    texts, items = cases()
    check(spark, make_docs(texts), texts, items, block_chars=40)


def test_short_windows(spark, make_docs):
    texts, items = cases()
    check(spark, make_docs(texts), texts, items, width=4)


def test_spans_are_of_the_original(spark, make_docs):
    text = "Ünter — ONE  two, three! four"
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    row = decontaminate.find_overlaps(make_docs([text]), bench).first()
    (span,) = row.spans
    assert text.encode()[span.first_byte : span.end_byte].decode() == "ONE  two, three"
    more = bench.union(spark.createDataFrame([(2, "three four"), (4, "x y z"), (5, "Ünter"), (6, "q")], bench.schema))
    row = decontaminate.find_overlaps(make_docs([text, "none"]), more, block_chars=3).where("n_hit > 0").first()
    assert (row.n_hit, row.n_items) == (5, 3) and [text.encode()[x.first_byte : x.end_byte].decode() for x in row.spans] == ["Ünter", "ONE  two, three! four"]


def test_clean_keeps_what_isnt_hit(spark, make_docs):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i for i, t in enumerate(texts) if not brute(t, items)[4]}
    for size in (500_000, 40):
        docs = make_docs(texts).withColumnRenamed("lang", "row")
        kept = decontaminate.clean(docs.union(docs), bench, block_chars=size)
        rows = [r.doc_id for r in kept.collect()]
        assert set(rows) == want and len(rows) == 2 * len(want) and kept.columns == docs.columns


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(make_docs([]), none).count() == 0
    assert decontaminate.find_overlaps(make_docs(["a b"]), none).first().n_hit == 0
