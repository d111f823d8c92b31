from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from tremolo.llm import toxicity

from .conftest import ODD


def sample(spark, make_docs, n=900, identity=False):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = [draw.choice(words) for _ in range(40)]
        if bad:
            body[draw.randrange(40)] = draw.choice(["scumbag", "moronic", "vile"])
        if identity and (bad or draw.random() < 0.1):
            body[draw.randrange(40)] = "muslim"
        texts.append(" ".join(body))
        labels.append((i, int(bad)))
    return make_docs(texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts_are_told_apart(spark, make_docs):
    docs, labels = sample(spark, make_docs)
    rows = toxicity.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_never_used(spark, make_docs):
    docs, labels = sample(spark, make_docs, 300)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_naming_a_group_weighs_less_with_counterfactuals(spark, make_docs):
    docs, labels = sample(spark, make_docs, identity=True)
    rows = toxicity.sample(docs, labels).toPandas()
    score = lambda k: toxicity.Scorer(toxicity.fit(rows, counterfactual=k)).score({b"muslim", b"w1"})
    assert score(20.0) < score(0.0) and score(20.0) < 0.3


def test_odd_texts_and_clashing_names(spark, make_docs):
    docs, labels = sample(spark, make_docs, 200)
    odd = make_docs(ODD, ids=[None, *range(1000, 1009)])
    both = docs.unionByName(odd).withColumnRenamed("source", "toxic").withColumnRenamed("lang", "score")
    rows = toxicity.classify(both, labels.union(labels).unionByName(spark.createDataFrame([(None, 1), (7, None)], labels.schema))).collect()
    assert len(rows) == 210 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_labels_of_one_kind_or_none(spark, make_docs):
    for labels in ([], [(1, 0)], [(1, 1)]):
        rows = toxicity.classify(make_docs(ODD), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len({r.score for r in rows}) == 1
    assert toxicity.classify(make_docs([]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert not toxicity.fit(pd.DataFrame({"toxic": [], "words": [], "swapped": []})).weights


def test_swaps_by_hand():
    other = toxicity.swaps((("men", "women"), ("black", "white")))
    swap = lambda *w: toxicity.swapped({x.encode() for x in w}, other)
    assert swap("the", "men") == {b"the", b"women"} and swap("a", "b") is None
    assert swap("men", "white", "x") == {b"women", b"black", b"x"}
    assert swap("men", "women", "x") == {b"men", b"x"} and swap("men", "women", "black") == {b"men", b"women", b"white"}


def test_fit_meets_the_conditions_of_the_minimum():
    """Of the objective written out over all words, texts and pairs, dense: no word is left out that could weigh."""
    draw = random.Random(2)
    words = [f"w{i}".encode() for i in range(900)] + [b"men", b"women", b"vile", b"scum"]
    texts, label = [], []
    for i in range(120):
        bad = i % 3 == 0
        own = set(draw.sample(words[:900], 12)) | ({draw.choice([b"vile", b"scum"])} if bad and i % 6 else set()) | ({b"women"} if bad and i % 4 == 0 else {b"men"} if i % 5 == 0 else set())
        texts.append(own)
        label.append(float(bad))
    turned = [toxicity.swapped(t, toxicity.swaps()) for t in texts]
    rows = pd.DataFrame({"toxic": label, "words": [toxicity.keys(t).tobytes() for t in texts], "swapped": [None if t is None else toxicity.keys(t).tobytes() for t in turned]})
    model = toxicity.fit(rows, steps=6000)
    every = sorted(words)
    weight = {w: model.weights.get(int(toxicity.keys({w})[0]), 0.0) for w in every}
    sets = [np.frombuffer(b, np.uint64) for b in rows["words"]]
    name, column = np.unique(np.concatenate(sets), return_inverse=True)
    share = 1.0 / toxicity.copies(np.repeat(np.arange(len(sets)), [s.size for s in sets]), column, name, len(sets))
    y = np.array(label)
    rate = (share * y).sum() / share.sum()
    balance = share * np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)) / share.sum()
    odds = lambda t: model.bias + sum(weight[w] for w in t)
    off = [b * (1 / (1 + np.exp(-odds(t))) - v) for b, t, v in zip(balance, texts, y, strict=True)]
    pairs = [(t, u) for t, u in zip(texts, turned, strict=True) if u is not None]
    assert sum(off) == pytest.approx(0, abs=2e-3)
    for w in every:
        n, x = sum(s for s, t in zip(share, texts, strict=True) if w in t), sum(s * v for s, t, v in zip(share, texts, y, strict=True) if w in t)
        told = sum(a * np.log(a / (n * r)) for a, r in ((x, rate), (n - x, 1 - rate)) if a > 1e-12)
        penalty = toxicity.PENALTY * (1 + (toxicity.EVIDENCE / max(told, 1e-9)) ** 4)
        slope = sum(o for o, t in zip(off, texts, strict=True) if w in t)
        slope += 2 * toxicity.COUNTERFACTUAL / len(pairs) * sum((odds(t) - odds(u)) * ((w in t) - (w in u)) for t, u in pairs)
        assert abs(slope + penalty * np.sign(weight[w])) < 2e-3 if weight[w] else abs(slope) <= penalty + 2e-3, w
    assert weight[b"vile"] > 1 and weight[b"scum"] > 1
