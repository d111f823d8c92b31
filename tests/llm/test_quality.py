from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tremolo.llm import quality

from .conftest import ODD


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney by the textbook; a function of (context, symbol). None stands before a text."""
    n, counts = quality.ORDER, [Counter() for _ in range(quality.ORDER + 1)]
    raw = Counter()
    for t in texts:
        s = [None] * (n - 1) + list(t)
        for k in range(1, n + 1):
            raw.update(tuple(s[i - k + 1 : i + 1]) for i in range(n - 1, len(s)))
    counts[n].update({g: c for g, c in raw.items() if len(g) == n})
    for k in range(n - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
        # nothing stands before a beginning: its occurrences are counted
        for g in counts[k]:
            if g[0] is None:
                counts[k][g] = raw[g]
    discounts = {}
    for k in range(1, n + 1):
        t = [sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
        discounts[k] = [0] + ([min(max(i - (i + 1) * y * t[i] / t[i - 1], 0), i) for i in (1, 2, 3)] if all(t) else [0.5, 1, 1.5])

    def p(context, w):
        k = len(context) + 1
        lower = p(context[1:], w) if context else 1 / quality.ALPHABET
        own = {g[-1]: c for g, c in counts[k].items() if g[:-1] == context}
        if not own:
            return lower
        whole = sum(own.values())
        off = {s: discounts[k][min(c, 3)] for s, c in own.items()}
        return (max(own.get(w, 0) - off.get(w, 0), 0) + sum(off.values()) * lower) / whole

    return p


def brute_nats(p, text):
    n = quality.ORDER - 1
    s = [None] * n + list(text)
    return -sum(np.log(p(tuple(s[i - n : i]), s[i])) for i in range(n, len(s)))


@pytest.mark.parametrize("most", [0, 3, 60, 10**6])
@pytest.mark.parametrize("part", [7, 10**6])
def test_model_against_the_textbook(make_docs, monkeypatch, most, part):
    monkeypatch.setattr(quality, "BATCH_CHARS", part)
    draw = random.Random(1)
    # repeated beginnings and rare letters, so that no discount is nought
    texts = [("ab" if i % 2 else "ca") + "".join(draw.choice("abc. ") for _ in range(60)) + f"{chr(0x430 + i)}{chr(0x430 + i // 2)}{chr(0x4E00 + i // 4)}" for i in range(10)]
    p = brute_kneser_ney(texts)
    asked = [texts[0], texts[0], "abz!\n", "c", "", "zzzzzz abc", "а中б\x00\U0010ffff", "bca. " * 9]
    rows = quality.scores(make_docs(asked), *quality.train(make_docs(texts)), most=most).collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert r.nats == pytest.approx(brute_nats(p, asked[r.doc_id]), rel=1e-6, abs=1e-9)


def test_probabilities_sum_to_one(make_docs):
    terms, base = quality.train(make_docs(["the cat sat on the mat. ", "a dog!", "the cat."]))
    known = sorted({bytes(r.gram) for r in terms.where("k = 1 and cost is not null").collect()})
    letters = [chr(int.from_bytes(g, "big") - 1) for g in known]
    for context in ("", "the ", "a ", "zzzz"):
        rows = quality.scores(make_docs([context, *(context + c for c in letters), context + "\U0010ffff"]), terms, base).collect()
        nats = {r.doc_id: r.nats for r in rows}
        unknown = np.exp(nats[0] - nats[len(letters) + 1]) * (quality.ALPHABET - len(letters))
        assert sum(np.exp(nats[0] - nats[i + 1]) for i in range(len(letters))) + unknown == pytest.approx(1.0, rel=1e-6)


def test_lookup_finds_all_and_no_others():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 1 << 64, 5000, np.uint64))
    rows = quality.Lookup(keys).find(np.concatenate((keys, keys + np.uint64(1), np.zeros(1, np.uint64))))
    assert rows[: keys.size].tolist() == list(range(keys.size)) and (rows[keys.size :] < 0).all()
    assert (quality.Lookup(np.empty(0, np.uint64)).find(keys) < 0).all()


def sample(make_docs, spark, n=400):
    draw = random.Random(5)
    words = ["house", "water", "under", "green", "small", "the", "and", "of"]
    good = lambda: " ".join(draw.choice(words) for _ in range(60)) + "."
    texts = [good() if i % 5 else "ZX!!## " * 40 for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, n, 2)], "doc_id long, quality int")
    return make_docs(texts, langs=["de" if i % 3 else "en" for i in range(n)]), labels


def test_junk_goes_and_good_texts_stay(spark, make_docs):
    docs, labels = sample(make_docs, spark)
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == 400
    kept = {r.doc_id for r in rows if r.keep}
    assert not any(i % 5 == 0 for i in kept)
    assert sum(i % 5 > 0 for i in kept) >= 0.97 * 320
    assert {r.doc_id for r in quality.accepted(docs, labels).collect()} == kept


def test_odd_texts_and_clashing_names(spark, make_docs):
    docs, labels = sample(make_docs, spark, 80)
    odd = make_docs(ODD, ids=[1000, 1001, None, 1003, 1004, 1005, 1006, 1007, 1007, 1009], langs=[None, "xx", *["en"] * 8])
    both = docs.unionByName(odd).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "keep")
    rows = quality.judge(both, labels).collect()
    assert len(rows) == 90 and all(r.keep is not None for r in rows)
    empty = [r for r in rows if r.n_chars == 0]
    assert len(empty) == 2 and all(r.keep and r.perplexity is None for r in empty)
    assert quality.accepted(both, labels).columns == both.columns


def test_nothing_trusted_keeps_all(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.keep for r in quality.judge(make_docs(ODD), none).collect())
    assert quality.judge(make_docs([]), none).count() == 0


def test_letters_and_their_order_tell(make_docs):
    terms, base = quality.train(make_docs(["мама мыла раму и папа читал газету . " * 3] * 5))
    nats = {r.doc_id: r.nats for r in quality.scores(make_docs(["мама мыла раму", "мими мыли рими", "раму мама мыла"]), terms, base).collect()}
    assert nats[0] < nats[2] < nats[1]


def test_a_small_languages_limits_are_drawn_to_all(spark, make_docs):
    docs, labels = sample(make_docs, spark)
    rows = {r.lang: r for r in quality.judge(docs, labels).collect()}
    few = make_docs(["the house and of water under green small " * 5], langs=["xx"], ids=[9])
    alone = quality.judge(docs.unionByName(few), labels).where("lang = 'xx'").first()
    assert rows["de"].low < alone.high and alone.low < alone.high and alone.keep
