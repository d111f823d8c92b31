from __future__ import annotations

import hashlib
import random
import re

import pytest

from tremolo.llm import common, personal_data

from .conftest import ODD

#: The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(len(p) < 4 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in match.split(".")))
    if kind == "card":
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m[0])]


def found(spark, make_docs, texts, **how):
    rows = personal_data.find(make_docs(texts), **how).orderBy("doc_id").collect()
    return [[(s.kind, s.start, s.end, s.score) for s in r.spans] for r in rows]


def base(spans):
    return [f"{k}:{a}:{b}" for k, a, b, _ in spans if k in PATTERNS]


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_against_brute_force(spark, sf, size):
    sf = sf.replace("sf0.001", f"sf{size}")
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = personal_data.op13_personal_data(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        # on these texts the method adds nothing
        assert r.spans == ",".join(want)


def test_random_texts(spark, make_docs):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["1", "2", "25", "255", "256", ".", ".", "-", " ", "+", "(", ")", "@", "@", "a", "b.c", "_", "é", "😀", "\n", "4111111111111111"]) for _ in range(draw.randint(0, 60))) for _ in range(800)]
    texts += ["a@b.c_x@d.e", "a@b.c.d@e.f", "x@y@z.w", "1.2.3.4.5.6.7.8", "0001.02.3.255", "1.2.3.256", "+1 (921) 555-8394)", "a.@b-.c-", "@a.b", "a@b", "4111 1111-1111 1111 1"]
    for spans, text in zip(found(spark, make_docs, texts), texts, strict=True):
        assert base(spans) == brute(text), text


IBANS = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947"]


def test_added_kinds(spark, make_docs):
    texts = [*(f"My IBAN: {i}, thanks." for i in IBANS), "IBAN DE89 3704 0044 0532 0130 01", "DE89370400440532013000AB", "her SSN is 123-45-6789.", "SSN 000-45-6789 or 123-45-67890", "order number 123-45-6789",
             "Telefon: 030 1234567 heute", "call (921) 555-8394 now", "the sum 030 1234567 of", "phone +1 (921) 555-8394 here", "tel 2024-01-15"]
    got = [[(k, t[a:b]) for k, a, b, _ in spans if k in personal_data.ADDED] for spans, t in zip(found(spark, make_docs, texts), texts, strict=True)]
    want = [*([("iban", i)] for i in IBANS), [], [], [("ssn", "123-45-6789")], [], [], [("local_phone", "030 1234567")], [("local_phone", "(921) 555-8394")], [], [], []]
    assert got == want


def test_words_nearby_move_scores(spark, make_docs):
    texts = ["x 4111111111111111 y", "credit card 4111111111111111 y", "order 4111111111111111 y", "discard 4111111111111111 y", "10.0.0.1 is version 10.0.0.1"]
    scores = [[s for *_, s in spans] for spans in found(spark, make_docs, texts)]
    assert scores == [[0.7], [1.0], [0.4], [0.7], [0.2, 0.2]]
    assert found(spark, make_docs, ["ssn 123-45-6789 a@b.c"], threshold=0.9, kinds=("email", "ssn")) == [[("email", 16, 21, 0.7)]]


def test_odd_rows(spark, make_docs):
    texts = [*ODD, "a@b.de", "a@b.de"]
    docs = make_docs(texts, ids=[*range(9), None, 4, 4]).withColumnRenamed("source", "spans").withColumnRenamed("lang", "kind")
    got = personal_data.find(docs).collect()
    assert len(got) == len(texts) and sum(r.doc_id is None for r in got) == 1
    assert sorted(len(r.spans) for r in got) == [0] * len(ODD) + [1, 1]
    assert personal_data.find(make_docs([])).count() == 0


def test_many_matches_and_runs_without_end(spark, make_docs):
    many = "😀 x@y.zz, 10.0.0.1; " * 12000
    texts = [many, "a" * 300_000, "1" * 300_000, "a.b@" * 60_000, "1." * 150_000 + "x", "+1(" * 90_000, "1 " * 150_000, "A1" * 150_000, "0" * 300_000 + ".1.1.1", "a@b" + ".c" * 100_000]
    got = found(spark, make_docs, texts)
    assert len(got[0]) == 24000 and base(got[0]) == brute(many)
    assert base(got[5]) == [] and [x for x in base(got[4]) if x[:2] == "ip"] == [f"ip:{8 * i}:{8 * i + 7}" for i in range(37500)] and base(got[8]) == ["ip:0:300006"] and base(got[9]) == ["email:0:200003"]


def test_only_dataframe_operations_and_no_shuffle(spark, sf):
    plan = personal_data.op13_personal_data(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
