from __future__ import annotations

import math
import textwrap
from collections import Counter

from tremolo.llm import licences

from .conftest import ODD


def files(spark, rows):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")


def brute(text, templates, n, df):
    """The nearest template of any segment by the definition, without the prefilter."""
    made = licences.Matcher(templates, n, df)
    made.telling = set(made.idf)
    return made.scan(text)


def test_cosine_by_hand():
    templates = (("A", "alpha beta"), ("B", "alpha gamma"))
    made = licences.Matcher(templates, 10, {b"alpha": 9, b"beta": 0, b"gamma": 0})
    idf = lambda d: math.log(11 / (1 + d)) + 1
    a, b = idf(9), idf(0)
    got, name = made.nearest([b"alpha", b"beta"])
    assert name == "A" and abs(got - 1) < 1e-12
    other = (a + 2 * b) / 3
    got, _ = made.nearest([b"beta", b"zzz"])
    assert abs(got - b * b / (math.hypot(a, b) * math.hypot(b, other))) < 1e-12


def test_prefilter_loses_nothing():
    texts = [t or "" for t in ODD] + [t for _, t in licences.TEMPLATES] + ["the of this may be with\n" * 5 + t for _, t in licences.TEMPLATES] + ["license the work", "all rights", "public domain software is free"]
    df = Counter(w for t in texts for w in set(licences.words_of(t)))
    made = licences.Matcher(licences.TEMPLATES, len(texts), df)
    for text in texts:
        assert made.scan(text) == brute(text, licences.TEMPLATES, len(texts), df)


def test_headers_files_and_inheritance(spark):
    prose = "some words that say nothing at all about anything. " * 5
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.txt", prose), ("a/b/y.txt", prose), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/z.txt", prose),
        ("a/b/own.txt", prose + "\nAll rights reserved.\n" + prose), ("q/none.txt", prose), ("ab/none.txt", None), (None, prose),
    ]
    got = {r.path: (r.licence, r.kind, r.licence_dir) for r in licences.scan_licences(files(spark, rows).withColumn("kind", __import__("pyspark").sql.functions.lit(1))).collect()}
    assert got["a/LICENSE"] == ("MIT", "file", None)
    assert got["a/x.txt"] == got["a/b/y.txt"] == ("MIT", "inherited", "a")
    assert got["a/b/c/d/z.txt"] == ("Apache-2.0", "inherited", "a/b/c")
    assert got["a/b/own.txt"] == ("LicenseRef-proprietary", "header", None)
    assert got["q/none.txt"] == got["ab/none.txt"] == got[""] == (None, None, None)


def test_root_licence_covers_all(spark):
    got = {r.path: r.licence for r in licences.scan_licences(files(spark, [("LICENSE", "Licensed under CC BY-NC 4.0."), ("a/b", "x"), ("a/b", "x"), (None, "y")])).collect()}
    assert got == {"LICENSE": "CC-BY-NC-4.0", "a/b": "CC-BY-NC-4.0", "": "CC-BY-NC-4.0"}


def test_query_inherits_on_the_real_table(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    got = [r.asDict() for r in licences.op5_licences(spark, sf).collect()]
    assert len(got) == 10_000
    held: dict[str, list] = {}
    for r in got:
        if r["kind"] == "file":
            held.setdefault(r["path"].rpartition("/")[0], []).append((-r["cosine"], r["licence"], r["path"]))
    inherited = 0
    for r in got:
        if r["kind"] in ("file", "header"):
            assert r["licence_dir"] is None
            continue
        folder = r["path"].rpartition("/")[0]
        while folder not in held and folder:
            folder = folder.rpartition("/")[0]
        if folder in held:
            inherited += 1
            assert (r["kind"], r["licence"], r["licence_dir"]) == ("inherited", min(held[folder])[1], folder)
        else:
            assert (r["kind"], r["licence"], r["licence_dir"]) == (None, None, None)
    assert len(held) >= 10 and inherited >= 50
    # folders beyond what is broadcast are shuffled, hot ones told: the same rows
    monkeypatch.setattr(licences, "BROADCAST_DIRS", 3)
    key = lambda r: tuple(map(str, r))
    few = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 3000")
    small = sorted(licences.scan_licences(licences.laid_out(few)).collect(), key=key)
    monkeypatch.undo()
    assert small == sorted(licences.scan_licences(licences.laid_out(few)).collect(), key=key)


def test_odd_and_no_files(spark):
    assert licences.scan_licences(files(spark, [(f"p/{i}", t) for i, t in enumerate(ODD)])).count() == len(ODD)
    assert licences.scan_licences(files(spark, [])).count() == 0


def test_full_licence_texts_are_files_and_inherited(spark):
    texts = dict(licences.full_texts())
    rows = [x for name, text in texts.items() for x in ((f"{name}/LICENSE", text), (f"{name}/x.txt", "nothing said"))]
    got = {r.path: (r.licence, r.kind) for r in licences.scan_licences(files(spark, rows)).collect()}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "BSD-3-Clause", "MPL-2.0", "CC0-1.0"} <= set(texts)
    for name in texts:
        assert got[f"{name}/LICENSE"] == (name, "file") and got[f"{name}/x.txt"] == (name, "inherited")


def test_wrapped_headers_in_comments():
    made = licences.Matcher(licences.TEMPLATES, 1000, {})
    code = "\n".join(f"value{i} = compute(thing{i}, other{i})" for i in range(60))
    for name in ("MIT", "GPL-3.0-or-later", "LGPL-3.0-or-later", "ISC", "BSD-3-Clause"):
        text = max((t for n, t in licences.TEMPLATES if n == name), key=len)
        for mark in ("# ", "// ", " * ", "dnl "):
            header = "\n".join(mark + line for line in textwrap.wrap(text, 50))
            for whole in (f"{header}\n{code}", f"{mark}Copyright 2020 A. Body. All rights reserved.\n{header}\n{code}"):
                got = made.scan(whole)
                assert got[0] == name and got[2] == "header", (name, mark, got)


def test_reserved_rights_alone_still_count():
    made = licences.Matcher(licences.TEMPLATES, 1000, {})
    prose = "some words that say nothing at all about anything. " * 20
    assert made.scan(f"{prose}\nAll rights reserved.\n{prose}")[0] == licences.RESERVED
    assert made.scan(f"{prose}\nAll rights reserved.\nLicensed under the Apache License, Version 2.0.\n{prose}")[0] == "Apache-2.0"


def test_bounds_lose_no_run():
    made = licences.Matcher(licences.NOTICES, 1000, {})
    text = "\n".join(textwrap.wrap(" ".join(t for _, t in licences.NOTICES), 40))
    lines = [licences.words_of(x) for x in text.split("\n")]
    words, offsets = [w for x in lines for w in x], [0]
    for x in lines:
        offsets.append(offsets[-1] + len(x))
    want = set()
    for k, (_, vector) in enumerate(made.vectors):
        for a in range(len(lines)):
            above = next((b for b in range(a + 1, len(lines)) if offsets[b] - offsets[a] >= made.sizes[k]), len(lines))
            for b in {above, above - 1} - {a}:
                own = made.vector(words[offsets[a] : offsets[b]])
                if sum(x * own.get(w, 0) for w, x in vector.items()) >= made.least:
                    want.add((k, offsets[a], offsets[b]))
    got = made.runs(words, licences.np.array(offsets), list(range(len(made.vectors))))
    assert want and {(k, a, b) for _, k, a, b in got} == want
