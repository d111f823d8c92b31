"""Small document tables with every odd case."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, langs=None, ids=None, more=""):
    rows = [((i if ids is None else ids[i]), t, ("en" if langs is None else langs[i]), ("s" if sources is None else sources[i]), (None if t is None else len(t))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda *a, **k: documents(spark, *a, **k)


#: Null, empty, white alone, one word, many lines, non-ASCII, special strings, no blanks, and long texts.
ODD = [None, "", " \t\n", "word", "Two  words\n\nand\tmore.", "Straße naïve ÉCOLE — 中文字 😀 ｆｕｌｌ", "x <|endoftext|> y </s> <s>", "a" * 5000, "lorem ipsum dolor sit amet " * 3000, "Don't STOP!!! it's 3.14, (ok)?"]
