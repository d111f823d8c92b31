from __future__ import annotations

from pyspark.sql import functions as F

from tremolo.operators import inference


def test_staged_gates(spark):
    mat = "the cat sat on the mat"
    rows = spark.createDataFrame(
        [("v1", "i", mat, "the cat sat on a big mat"), ("v2", "i", mat, "THE CAT sat on a big mat"), ("v3", "j", mat, "THE cat sat on a big mat"), ("v4", "i", mat, "the cat did not sit on the mat"), ("v5", "i", mat, mat), ("v6", "i", mat, "the cat lay on the mat")],
        "variant_id string, instance_id string, original string, text string",
    )
    grammar = spark.createDataFrame([("v1", 0.2), ("v2", 0.9), ("v3", 0.9), ("v6", 0.2)], "variant_id string, value double")
    keep = lambda **k: sorted(r.variant_id for r in inference.staged_gates(rows, "original", "text", **k).collect())
    assert keep() == ["v1", "v3", "v6"]
    # the first of two equal texts fails a gate: the second is no copy of an accepted one; another instance has its own
    assert keep(grammar=grammar) == ["v2", "v3"]
    assert keep(contradiction=grammar.where("variant_id = 'v6'")) == ["v6"]


def test_edit_gate_stops_early(spark):
    from tremolo.functions import scalar

    rows = spark.createDataFrame([("abcdefghij", "abcdefghij"), ("abcdefghij", "abcdXXXXXX"), ("abcdefghij", "abcXXXXXXX"), ("", ""), ("abcdefghij", "abcdefghiX"), ("é" * 40, "é" * 39 + "x"), ("é" * 40, "é" * 38 + "xx")], "a string, b string")
    assert [r.ok for r in rows.select(scalar.edit_gate(F.col("a"), F.col("b")).alias("ok")).collect()] == [False, True, False, False, True, False, True]


def test_surrounding_sentence(spark):
    text = "First. The drug hurt me a lot! Then more.\nOther line"
    cut = lambda a, b: spark.range(1).select(inference.surrounding_sentence(F.lit(text), F.lit(a), F.lit(b)).alias("v")).first().v
    at = text.index("drug")
    assert cut(at, at + 4) == "The drug hurt me a lot!" and cut(at, 99) == "The drug hurt me a lot! Then more. Other line"
    assert cut(0, 6) == "First." and cut(7, 7) == "The drug hurt me a lot!"
    assert cut(at, at + 4) == "The drug hurt me a lot!" and cut(text.index("Other"), text.index("Other") + 5) == "Other line"


def test_names_and_eligibility(spark):
    rows = spark.createDataFrame([("a", "long enough context here", "xy"), ("b", "short", "x"), ("a", " " * 30, "xy")], "m string, c string, t string")
    assert sorted(r.m for r in inference.named(rows, "m", {"a": "z"}, "other").collect()) == ["other", "z", "z"]
    assert inference.eligible(rows, "c", "t").count() == 1 and inference.eligible(rows, "c", "t", 5, 1).count() == 2
