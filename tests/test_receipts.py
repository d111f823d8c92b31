from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tremolo.operators import receipts

COLUMNS = ["part", "instance_id", "model_name", "output_text", "predicted_cui", "assign_rule_path"]


def corpus(spark, change=None):
    """200 instances in blocks of ten, two models, three parts; and one mutation."""
    part = lambda b: "A1" if 6 <= b <= 12 else "A2" if 13 <= b <= 18 else "B"
    rows = [{"part": part(i // 10), "instance_id": f"i{i:04d}", "model_name": m, "output_text": "x", "predicted_cui": "C1", "assign_rule_path": "exact_match+st21pv"} for i in range(200) for m in ("m1", "m2")]
    expected = {"A1": 140, "A2": 120, "B": 140}
    own = {p: (0, 10) for p in expected}
    if change:
        change(rows, expected, own)
    frame = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], ", ".join(f"{c} string" for c in COLUMNS))
    instances = spark.createDataFrame([(f"i{i:04d}", i) for i in range(200)], "instance_id string, ordinal long")
    tables = spark.createDataFrame(list(expected.items()), "part string, n_rows long"), spark.createDataFrame([(p, *x) for p, x in own.items()], "part string, violations int, evaluated int")
    return receipts.concat_receipts(frame, instances, *tables, COLUMNS, 10)


def failed(found):
    return {r.receipt for r in found.where("not ok").collect()}


def drop_block(rows, expected, own):
    rows[:] = [r for r in rows if not 180 <= int(r["instance_id"][1:]) < 190]
    expected["A2"] = 100


def swap_parts(rows, expected, own):
    rows[120]["part"], expected["A1"], expected["B"] = "B", 139, 141


def unknown_instance(rows, expected, own):
    rows[0]["instance_id"] = "zzz"


def wrong_count(rows, expected, own):
    expected["A1"] = 141


def parts_wrong_total_right(rows, expected, own):
    expected.update(A1=141, A2=119)


def unknown_part(rows, expected, own):
    for r in rows:
        r["part"] = "X" if r["part"] == "A2" else r["part"]
    own["X"] = (0, 5)


def injected(rows, expected, own):
    rows[3]["assign_rule_path"] = "exact_match_inject+st21pv"


def no_receipt(rows, expected, own):
    del own["B"]


def violations(rows, expected, own):
    own["B"] = (3, 10)


def nothing_evaluated(rows, expected, own):
    own["B"] = (0, 0)


def blank_assigned(rows, expected, own):
    rows[5]["output_text"] = "\t \n"


def test_good_corpus(spark):
    found = corpus(spark)
    assert found.count() == 8 and failed(found) == set()
    receipts.assert_receipts(found)


@pytest.mark.parametrize(
    "change,what",
    [(drop_block, "R1"), (swap_parts, "R1b"), (unknown_instance, "R2"), (wrong_count, "R3"), (parts_wrong_total_right, "R3"), (unknown_part, "R3"), (injected, "R4"), (no_receipt, "R5"), (violations, "R5"), (nothing_evaluated, "R5"), (blank_assigned, "R6")],
)
def test_each_fault_fails_its_own_receipt(spark, change, what):
    found = corpus(spark, change)
    assert failed(found) == {what}
    with pytest.raises(receipts.ReceiptError, match=what):
        receipts.assert_receipts(found)


def test_extra_column(spark):
    frame = spark.createDataFrame([("p", "i", 1)], "part string, instance_id string, extra int").withColumns({c: F.lit("x") for c in COLUMNS[2:]})
    none = spark.createDataFrame([], "part string, n_rows long"), spark.createDataFrame([], "part string, violations int, evaluated int")
    assert "R0" in failed(receipts.concat_receipts(frame, spark.createDataFrame([("i", 0)], "instance_id string, ordinal long"), *none, COLUMNS))


def test_joins_that_must_not_multiply_or_miss(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(receipts.ReceiptError):
        receipts.join_unique(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"])
    with pytest.raises(receipts.ReceiptError):
        receipts.join_total(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], "v")


def test_row_count_receipt(spark):
    rows, seen = receipts.counted(spark.range(7), "n")
    rows.collect()
    receipts.assert_rows(seen, 7)
    with pytest.raises(receipts.ReceiptError):
        receipts.assert_rows(seen, 8)


def test_nulls_are_equal_and_small_differences_none(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, "x", 1.0), (3, None, None)], "k int, s string, d double")
    b = spark.createDataFrame([(1, None, 1.0 + 1e-12), (2, "y", 2.0), (3, "z", 5.0)], "k int, s string, d double")
    assert {r.k: r.changed for r in receipts.changed_rows(a, b, ["k"], ["s", "d"]).collect()} == {2: "s,d", 3: "s,d"}
