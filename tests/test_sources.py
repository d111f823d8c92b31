from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tremolo.sources import readers, sinks
from tremolo.streaming import counted_windows, new_rows, process_blocks


def test_missing_tokens_are_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,note\n1,NA\n2,null\n3,None\n4,nan\n5,""\n6,\n7,"two\nlines ""quoted"""\n')
    got = {r.id: r.note for r in readers.strict_csv(spark, str(tmp_path / "x.csv"), "id int, note string").collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {"NA", "null", "None", "nan"} and got[6] is None and got[7] == 'two\nlines "quoted"'


def test_names_and_types(spark, tmp_path):
    row = lambda cui, lat, sab, code, form, sup: "|".join([cui, lat, *[""] * 9, sab, "PT", code, form, "", sup, "", ""])
    (tmp_path / "n.rrf").write_text("\n".join([row("C1", "ENG", "SNOMEDCT_US", "11", "Heart", "N"), row("C2", "ENG", "SNOMEDCT_US", "11", "Other", "N"), row("C3", "SPA", "X", "1", "Corazón", "N"), row("C4", "ENG", "X", "1", "old", "O"), "short|row"]))
    names = readers.rrf_names(spark, str(tmp_path / "n.rrf"))
    assert [(r.cui, r.form) for r in names.orderBy("_ord").collect()] == [("C1", "Heart"), ("C2", "Other")]
    assert [tuple(r) for r in readers.code_map(names).collect()] == [("11", "C1")]
    (tmp_path / "t.rrf").write_text("C1|T047|B2.2|Disease|\nC1|T184|A2|Sign|\nC9|T1|A|X|\n")
    types = readers.rrf_types(spark, str(tmp_path / "t.rrf"))
    assert [tuple(r) for r in readers.first_types(types, names).collect()] == [("C1", "T047")]


def test_blocks_of_annotations(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1|t|Title\n1|a|Heart pain.\n1\t6\t11\tHeart\tT047\tUMLS:C1\n1\t12\t16\tpain\tT184\tC2\n\n2|t|Other\n2|a|\n2\tx\t3\tOth\tT1\tC3\n")
    got = [tuple(r) for r in readers.pubtator(spark, str(tmp_path / "p.txt")).orderBy("pmid", "start").collect()]
    assert got == [("1", "Title Heart pain.", 6, 11, "Heart", "T047", "C1"), ("1", "Title Heart pain.", 12, 16, "pain", "T184", "C2"), ("2", "Other ", None, 3, "Oth", "T1", "C3")]


def test_standoff_annotations(spark, tmp_path):
    (tmp_path / "d1.ann").write_text("T1\t22298006 0 5\theart\nT2\tCONCEPT_LESS 6 9\tbad\nT3\t22298006 0 5;8 9\tsplit\nT4\tbroken\nR1\tother\n")
    got = {r.ann_id: (r.doc_id, r.status, r.start, r.end) for r in readers.standoff(spark, str(tmp_path)).collect()}
    assert got == {"T1": ("d1", "ok", 0, 5), "T2": ("d1", "concept_less", 6, 9), "T3": ("d1", "discontinuous", 0, 9), "T4": ("d1", "malformed", None, None)}


def test_zipped_questions(spark, tmp_path):
    questions = [{"id": "1", "body": "a?", "type": "factoid", "exact_answer": [["x", "y"], ["z"]]}, {"id": "2", "body": "b?", "type": "factoid", "exact_answer": "w"}, {"id": "3", "body": "c?", "type": "list", "exact_answer": ["v"]}]
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("folder/training.json", json.dumps({"questions": questions}))
    got = {r.id: r.answers for r in readers.zipped_questions(spark, str(tmp_path / "q.zip"), "training.json").collect()}
    assert got == {"1": ["x", "y", "z"], "2": ["w"]}


def test_texts_and_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "*.txt")).collect()] == [("a", "one\ntwo")]
    row = readers.candidate_labels(spark.createDataFrame([("UMLS:C1||Heart",)], "l string"), "l").first()
    assert (row.cui, row["name"]) == ("C1", "Heart")
    cell = spark.createDataFrame([("{'text': array(['one', \"it's\"]), 'answer_start': array([1, 2])}",)], "c string")
    assert cell.select(readers.quoted_answers("c").alias("a")).first().a == ["one", "it's"]


def test_sinks(spark, tmp_path):
    where = str(tmp_path / "t")
    sinks.write_new(spark.range(3), where)
    with pytest.raises(AnalysisException):
        sinks.write_new(spark.range(3), where)
    where = str(tmp_path / "versions")
    sinks.replace(spark.range(5), where)
    held = sinks.current(spark, where)
    sinks.replace(spark.range(6), where)
    # who reads the old version still can
    assert held.count() == 5 and sinks.current(spark, where).count() == 6
    sinks.replace(held, where)
    assert sinks.current(spark, where).count() == 5 and len(list((tmp_path / "versions").glob("v-*"))) == 2
    sinks.write_receipt(spark, str(tmp_path / "r.json"), {"b": 1})
    sinks.write_receipt(spark, str(tmp_path / "r.json"), {"b": 2})
    assert json.loads((tmp_path / "r.json").read_text()) == {"b": 2}
    assert sinks.redacted(spark.createDataFrame([(1, "x")], "k int, text string"), ["text"]).columns == ["k"]
    assert len(sinks.file_hashes(spark, str(tmp_path / "r.json")).first().sha256) == 64


def test_append_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 0), (2, "d", 1), (3, "e", 2)], "k int, v string, o int")
    assert {r.k: r.v for r in sinks.append_last(old, new, ["k"], "o").collect()} == {1: "a", 2: "d", 3: "e"}


def test_incremental_blocks(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(0, 10).write.parquet(src)
    run = lambda: process_blocks(spark.readStream.schema("id long").parquet(src), out, ck, ["id"], lambda b: b.withColumn("v", F.col("id") * 2)).awaitTermination()
    run()
    spark.range(5, 15).write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))
    assert new_rows(spark.range(4), spark.range(2), ["id"]).count() == 2


def test_windows_close_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.sql("select timestamp'2024-01-01 01:00:00' as ts, 'a' as k union all select timestamp'2024-01-03 00:00:00', 'a'").write.parquet(src)
    stream = counted_windows(spark.readStream.schema("ts timestamp, k string").parquet(src), "ts", ["k"])
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("closed").collect()] == [1]
