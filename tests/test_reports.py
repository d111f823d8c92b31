from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tremolo.operators import cuts, receipts, reports, selective, stats
from tremolo.sources import readers, sinks

PAIRS = [(f"pair{i}", d, v) for i in (1, 2, 3) for d, v in (("corpus", i / 10), ("POOLED", None))]


def test_a_selector_names_every_key(spark):
    rows = spark.createDataFrame(PAIRS, "pair string, dataset string, value double")
    with pytest.raises(receipts.ReceiptError, match="dataset"):
        reports.selected(rows, {}, ["pair", "dataset"], ["pair"], 2)
    r = reports.selected(rows, {"dataset": "corpus"}, ["pair", "dataset"], ["pair"], 2).first()
    assert (r.pair, r.dataset, r.value) == ("pair2", "corpus", 0.2)
    assert reports.selected(rows, {"dataset": "corpus", "pair": "pair3"}, ["pair", "dataset"]).first().value == 0.3
    assert reports.selected(rows, {"dataset": "corpus"}, ["pair", "dataset"], ["pair"], 4).count() == 0
    for pins in ({"dataset": "corpus", "pair": "x"}, {"dataset": "corpus"}):
        with pytest.raises(receipts.ReceiptError):
            reports.selected(rows, pins, list(pins))
    assert {r.pair for r in reports.nth(rows, ["dataset"], ["pair"], 3).collect()} == {"pair3"}


def test_small_reports(spark):
    rows = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", None), ("b", 4.0), (None, 3.0)], "k string, v double")
    assert reports.column_mode(rows, [], "k").first().mode == "a" and reports.column_mode(rows.where("k is null"), [], "k").first().mode == "N/A"
    text = rows.select(F.when(F.col("v") > 2, "x").otherwise(F.col("v").cast("string")).alias("v"))
    assert {r["agg"]: r["value"] for r in reports.scope_values(text, "v").collect()} == {"sum_int": 3.0, "mean": 1.5, "rows": 5.0}
    order = [r.k for r in reports.in_order(rows, "k", ["b"]).collect()]
    assert order[:2] == ["b", "b"] and set(order[2:]) == {"a", None}
    flat = spark.range(1).select(reports.flat_answers(F.array(F.lit(" b"), F.lit("a"), F.lit(""), F.lit("b"))).alias("a")).first().a
    assert flat == ["b", "a"]
    ask = spark.range(1).select(reports.prompt(F.lit("q"), F.lit("")).alias("a"), reports.prompt(F.lit("q"), F.lit("c")).alias("b")).first()
    assert ask.a.endswith("Do not explain.\n\nQuestion: q\n\nAnswer:") and "Context: c\n\nQuestion: q\n\nAnswer:" in ask.b
    assert sinks.markdown(rows.where("k = 'a'").orderBy(F.col("v").desc())) == "| k | v   |\n|---|-----|\n| a | 2.0 |\n| a |     |"
    with pytest.raises(ValueError):
        sinks.markdown(rows, 2)
    control = reports.negative_controls(spark.createDataFrame([("m", 0.2), ("m", 0.0), ("n", 0.0), ("o", None)], "m string, h double"), "m", "h")
    assert {r.m: r.excluded for r in control.collect()} == {"m": True, "n": False, "o": False}


def test_exact_matches_fold_case(spark):
    queries = spark.createDataFrame([(1, " STRASSE "), (2, ""), (3, None), (4, "x")], "qid long, text string")
    forms = spark.createDataFrame([("straße", "C1"), ("Strasse", "C1"), ("strasse", "C2"), ("", "C3")], "form string, cui string")
    assert sorted(map(tuple, reports.exact_matches(queries, forms).collect())) == [(1, "C1"), (1, "C2")]


def test_files(spark, tmp_path):
    for name in ("a_corpus_pubtator.txt.gz", "MedMentions_st21pv.txt", "other.csv", "notes.txt"):
        (tmp_path / name).write_text("x,y\n1,2\n")
    found = [(r.path.rsplit("/", 1)[-1], r.score) for r in readers.discover(spark, str(tmp_path)).collect()]
    assert found == [("MedMentions_st21pv.txt", 6), ("a_corpus_pubtator.txt.gz", 6), ("notes.txt", 1)]
    assert readers.header(spark, str(tmp_path / "other.csv")) == ["x", "y"]
    times = reports.file_times(spark.read.text(str(tmp_path / "notes.txt"))).first()
    assert times.path.endswith("notes.txt") and times.modified is not None
    made = []
    for _ in range(2):
        table = readers.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3))
        assert table.count() == 3
    assert len(made) == 1
    with cuts.written(spark.range(4)) as rows:
        (path,) = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
        assert rows.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_first_lines_count_whatever_the_splits(spark, tmp_path):
    lines = [f"C{i % 3}|T{i}|A1|x|" for i in range(3000)]
    (tmp_path / "t.rrf").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        types = readers.rrf_types(spark, str(tmp_path / "t.rrf")).repartition(5)
        assert {r.cui: r.tui for r in readers.first_types(types, types.select("cui")).collect()} == {"C0": "T0", "C1": "T1", "C2": "T2"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ranks_of_different_values(spark):
    rows = spark.createDataFrame([("c", v) for v in (1.0, 2.0, 2.0, 3.0)], "cell string, v double")
    got = {r.v: (r._n, r._rank) for r in selective.distinct_ranks(rows, ["cell"], "v", {}).collect()}
    assert got == {1.0: (1, 1.0), 2.0: (2, 2.5), 3.0: (1, 4.0)}


def test_correlation_of_far_off_values(spark):
    rows = spark.range(100).select((F.lit(1e9) + F.col("id") / 1000).alias("x"), (F.lit(1e9) - F.col("id") / 1000).alias("y"), F.lit(1e9 + 0.1).alias("c")).repartition(7)
    r = rows.agg(stats.pearson_of(F.col("x"), F.col("y")).alias("r"), stats.pearson_of(F.col("x"), F.col("c")).alias("none")).first()
    assert r.r == pytest.approx(-1) and r.none is None
