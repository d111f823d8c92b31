"""The stream tells what a batch tells, with late, repeated and missing rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tremolo.operators.entropy import label_entropy
from tremolo.streaming import completion

SCHEMA = "instance_id string, model_name string, variant_id string, label string, n_expected long, ts timestamp"
DAY = dt.datetime(2024, 1, 1)


def test_entropies_by_hand():
    assert completion.entropies(["a", "a", "b", "b"]) == (1.0, 0.5) and completion.entropies(["a", "UNASSIGNED", None]) == (0.0, 0.0)
    assert completion.entropies([None, "nan"]) == (None, None) and completion.entropies(["a"]) == (0.0, None)


def test_stream_equals_batch(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    completion.configure(spark)
    draw, models, rows = random.Random(2), ["m1", "m2"], []
    for i in range(12):
        for m in models:
            for v in range(n := draw.randint(1, 5)):
                rows.append((f"i{i}", m, f"v{v}", draw.choice(["a", "b", "UNASSIGNED", None]), n, DAY + dt.timedelta(minutes=i)))
    # i3 never has m2, i5 lacks a variant of m1
    held = [r for r in rows if not (r[0] == "i3" and r[1] == "m2") and not (r[0] == "i5" and r[1] == "m1" and r[2] == "v0")]
    draw.shuffle(held)
    half = len(held) // 2
    later = DAY + dt.timedelta(days=5)
    batches = [held[:half], held[half:] + held[: half // 2], held[:5] + [("x", "m1", "v0", "a", 1, later)], [("x", "m2", "v0", "a", 1, later), ("i3", "m2", "v0", "a", 1, DAY), (None, "m1", "v", "a", 1, later)], [("y", "m1", "v0", "a", 1, later)]]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    try:
        for batch in batches:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            stream = completion.completed(spark.readStream.schema(SCHEMA).parquet(src), models, wait="6 hours", late="1 hour")
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.instance_id, r.model_name): r for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count() == 26
    whole = {r for r in got if got[r].status == "complete"}
    assert whole == {(f"i{i}", m) for i in range(12) if i not in (3, 5) for m in models} | {("x", m) for m in models}
    short = len([r for r in held if r[:2] == ("i5", "m1")])
    assert {k: got[k].status for k in got if k not in whole} == {("i3", "m1"): "partial", ("i3", "m2"): "missing", ("i5", "m1"): "missing", ("i5", "m2"): "partial"} and short < max(r[4] for r in rows if r[:2] == ("i5", "m1"))
    batch = label_entropy(spark.createDataFrame(rows, SCHEMA).withColumn("_ord", F.monotonically_increasing_id()), ["instance_id", "model_name"])
    for r in batch.collect():
        told = got[r.instance_id, r.model_name]
        if told.status != "missing":
            assert told.n_variants == r.n_variants
            assert (told.semantic_entropy, told.normalised_entropy) == (pytest.approx(r.semantic_entropy), pytest.approx(r.normalised_entropy)) if r.semantic_entropy is not None and r.normalised_entropy is not None else True
            assert (told.semantic_entropy is None) == (r.semantic_entropy is None)
