"""Completion as state: an instance's entropies as soon as all its models have answered, or when its time is up."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import NA_LABELS
from ..params import UNASSIGNED

RESULT = "instance_id string, model_name string, status string, n_variants long, semantic_entropy double, normalised_entropy double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def entropies(labels: list[str | None]) -> tuple[float | None, float | None]:
    """Entropy of assigned labels in bits, and over log2 of all labels, as label_entropy has them."""
    counts = Counter(x for x in labels if x != UNASSIGNED and (x or "").lower() not in NA_LABELS)
    n = sum(counts.values())
    if not n:
        return None, None
    h = 0.0 if len(counts) == 1 else math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n
    return h, h / math.log2(len(labels)) if len(labels) > 1 else None


class Completion(StatefulProcessor):
    """State of an instance: the label of each variant of each model, and whether it has been told.

    A model is complete when it has as many variants as its rows say. When all ``models`` are, a row a model comes out; if that doesn't
    happen within ``wait_ms`` of event time after the instance's first row, those that are complete come out, and the others as missing.
    A variant that comes again changes nothing. What comes for an instance that has been told is dropped, until its time is up; then its
    state goes.
    """

    def __init__(self, models: list[str], wait_ms: int):
        self.models, self.wait_ms = models, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.labels = handle.getMapState("labels", "model string, variant string", "label string")
        self.expected = handle.getMapState("expected", "model string", "n long")
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, first = self.told.exists(), None
        for part in rows:
            if told:
                continue
            for model, variant, label, n, at in part[["model_name", "variant_id", "label", "n_expected", "ts"]].itertuples(index=False):
                first = at if first is None else min(first, at)
                if model in self.models and not self.labels.containsKey((model, variant)):
                    self.labels.updateValue((model, variant), (None if pd.isna(label) else label,))
                    self.expected.updateValue((model,), (int(n),))
        if told:
            return
        if not list(self.handle.listTimers()) and first is not None:
            self.handle.registerTimer(int(first.value // 1_000_000) + self.wait_ms)
        found = self.found()
        if all(m in found for m in self.models):
            self.told.update((True,))
            self.labels.clear()
            self.expected.clear()
            yield self.result(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told, found = self.told.exists(), self.found()
        self.labels.clear()
        self.expected.clear()
        self.told.clear()
        if not told:
            yield self.result(key, found)

    def found(self) -> dict[str, list[str | None]]:
        """The labels of the models that are complete."""
        held: dict[str, list[str | None]] = {}
        for (model, _), (label,) in self.labels.iterator():
            held.setdefault(model, []).append(label)
        expected = {model: n for (model,), (n,) in self.expected.iterator()}
        return {m: x for m, x in held.items() if len(x) >= expected[m]}

    def result(self, key, found: dict[str, list[str | None]]) -> pd.DataFrame:
        whole = all(m in found for m in self.models)
        out = [(key[0], m, ("complete" if whole else "partial") if m in found else "missing", len(found.get(m, [])), *(entropies(found[m]) if m in found else (None, None))) for m in self.models]
        frame = pd.DataFrame(out, columns=["instance_id", "model_name", "status", "n_variants", "semantic_entropy", "normalised_entropy"])
        return frame.astype({"semantic_entropy": "float64", "normalised_entropy": "float64"})

    def close(self) -> None:
        pass


def configure(spark: SparkSession) -> None:
    """State of this kind is kept by RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def completed(stream: DataFrame, models: list[str], wait: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(instance_id, model_name, status, n_variants, semantic_entropy, normalised_entropy) from a stream of (instance_id, model_name,
    variant_id, label, n_expected, ts). Rows without an instance, model, variant or time are dropped; those ``late`` behind the newest
    time too. status is complete, partial (others of the instance are missing) or missing."""
    used = stream.select(F.col("instance_id").cast("string").alias("instance_id"), "model_name", F.col("variant_id").cast("string").alias("variant_id"), "label", F.col("n_expected").cast("long").alias("n_expected"), "ts")
    used = used.dropna(subset=["instance_id", "model_name", "variant_id", "n_expected", "ts"]).withWatermark("ts", late)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    made = used.groupBy("instance_id").transformWithStateInPandas(Completion(models, wait_ms), RESULT, "Append", "EventTime")
    nan = lambda c: F.nanvl(F.col(c), F.lit(None)).alias(c)
    return made.select("instance_id", "model_name", "status", "n_variants", nan("semantic_entropy"), nan("normalised_entropy"))
