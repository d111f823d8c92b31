"""Data-quality receipts: invariants as DataFrames of one row a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, UNASSIGNED

#: Texts that some readers take for a missing value.
NA_TOKENS = ("NA", "N/A", "n/a", "NULL", "null", "None", "NaN", "nan", "-nan", "<NA>", "#N/A", "#N/A N/A", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "NAN", "None.")


class ReceiptError(AssertionError):
    """An invariant doesn't hold."""


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows that are counted as they are first written or collected: no job of its own (RCP-01)."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("n")), seen


def assert_rows(seen: Observation, expected: int) -> None:
    if (n := seen.get["n"]) != expected:
        raise ReceiptError(f"{n} rows, not {expected}")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).count().where("count > 1")


def join_unique(left: DataFrame, right: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """A join that must not multiply rows: keys are unique on the right (JOI-02)."""
    if (bad := duplicate_keys(right, key).limit(1).collect()):
        raise ReceiptError(f"key {bad[0].asDict()} is not unique")
    return left.join(right, key, how)


def join_total(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """A lookup that must find every key (JOI-11)."""
    joined = join_unique(left, right, key)
    if (bad := joined.where(F.col(value).isNull()).limit(1).collect()):
        raise ReceiptError(f"no {value} for {bad[0].asDict()}")
    return joined


def key_differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that one side alone has (JOI-06, SET-03)."""
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def changed_rows(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of which a column differs beyond the tolerance; two nulls are equal (FLT-16, JOI-05)."""
    kinds = dict(a.dtypes)
    left = a.select(*key, *[F.col(c).alias(f"{c}_b") for c in columns])
    right = b.select(*key, *[F.col(c).alias(f"{c}_a") for c in columns])

    def differs(c: str) -> Column:
        x, y = F.col(f"{c}_b"), F.col(f"{c}_a")
        return ~x.eqNullSafe(y) & (F.coalesce(F.abs(x - y) > tolerance, F.lit(True)) if kinds[c] in ("double", "float") else F.lit(True))

    joined = left.join(right, key)
    bad = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in columns]))
    return joined.withColumn("changed", F.array_join(bad, ",")).where("changed != ''")


def concat_receipts(parts: DataFrame, instances: DataFrame, expected: DataFrame, receipts: DataFrame, columns: list[str], block_size: int = DEFAULT.block_size) -> DataFrame:
    """Receipts of parts that are to be one corpus: (receipt, ok, detail), a row a check (RCP-02).

    parts: the rows, with ``part``; instances: (instance_id, ordinal); expected: (part, n_rows); receipts: (part, violations,
    evaluated). R0 the columns; R1 all blocks are there; R1b no block is in two parts; R2 no unknown instance; R3 each part has
    its rows, and every part is known; R4 no injected match; R5 each part's own receipt passed; R6 no blank output is assigned.
    """
    from ..functions.scalar import is_blank

    spark = parts.sparkSession
    shape = spark.range(1).select(F.lit("R0").alias("receipt"), F.lit(sorted(parts.columns) == sorted(columns)).alias("ok"), F.lit(",".join(sorted(set(parts.columns) ^ set(columns)))).alias("detail"))
    blocks = instances.select("instance_id", F.floor(F.col("ordinal") / block_size).alias("block"))
    placed = parts.select("part", "instance_id", *[c for c in ("assign_rule_path", "output_text", "predicted_cui") if c in parts.columns]).join(blocks, "instance_id", "left")
    held = placed.where("block is not null").groupBy("block").agg(F.count_distinct("part").alias("n_parts"))
    want = blocks.select("block").distinct()

    def line(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.lit(name).alias("receipt"), (F.count("*") == 0).alias("ok"), F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("detail"))

    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    per_part = sizes.join(expected, "part", "full").where(~F.col("n").eqNullSafe(F.col("n_rows")))
    judged = sizes.join(receipts, "part", "left").where(F.coalesce((F.col("violations") > 0) | (F.col("evaluated") <= 0), F.lit(True)))
    out = shape.unionByName(line("R1", want.join(held, "block", "left_anti"))).unionByName(line("R1b", held.where("n_parts > 1"))).unionByName(line("R2", placed.where("block is null"))).unionByName(line("R3", per_part))
    out = out.unionByName(line("R4", placed.where(F.col("assign_rule_path").startswith("exact_match_inject")))).unionByName(line("R5", judged))
    return out.unionByName(line("R6", placed.where(is_blank(F.col("output_text")) & (F.coalesce("predicted_cui", F.lit(UNASSIGNED)) != UNASSIGNED))))


def assert_receipts(receipts: DataFrame) -> None:
    if bad := receipts.where("not ok").orderBy("receipt").collect():
        raise ReceiptError("; ".join(f"{r['receipt']}: {r['detail']}" for r in bad))


def block_completeness(rows: DataFrame, instances: DataFrame, n_models: int, block_size: int = DEFAULT.block_size) -> DataFrame:
    """Per block its instances, those that a model misses, and whether all models have all (RCP-03, RCP-05, AGG-21)."""
    blocks = instances.select("instance_id", F.floor(F.col("ordinal") / block_size).alias("block"))
    seen = rows.select("instance_id", "model_name").distinct().groupBy("instance_id").agg(F.count("*").alias("models"))
    joined = blocks.join(seen, "instance_id", "left").withColumn("models", F.coalesce("models", F.lit(0)))
    made = joined.groupBy("block").agg(F.count("*").alias("n_instances"), F.count_if(F.col("models") == n_models).alias("n_complete"), F.count_if((F.col("models") > 0) & (F.col("models") < n_models)).alias("n_partial"))
    return made.withColumn("complete", F.col("n_complete") == F.col("n_instances"))


def na_sweep(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Cells per column that hold a token which some reader would take for missing (RCP-07)."""
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.count_if(F.col("value").isin(*NA_TOKENS)).alias("n_na_tokens"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count("*").alias("n"))


def stale(artefacts: DataFrame, edges: DataFrame, slack_s: float = 1.0) -> DataFrame:
    """Artefacts that are older than one of their inputs (RCP-06). artefacts: (name, modified); edges: (child, parent)."""
    parents = edges.join(artefacts.select(F.col("name").alias("parent"), F.col("modified").alias("_p")), "parent").groupBy("child").agg(F.max("_p").alias("newest_input"))
    joined = artefacts.join(parents, artefacts["name"] == parents["child"], "left").drop("child")
    late = F.col("newest_input").cast("double") > F.col("modified").cast("double") + slack_s
    return joined.withColumn("stale", F.coalesce(late, F.lit(False)))


def key_mode(rows: DataFrame, own: DataFrame, instance: str, variant: str, least: float = 0.99) -> DataFrame:
    """The share of variants whose id is the instance's own, and what that says of the keys (RCP-09)."""
    ids = own.select(instance, variant).distinct().withColumn("_own", F.lit(1))
    made = rows.join(ids, [instance, variant], "left").agg(F.count("*").alias("n"), F.count("_own").alias("n_own"))
    return made.withColumn("share", F.try_divide("n_own", "n")).withColumn("mode", F.when(F.col("share") >= least, "direct").otherwise("positional"))


def identical_means(rows: DataFrame, group: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Pairs of groups with the same mean, the sign of a column joined wrongly (RCP-10)."""
    means = rows.groupBy(group).agg(F.avg(value).alias("mean"))
    a, b = means.select(F.col(group).alias("first"), F.col("mean").alias("_a")), means.select(F.col(group).alias("second"), F.col("mean").alias("_b"))
    return a.join(b, (F.col("first") < F.col("second")) & (F.abs(F.col("_a") - F.col("_b")) <= tolerance)).select("first", "second", F.col("_a").alias("mean"))


def ledger(draft: DataFrame, computed: DataFrame, key: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Drafted against computed values (RCP-13)."""
    joined = draft.select(*key, F.col("value").alias("draft")).join(computed.select(*key, F.col("value").alias("computed")), key, "full")
    return joined.withColumn("ok", F.coalesce(F.abs(F.col("draft") - F.col("computed")) <= tolerance, F.lit(False)))


def curve_ledger(curve: DataFrame, stored: DataFrame, key: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Areas as stored against those of a stored curve (coverage, risk), by trapezoids: (key, draft, computed, ok) (RCP-13)."""
    from .selective import aurc

    return ledger(stored, aurc(curve, key).withColumnRenamed("aurc", "value"), key, tolerance)


def order_flips(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """How often a value falls along an order (WIN-10)."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_f", F.col(value) < before).groupBy(*by).agg(F.count("*").alias("n"), F.count_if("_f").alias("n_flips"))


def variants_per_instance(rows: DataFrame, instance: str, low: float = 1.5, high: float = 9.0) -> DataFrame:
    """Rows an instance, and whether that is in bounds (RCP-04)."""
    made = rows.agg(F.count("*").alias("n_rows"), F.count_distinct(instance).alias("n_instances"))
    return made.withColumn("ratio", F.try_divide("n_rows", "n_instances")).withColumn("ok", F.col("ratio").between(low, high))
