"""Entropy of label distributions within cells, raw and without repeated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import NA_LABELS
from ..params import DEFAULT, UNASSIGNED


def bits(n: Column, total: Column, n_log_n: Column, clusters: Column) -> Column:
    """Shannon entropy in bits from sums over labels: log2(N) - sum(n log2 n) / N; exactly 0 for one label (AGG-01)."""
    return F.when(clusters == 1, F.lit(0.0)).otherwise(F.log2(total) - n_log_n / total)


def known_label(label: Column) -> Column:
    """The label, or null where it stands for none (trap 1)."""
    return F.when(~(F.lower(F.coalesce(label, F.lit(""))).isin(*NA_LABELS) | (label == UNASSIGNED)), label)


def label_entropy(rows: DataFrame, cell: list[str], label: str = "label", order: str = "_ord") -> DataFrame:
    """Per cell the entropy of its assigned labels; the scale is log2 of all its rows (AGG-01, AGG-02, AGG-03).

    A cell without an assigned label has null entropy, is not zero, and UNASSIGNED dominates it. A cell of one row has no scale: its
    normalised entropy is null and it is not zero. Of labels that are as frequent, the first seen dominates.
    """
    counted = rows.groupBy(*cell, known_label(F.col(label)).alias("_label")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    n, there = F.col("_n"), F.col("_label").isNotNull()
    made = counted.groupBy(*cell).agg(
        F.sum("_n").alias("n_variants"),
        F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("n_assigned"),
        F.count_if(there).alias("n_clusters"),
        F.sum(F.when(there, n * F.log2(n))).alias("_nlogn"),
        F.max_by("_label", F.when(there, F.struct(n, -F.col("_first")))).alias("dominant"),
    )
    h = F.when(F.col("n_assigned") > 0, bits(n, F.col("n_assigned"), F.col("_nlogn"), F.col("n_clusters")))
    made = made.withColumn("semantic_entropy", h)
    scaled = F.when(F.col("n_variants") > 1, F.col("semantic_entropy") / F.log2("n_variants"))
    return made.select(
        *cell, "n_variants", "n_assigned", (F.col("n_variants") - F.col("n_assigned")).alias("n_unassigned"), "n_clusters", "semantic_entropy", scaled.alias("normalised_entropy"),
        F.coalesce("dominant", F.lit(UNASSIGNED)).alias("dominant"), F.coalesce(scaled <= 1e-12, F.lit(False)).alias("is_zero"), (F.col("n_assigned") == 0).alias("all_unassigned"),
    )


def first_texts(rows: DataFrame, cell: list[str], text: str = "text_key", original: str = "is_orig", order: str = "_ord") -> DataFrame:
    """The first row of each text of a cell; the original is a text of its own (AGG-04)."""
    key = F.when(F.col(original), F.lit(None)).otherwise(F.col(text).cast("string"))
    window = Window.partitionBy(*cell, original, key).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def dual_entropy(rows: DataFrame, cell: list[str], label: str = "label", text: str = "text_key", original: str = "is_orig", order: str = "_ord", min_m: int = DEFAULT.min_m) -> DataFrame:
    """Raw and text-distinct entropy side by side, with the two retention flags (AGG-04, FLT-04)."""
    raw = label_entropy(rows, cell, label, order)
    distinct = label_entropy(first_texts(rows, cell, text, original, order), cell, label, order)
    counts = rows.groupBy(*cell).agg(F.count_if(~F.col(original)).alias("m_accepted"), F.count_distinct(F.when(~F.col(original), F.col(text))).alias("m_distinct"))
    both = raw.join(distinct.select(*cell, F.col("semantic_entropy").alias("semantic_entropy_dedup"), F.col("normalised_entropy").alias("normalised_entropy_dedup"), F.col("is_zero").alias("is_zero_dedup")), cell).join(counts, cell)
    return both.withColumns({"n_duplicates": F.col("m_accepted") - F.col("m_distinct"), "retained_m_accepted": F.col("m_accepted") >= min_m, "retained_m_distinct": F.col("m_distinct") >= min_m})


def retained(entropy: DataFrame, arm: str = "dedup") -> DataFrame:
    """The retained cells of an arm, with its entropy as ``entropy``: filter and column change together (FLT-06)."""
    if arm not in ("dedup", "raw"):
        raise ValueError(arm)
    suffix, flag = ("_dedup", "retained_m_distinct") if arm == "dedup" else ("", "retained_m_accepted")
    return entropy.where(F.col(flag)).withColumn("entropy", F.col(f"normalised_entropy{suffix}"))


def mesh_entropy(rows: DataFrame, cell: list[str], label: str = "label", unstable: float = DEFAULT.mesh_unstable) -> DataFrame:
    """Entropy of all labels, missing ones as 'NA', over log2(max(n, 2)), with the distribution as JSON (AGG-05)."""
    counted = rows.groupBy(*cell, F.coalesce(F.col(label), F.lit("NA")).alias("_label")).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    made = counted.groupBy(*cell).agg(F.sum(n).alias("n"), F.count("*").alias("n_clusters"), F.sum(n * F.log2(n)).alias("_nlogn"), F.array_sort(F.collect_list(F.struct(F.col("_label").alias("k"), n.alias("v")))).alias("_d"))
    h = bits(n, F.col("n"), F.col("_nlogn"), F.col("n_clusters")) / F.log2(F.greatest(F.col("n"), F.lit(2)))
    return made.withColumn("entropy", h).select(*cell, "n", "n_clusters", "entropy", (F.col("entropy") >= unstable).alias("unstable"), F.to_json(F.map_from_entries("_d")).alias("cluster_distribution"))


def conditional_entropy(rows: DataFrame, cell: list[str], by: list[str], label: str = "label", original: str = "is_orig") -> DataFrame:
    """mesh_entropy() of each group of perturbations, with the cell's original in every group (AGG-06, JOI-13)."""
    groups = rows.where(~F.col(original)).select(*cell, *by).distinct()
    with_original = rows.where(F.col(original)).select(*cell, label).join(groups, cell)
    return mesh_entropy(rows.where(~F.col(original)).select(*cell, *by, label).unionByName(with_original.select(*cell, *by, label)), [*cell, *by], label)


def cluster_entropy(clusters: DataFrame, cell: list[str], m: str = "m", size: str = "size") -> DataFrame:
    """Entropy of cluster sizes over log2(m + 1), m perturbations of the instance; sizes must add up to m + 1 (AGG-07)."""
    n = F.col(size)
    made = clusters.groupBy(*cell).agg(F.max(m).alias("m"), F.sum(n).alias("total"), F.count("*").alias("n_clusters"), F.sum(n * F.log2(n)).alias("_s"))
    made = made.withColumn("entropy", bits(n, F.col("total"), F.col("_s"), F.col("n_clusters")))
    scaled = F.when(F.col("m") > 0, F.col("entropy") / F.log2(F.col("m") + 1)).otherwise(F.lit(0.0))
    return made.select(*cell, "m", "n_clusters", "entropy", scaled.alias("norm_entropy"), (F.col("total") == F.col("m") + 1).alias("complete"))


def original_accuracy(rows: DataFrame, cell: list[str], predicted: str = "label", gold: str = "gold", confidence: str = "confidence", original: str = "is_orig") -> DataFrame:
    """Whether the original's prediction is the gold label, both assigned; its mean confidence (AGG-08)."""
    hit = (F.col(predicted) == F.col(gold)) & (F.col(predicted) != UNASSIGNED) & (F.col(gold) != UNASSIGNED)
    own = F.col(original)
    return rows.groupBy(*cell).agg(F.coalesce(F.max(F.when(own, hit.cast("int"))), F.lit(0)).alias("accuracy"), F.avg(F.when(own, F.col(confidence))).alias("mapping_confidence"))


def accepted_rows(rows: DataFrame, accepted: DataFrame, key: list[str], original: str = "is_orig") -> DataFrame:
    """Originals, and variants whose ids are accepted now (FLT-07)."""
    return rows.where(F.col(original)).unionByName(rows.where(~F.col(original)).join(accepted.select(*key).distinct(), key, "left_semi"))


def identity_excluded(rows: DataFrame, instance: list[str], text: str, original_text: str, m: str = "m", min_m: int = DEFAULT.min_m) -> DataFrame:
    """Per instance, its variants that equal the original but for case and outer space, and whether enough others are left (FLT-13)."""
    from ..functions.scalar import casefold, strip

    same = casefold(strip(F.col(text))) == casefold(strip(F.col(original_text)))
    made = rows.groupBy(*instance).agg(F.count("*").alias(m), F.count_if(same).alias("n_identical"))
    return made.withColumn("kept", F.col(m) - F.col("n_identical") >= min_m)


def legacy_entropy(rows: DataFrame, cell: list[str], label: str) -> DataFrame:
    """(cell, k, entropy) by the older rule, not the default: exact strings are the clusters, nulls one, and the scale is log2(k + 1)
    for k predictions; 0 of one (STA-27)."""
    counted = rows.groupBy(*cell, label).agg(F.count("*").alias("_n"))
    made = counted.groupBy(*cell).agg(F.sum("_n").alias("k"), F.count("*").alias("_c"), F.sum(F.col("_n") * F.log2("_n")).alias("_nlogn"))
    h = F.when(F.col("k") <= 1, F.lit(0.0)).otherwise(bits(F.col("k"), F.col("k"), F.col("_nlogn"), F.col("_c")) / F.log2(F.col("k") + 1))
    return made.select(*cell, "k", h.alias("entropy"))
