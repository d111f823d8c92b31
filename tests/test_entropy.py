from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from tremolo.operators import entropy, qa
from tremolo.providers import LexicalNli

SCHEMA = "cell string, label string, text_key string, is_orig boolean, _ord long"


def cells(spark, groups):
    rows = [(c, label, f"t{k}", k == 0, k) for c, labels in groups.items() for k, label in enumerate(labels)]
    return spark.createDataFrame(rows, SCHEMA)


GROUPS = {"mixed": ["A", "A", "B", "UNASSIGNED"], "none": ["UNASSIGNED"] * 4, "same": ["A"] * 4, "ties": ["b", "a", "b", "a"], "one": ["A"], "na": ["NaN", "none", None, "A"]}


def by_cell(df):
    return {r["cell"]: r for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_hand_computed(spark, parts):
    got = by_cell(entropy.label_entropy(cells(spark, GROUPS).orderBy(F.rand(parts)).repartition(parts), ["cell"]))
    m = got["mixed"]
    assert (m.n_variants, m.n_assigned, m.n_unassigned, m.n_clusters, m.dominant) == (4, 3, 1, 2, "A")
    assert m.semantic_entropy == pytest.approx(0.9182958340544896) and m.normalised_entropy == pytest.approx(0.4591479170272448)
    n = got["none"]
    assert (n.semantic_entropy, n.normalised_entropy, n.dominant, n.is_zero, n.all_unassigned) == (None, None, "UNASSIGNED", False, True)
    assert got["same"].semantic_entropy == 0 and got["same"].is_zero
    assert (got["one"].semantic_entropy, got["one"].normalised_entropy, got["one"].is_zero) == (0.0, None, False)
    assert got["ties"].dominant == "b" and got["na"].n_assigned == 1


def test_repeated_texts(spark):
    rows = [("x", "A", None, True, 0), ("x", "A", "t1", False, 1), ("x", "B", "t1", False, 2), ("x", "C", "t2", False, 3), ("x", "C", "t3", False, 4), ("y", "A", "t1", True, 0), ("y", "A", "t1", False, 1), ("y", "B", "t1", False, 2), ("y", "B", "t2", False, 3)]
    got = by_cell(entropy.dual_entropy(spark.createDataFrame(rows, SCHEMA), ["cell"]))
    x, y = got["x"], got["y"]
    assert (x.m_accepted, x.m_distinct, x.n_duplicates, x.retained_m_distinct) == (4, 3, 1, True)
    assert (y.m_accepted, y.m_distinct, y.retained_m_accepted, y.retained_m_distinct) == (3, 2, True, False)
    assert x.semantic_entropy_dedup == pytest.approx(1.0) and x.semantic_entropy != x.semantic_entropy_dedup
    with pytest.raises(ValueError):
        entropy.retained(spark.range(1), "other")


def test_cluster_sizes(spark):
    rows = spark.createDataFrame([("q", 4, 3), ("q", 4, 1), ("q", 4, 1)], "id string, m long, size long")
    r = entropy.cluster_entropy(rows, ["id"]).first()
    assert r.norm_entropy == pytest.approx(0.5904362834083089) and r.complete


def test_duplicating_a_variant_changes_raw_entropy_alone(spark):
    rows = cells(spark, {"c": ["A", "B", "B", "C"]})
    twice = rows.union(rows.where("_ord = 3").withColumn("_ord", F.lit(9).cast("long")))
    a, b = (by_cell(entropy.dual_entropy(x, ["cell"]))["c"] for x in (rows, twice))
    assert a.semantic_entropy != b.semantic_entropy and a.semantic_entropy_dedup == b.semantic_entropy_dedup


def test_empty(spark):
    assert entropy.dual_entropy(cells(spark, {}), ["cell"]).count() == 0


def test_conditional_adds_the_original(spark):
    rows = cells(spark, {"c": ["A", "B", "B"]}).withColumn("ptype", F.col("_ord") % 2)
    got = {r.ptype: (r.n, r.entropy) for r in entropy.conditional_entropy(rows, ["cell"], ["ptype"]).collect()}
    assert got == {1: (2, pytest.approx(1.0)), 0: (2, pytest.approx(1.0))}


@pytest.mark.parametrize(
    "answers,n",
    [(["heart attack", "myocardial infarction", " Heart attack"], 1), (["aspirin", "diabetes", "the femur"], 3), (["yes", "affirmative", "no"], 2), (["", " ", "x"], 2)],
)
def test_answer_clusters(answers, n):
    nli = LexicalNli((frozenset({"heart attack", "myocardial infarction"}), frozenset({"yes", "affirmative"})))
    got = qa.cluster_answers(answers, nli)
    assert len(set(got)) == n and got[0] == 0


def test_inner_blanks_part_answers_and_raw_answers_are_compared():
    class Never:
        asked = []

        def entailment(self, a, b):
            self.asked += a
            return [0.0] * len(a)

    assert qa.cluster_answers(["A  b", "a b", " a B", None, " "], Never()) == [0, 1, 1, 2, 2] and "A  b" in Never.asked


def test_clusters_are_transitive():
    class Chain:
        def entailment(self, a, b):
            return [float({x, y} in ({"a", "b"}, {"b", "c"})) for x, y in zip(a, b, strict=True)]

    assert qa.cluster_answers(["a", "c", "b"], Chain()) == [0, 0, 0]
