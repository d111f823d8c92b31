from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import bootstrap, regress, selective, stats


def test_multiplicity(spark):
    rows = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.005])) + [(9, None)], "i long, p double").withColumn("f", F.lit(1))
    holm = {r.i: r.p_holm for r in stats.holm(rows, ["f"], "p", "i").collect()}
    bh = {r.i: r.p_bh for r in stats.benjamini_hochberg(rows, ["f"], "p", "i").collect()}
    assert [holm[i] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02]) and 9 not in holm
    assert [bh[i] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_signed_ranks(spark):
    rows = spark.createDataFrame([(float(d),) for d in (1, -2, 3, 0, 2)], "d double").withColumn("g", F.lit(1))
    r = stats.signed_ranks(rows, ["g"]).first()
    assert (r.t_plus, r.t_minus, r.rank_biserial, r.n_used) == (7.5, 2.5, 0.5, 4)
    assert bootstrap.rank_biserial(np.array([1, -2, 3, 0, 2.0])) == 0.5
    assert stats.signed_ranks(rows.where("d = 0"), ["g"]).count() == 0


def test_areas(spark):
    correct = [int(c) for c in "1101001000"]
    rows = spark.createDataFrame([(i, float(i), c) for i, c in enumerate(correct)], "_ord long, s double, correct int").withColumn("g", F.lit("x"))
    curve = selective.risk_coverage(rows, ["g"], "s")
    assert curve.count() == 19
    assert selective.aurc(curve, ["g"]).first().aurc == pytest.approx(0.3417460317460318)
    assert selective.aurc_prefix_mean(rows, ["g"], "s").first().aurc_prefix_mean == pytest.approx(0.35674603174603176)
    assert bootstrap.trapezoid_aurc(np.arange(10.0), np.array(correct)) == pytest.approx(0.3417460317460318)


def test_depths_in_double_arithmetic(spark):
    rows = spark.range(100).select(F.col("id").alias("_ord"), F.lit(0.0).alias("s"), F.lit(1).alias("correct"), F.lit("x").alias("g"))
    got = {r.coverage: r.n_keep for r in selective.risk_coverage(rows, ["g"], "s").collect()}
    assert got[0.55] == 56 and got[1.0] == 100 and got[0.1] == 10


def test_rank_share(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double").withColumn("g", F.lit(1))
    assert sorted(r[0] for r in rows.select(selective.rank_share(F.col("x"), ["g"])).collect()) == [0.25, 0.625, 0.625, 1.0]


def test_wilson(spark):
    low, high = stats.wilson(F.lit(8), F.lit(10))
    assert tuple(spark.range(1).select(low, high).first()) == pytest.approx((0.49016247153664183, 0.9433178485456247))


def test_constant_columns_give_null(spark):
    rows = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double").withColumn("g", F.lit(1))
    assert stats.pearson(rows, ["g"], "a", "b").first().r is None and stats.spearman(rows, ["g"], "a", "b").first().rho is None


def test_tails():
    assert stats.normal_tail(1.959963984540054) == pytest.approx(0.025)
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and all(stats.chi2_tail(x, 5) == pytest.approx(math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)) for x in (0.5, 4.0, 30.0))
    assert stats.log10_normal_tail(70.0) == pytest.approx(-1066.26, abs=0.01) and stats.log10_normal_tail(2.0) == pytest.approx(math.log10(0.02275013194817921))


def test_bootstrap_p(spark):
    rows = spark.range(20_000).select(F.lit(1.0).alias("v"), F.lit("x").alias("g"))
    assert stats.bootstrap_p(rows, ["g"], "v").first().p_boot == pytest.approx(9.99950002499875e-05)


def tau(x, y):
    c = d = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a == 0), ty + (b == 0)
    n = len(x) * (len(x) - 1) / 2
    return (c - d) / math.sqrt((n - tx) * (n - ty)) if n not in (tx, ty) else None


@pytest.mark.parametrize("size", [{}, {"range_rows": 7, "ranges": 50, "window_rows": 0}, {"range_rows": 1, "ranges": 10, "window_rows": 0}])
def test_kendall_against_all_pairs(spark, size):
    draw = np.random.default_rng(len(size))
    cells = {"a": (draw.integers(0, 8, 90), draw.integers(0, 8, 90)), None: (draw.normal(size=70), draw.normal(size=70)), "same": (np.ones(5), np.arange(5.0)), "up": (np.arange(9.0), np.arange(9.0) ** 2), "one": (np.ones(1), np.ones(1))}
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in cells.items() for a, b in zip(x, y, strict=True)] + [("a", None, 1.0)], "c string, x double, y double")
    got = {r.c: (r.n, r.tau) for r in stats.kendall(rows, ["c"], "x", "y", **size).collect()}
    assert got == {k: (len(x), pytest.approx(tau(x, y)) if tau(x, y) is not None else None) for k, (x, y) in cells.items()}
    assert stats.kendall(rows.where("c = 'up'"), [], "x", "y", **size).first().tau == pytest.approx(1.0)


def data(spark, n=400):
    draw = np.random.default_rng(3)
    x, z, g = draw.normal(size=n), draw.normal(size=n), draw.integers(0, 25, n)
    y = 0.5 + 2 * x - z + draw.normal(size=n) + 0.3 * draw.normal(size=25)[g]
    return x, z, g, y, spark.createDataFrame([(float(a), float(b), int(c), float(d), int(d > 0)) for a, b, c, d in zip(x, z, g, y, strict=True)], "x double, z double, g long, y double, up int")


def sandwich(design, resid, g, bread):
    scores = np.array([(design[g == k] * resid[g == k, None]).sum(0) for k in np.unique(g)])
    n, k = design.shape
    m = len(scores)
    return np.sqrt(np.diag(m / (m - 1) * (n - 1) / (n - k) * bread @ (scores.T @ scores) @ bread))


def test_ols_with_clusters(spark):
    x, z, g, y, rows = data(spark)
    design = np.column_stack((np.ones_like(x), x, z))
    bread = np.linalg.inv(design.T @ design)
    coef = bread @ design.T @ y
    fit = regress.ols(rows, "y", ["x", "z"], "g")
    assert fit.coef == pytest.approx(coef) and fit.se == pytest.approx(sandwich(design, y - design @ coef, g, bread))
    assert fit.clusters == 25 and fit.r2 == pytest.approx(1 - ((y - design @ coef) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_logit_with_clusters(spark):
    x, z, g, y, rows = data(spark)
    design, up, coef = np.column_stack((np.ones_like(x), x, z)), (y > 0).astype(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ coef))
        coef = coef + np.linalg.solve(design.T * (p * (1 - p)) @ design, design.T @ (up - p))
    p = 1 / (1 + np.exp(-design @ coef))
    fit = regress.logit(rows, "up", ["x", "z"], "g")
    assert fit.coef == pytest.approx(coef, rel=1e-6)
    assert fit.se == pytest.approx(sandwich(design, up - p, g, np.linalg.inv(design.T * (p * (1 - p)) @ design)), rel=1e-6)


def test_predictors(spark):
    rows = spark.range(100).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("twin"), F.when(F.col("id") < 50, 1.0).alias("sparse"), (F.col("id") % 3).cast("double").alias("b"))
    assert regress.usable_predictors(rows, ["a", "twin", "sparse", "b"]) == ["a", "b"]
    assert regress.collinearity(rows, ["a", "b"])["vif"]["a"] == pytest.approx(1.0, abs=0.01)
    assert regress.cohen_f2(0.5, 0.4) == pytest.approx(0.2)


def test_hot_values_are_told(spark, monkeypatch):
    """Of a table beyond what is broadcast hot keys are told, others met: the same rows, whatever is null."""
    from tremolo.operators import lookups

    rows = spark.range(500).select(F.when(F.col("id") % 5 < 4, 0).when(F.col("id") % 25 < 20, F.col("id")).alias("k"), F.when(F.col("id") % 3 > 0, "g").alias("g"), "id")
    table = spark.createDataFrame(rows.groupBy("g", "k").agg(F.count("*").alias("n"), F.max("id").alias("v")).where("v % 7 <> 1").collect(), "g string, k long, n long, v long")
    each = lambda most: sorted(map(repr, lookups.looked_up(rows, table, ["g", "k"], ["v"], "n", most).collect()))
    assert each(10**6) == each(3) == each(0) and len(each(3)) == 500
    plan = lookups.looked_up(rows, table, ["g", "k"], ["v"], "n", 3)._jdf.queryExecution().toString()
    assert "_spread" in plan
    cell = spark.createDataFrame([("a", float(i % 4), float(i)) for i in range(60)] + [(None, None, 1.0)], "g string, x double, y double")
    want = sorted(map(repr, selective.with_ranks(cell, ["g"], {"rx": "x", "ry": "y"}).collect()))
    monkeypatch.setattr(lookups, "MOST_KEYS", 2)
    got = selective.with_ranks(cell, ["g"], {"rx": "x", "ry": "y"}, 0)
    assert sorted(map(repr, got.select("g", "x", "y", "rx", "ry", "_size").collect())) == want


def test_ranges_give_what_windows_give(spark):
    """One cell with most rows, a null cell, tied scores: ranked, risk and rank operators agree whether cells are windows or ranges."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "cold").alias("g"),
        F.col("id").alias("_ord"), F.round(F.rand(5), 2).alias("s"), F.when(F.col("id") % 3 > 0, F.round(F.rand(6), 1)).alias("t"), (F.rand(7) < 0.7).cast("int").alias("correct"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    each = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for made in (
        lambda n: selective.ranked(rows, ["g"], "s", window_rows=n),
        lambda n: selective.ranked(rows, ["g"], [F.col("t").desc(), F.col("s").asc()], window_rows=n),
        lambda n: selective.ranked(rows, [], "s", window_rows=n),
        lambda n: selective.risk_coverage(rows, ["g"], "s", window_rows=n),
        lambda n: selective.distinct_ranks(rows, ["g"], "t", {}, n),
        lambda n: selective.combined_ranks(rows, ["g"], "s", "t", "correct", n),
    ):
        assert each(made(0)) == each(made(10**6))
    assert selective.risk_coverage(rows, ["g"], "s").count() == 3 * 19
    assert selective.combined_ranks(rows, ["g"], "s", "t", "correct").count() == 4000
    assert selective.ranked(rows.limit(0), ["g"], "s", window_rows=-1).count() == 0
    own = rows.withColumn("share", selective.rank_share(F.col("t"), ["g"])).select("_ord", "share")
    got = selective.combined_ranks(rows, ["g"], "t", "s", "correct").select("_ord", F.col("r_entropy").alias("share"))
    assert each(own) == each(got)
