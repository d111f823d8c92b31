"""Quantiles, mixed models, fixed effects and answer forests against dense computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import mixed, qa, quantiles, regress
from tremolo.providers import LexicalNli


@pytest.mark.parametrize("few_rows,accuracy", [(10**6, 2000), (40, 20), (1, 8)])
def test_quantiles_of_any_size(spark, few_rows, accuracy):
    draw = np.random.default_rng(1)
    groups = {"normal": draw.normal(size=700), "ties": draw.integers(0, 3, 500).astype(float), "two": np.r_[np.zeros(300), np.ones(300)], "same": np.full(200, 7.5), None: draw.pareto(0.3, 300), "one": np.array([3.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("void", None)], "g string, v double").repartition(5)
    shares = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.q) for r in quantiles.quantiles(rows, ["g"], "v", shares, few_rows, accuracy).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g][0] == len(x) and got[g][1] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12), g
    whole = quantiles.quantiles(rows.where("g <> 'void'"), [], "v", [0.5], few_rows, accuracy).first()
    assert whole.q[0] == pytest.approx(np.median(np.concatenate([x for g, x in groups.items() if g])))
    bins = {(r.g, r.bin): r["count"] for r in quantiles.binned(rows.where("g = 'two'"), ["g"], "v", [0.25, 0.75], few_rows=few_rows, accuracy=accuracy).groupBy("g", "bin").count().collect()}
    assert bins == {("two", 1): 300, ("two", 2): 300}


@pytest.mark.parametrize("reml", [False, True])
@pytest.mark.parametrize("spread", [0.0, 0.8])
def test_random_intercepts_against_a_dense_fit(spark, monkeypatch, reml, spread):
    draw = np.random.default_rng(7)
    g = draw.integers(0, 30, 260)
    x, z = draw.normal(size=260), draw.normal(size=260)
    y = 100 + 1.5 * x - 0.7 * z + spread * draw.normal(size=30)[g] + draw.normal(size=260)
    rows = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x, z, y, strict=True)] + [(1, None, 1.0, 2.0)], "g long, x double, z double, y double")
    if spread and reml:
        monkeypatch.setattr(mixed, "MOST_SIZES", 2)
    fit = mixed.random_intercept(rows, "y", ["x", "z"], "g", reml)
    design, same = np.column_stack((np.ones(260), x, z)), g[:, None] == g[None]

    def dense(t):
        v = np.eye(260) + t * same
        inverse = np.linalg.inv(v)
        a = design.T @ inverse @ design
        coef = np.linalg.solve(a, design.T @ inverse @ y)
        e, df = y - design @ coef, 260 - 3 * reml
        s2 = e @ inverse @ e / df
        value = -0.5 * (df * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1]) - (0.5 * np.linalg.slogdet(a)[1] if reml else 0)
        return value, coef, s2, np.sqrt(np.diag(np.linalg.inv(a)) * s2)

    t = fit.group_variance / fit.residual_variance
    value, coef, s2, se = dense(t)
    assert fit.log_likelihood == pytest.approx(value) and fit.fixed.coef == pytest.approx(coef, rel=1e-6) and fit.residual_variance == pytest.approx(s2) and fit.fixed.se == pytest.approx(se, rel=1e-6)
    assert value >= max(dense(u)[0] for u in [0.0, *np.exp(np.linspace(-6, 4, 60))]) - 1e-6
    told = np.var(design @ coef)
    total = told + fit.group_variance + s2
    assert fit.r2_marginal == pytest.approx(told / total) and fit.r2_conditional == pytest.approx((told + fit.group_variance) / total)


def test_fixed_effects_and_flags(spark):
    draw = np.random.default_rng(8)
    m, x = draw.integers(0, 3, 200), draw.normal(size=200)
    y = 2 * x + np.array([0, 1, -1])[m] + draw.normal(size=200) * 0.2
    rows = spark.createDataFrame([("m.%d" % a, float(b), float(c), i) for i, (a, b, c) in enumerate(zip(m, x, y, strict=True))] + [(None, 0.0, 0.0, 999)], "model string, x double, y double, g long")
    made, names = regress.with_effects(rows, "model")
    assert names == ["fixed:model=m.1", "fixed:model=m.2"] and made.count() == 200
    table = {r.term: r for r in regress.ols(made, "y", ["x", *names], "g").table(spark).collect()}
    design = np.column_stack((np.ones(200), x, m == 1, m == 2))
    assert [table[t].coef for t in ("const", "x", *names)] == pytest.approx(np.linalg.lstsq(design, y, rcond=None)[0])
    assert [table[t].is_linguistic for t in ("const", "x", *names)] == [False, True, False, False] and table["x"].significant
    with pytest.raises(ValueError):
        regress.with_effects(rows, "model", most=2)


class Table:
    """Entailments by a table of random numbers."""

    def __init__(self, seed):
        self.seed = seed

    def entailment(self, premises, hypotheses):
        return [random.Random(f"{self.seed}|{p}|{h}").random() for p, h in zip(premises, hypotheses, strict=True)]


@pytest.mark.parametrize("pairs", [1, 3, 4096])
def test_forest_tells_clusters_of_every_threshold(spark, pairs):
    draw = random.Random(pairs)
    for case in range(30):
        answers = [draw.choice(["a", "A ", "b", "c", "d", "e f", "", " ", "g", "G"]) for _ in range(draw.randint(1, 14))]
        different = list(dict.fromkeys(answers))
        weights = [w for w, _, _ in qa.forest(different, Table(case), pairs)]
        for t in (0.05, 0.2, 0.35, 0.5, 0.8):
            assert len(different) - sum(w >= t for w in weights) == len(set(qa.cluster_answers(answers, Table(case), t)))


def test_clusters_of_rows(spark):
    draw = random.Random(5)
    cells = {g: [draw.choice(["the red cat", "red cat", "a dog", "The red cat ", "dog", "", None, "no dog"]) for _ in range(20)] for g in ("x", None)}
    rows = spark.createDataFrame([(g, i, a) for g, x in cells.items() for i, a in enumerate(x)], "g string, _ord long, answer string")
    got = {(r.g, r._ord): r.cluster for r in qa.answer_clusters(rows, ["g"], "answer", LexicalNli(), least=0.6).collect()}
    for g, answers in cells.items():
        assert [got[g, i] for i in range(20)] == qa.cluster_answers(answers, LexicalNli(), 0.6)
    sweep = {(r.g, r.threshold): r.n_clusters for r in qa.threshold_sweep(rows, ["g"], "answer", LexicalNli(), [0.2, 0.6]).collect()}
    assert all(sweep[g, t] == len(set(qa.cluster_answers(a, LexicalNli(), t))) for g, a in cells.items() for t in (0.2, 0.6))
    assert qa.answer_clusters(rows.where(F.lit(False)), ["g"], "answer", LexicalNli()).count() == 0
