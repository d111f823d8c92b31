"""Queries of the analysis: selective prediction, tests, correlations, regressions, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entropy, mixed, quantiles, regress, resample, selective, stats
from ..operators.cuts import kept
from ..params import DEFAULT
from . import standins as s
from .concept_lane import CELL, PAIR_SQL, order_differences, r
from .registry import query

#: The study's replicates of an interval (STA-11); those of areas (STA-12) are DEFAULT.bootstrap.
BOOTSTRAP_CI = 2000

RANKED = f"{s.SELECTION}, rk as (select *, row_number() over (partition by lang order by entropy, _ord) as rn, count(*) over (partition by lang) as n_total from sel)"
CURVE = f"""{RANKED}, gr as (select round_even(1.0::double - 0.05::double * i, 2) as coverage from range(19) t(i)), hs as (select *, sum(correct) over (partition by lang order by rn) as hits from rk),
cv as (select lang, coverage, rn::int as n_keep, n_total, hits / rn::double as selective_accuracy, 1 - hits / rn::double as risk from hs join gr on rn = greatest(1, ceil(coverage * n_total)::int))"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selective.risk_coverage(s.selection(spark, sf_dir), ["lang"], "entropy")


@query("risk_coverage", f"with {CURVE} select lang, coverage, n_keep, n_total, round(selective_accuracy, 9) as selective_accuracy, round(risk, 9) + 0.0 as risk from cv")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-01, WIN-03, WIN-06."""
    return curve(spark, sf_dir).withColumns({c: r(c) for c in ("selective_accuracy", "risk")})


@query("aurc_trapezoid", f"with {CURVE}, x as (select *, coverage - lag(coverage) over (partition by lang order by coverage) as w, (risk + lag(risk) over (partition by lang order by coverage)) / 2 as h from cv) select lang, round(sum(w * h), 9) + 0.0 as aurc from x group by 1")
def aurc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-02, WIN-13."""
    return selective.aurc(curve(spark, sf_dir), ["lang"]).withColumn("aurc", r("aurc"))


@query("aurc_prefix_mean", f"with {RANKED}, x as (select lang, 1 - avg(correct) over (partition by lang order by rn rows unbounded preceding) as risk from rk) select lang, round(avg(risk), 9) + 0.0 as aurc_prefix_mean from x group by 1")
def aurc_prefix_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-03, WIN-05."""
    return selective.aurc_prefix_mean(s.selection(spark, sf_dir), ["lang"], "entropy").withColumn("aurc_prefix_mean", r("aurc_prefix_mean"))


@query("risk_at_operating_points", f"with {CURVE} select lang, " + ", ".join(f"round(max(risk) filter (where coverage = {p}::double), 9) + 0.0 as risk_at_{round(p * 100)}" for p in (0.9, 0.75, 0.5)) + " from cv group by 1")
def risk_at_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-07."""
    return selective.operating_points(curve(spark, sf_dir), ["lang"]).withColumns({f"risk_at_{p}": r(f"risk_at_{p}") for p in (90, 75, 50)})


def ranks_sql(source: str, column: str, by: str, name: str) -> str:
    return f"rank() over (partition by {by} order by {column}) + (count(*) over (partition by {by}, {column}) - 1) / 2.0::double as {name}"


COMBINED = f"{s.SELECTION}, q as (select *, {ranks_sql('sel', 'entropy', 'lang', 'ae')}, {ranks_sql('sel', 'confidence', 'lang', 'ac')}, {ranks_sql('sel', 'margin', 'lang', 'am')}, count(*) over (partition by lang) as n from sel), cb as (select *, ae / n as r_entropy, 1 - ac / n as r_confidence, 1 - am / n as r_margin, (ae / n + (1 - ac / n) + (1 - am / n)) / 3 as combined_3 from q)"


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selective.combined_ranks(s.selection(spark, sf_dir), ["lang"], "entropy", "confidence", "margin")


@query("rank_pct_combined3", f"with {COMBINED} select lang, _ord, round(r_entropy, 9) as r_entropy, round(r_confidence, 9) + 0.0 as r_confidence, round(r_margin, 9) + 0.0 as r_margin, round(combined_3, 9) as combined_3 from cb")
def rank_pct_combined3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, SEL-05."""
    return combined(spark, sf_dir).select("lang", "_ord", *[r(c).alias(c) for c in ("r_entropy", "r_confidence", "r_margin", "combined_3")])


def area_sql(column: str, source: str, name: str) -> str:
    return f"""{name}r as (select *, row_number() over (partition by lang order by {column}, _ord) as rn, count(*) over (partition by lang) as nt from {source}), {name}h as (select *, sum(correct) over (partition by lang order by rn) as hits from {name}r),
{name}c as (select lang, coverage, 1 - hits / rn::double as risk from {name}h join (select round_even(1.0::double - 0.05::double * i, 2) as coverage from range(19) t(i)) on rn = greatest(1, ceil(coverage * nt)::int)),
{name} as (select lang, sum(w * h) as {name}_v from (select lang, coverage - lag(coverage) over (partition by lang order by coverage) as w, (risk + lag(risk) over (partition by lang order by coverage)) / 2 as h from {name}c) group by 1)"""


@query("best_single_signal", f"with {COMBINED}, cb2 as (select *, round(combined_3, 9) as c3 from cb), {area_sql('entropy', 'cb2', 'e')}, {area_sql('r_confidence', 'cb2', 'c')}, {area_sql('r_margin', 'cb2', 'm')}, {area_sql('c3', 'cb2', 'x')} select lang, round(e_v, 9) as aurc_entropy, round(c_v, 9) as aurc_confidence, round(m_v, 9) as aurc_margin, round(x_v, 9) as aurc_combined, case when round(e_v, 9) = least(round(e_v, 9), round(c_v, 9), round(m_v, 9)) then 'aurc_entropy' when round(c_v, 9) = least(round(e_v, 9), round(c_v, 9), round(m_v, 9)) then 'aurc_confidence' else 'aurc_margin' end as best_single, least(round(e_v, 9), round(c_v, 9), round(m_v, 9)) as best_single_value, round(x_v, 9) < least(round(e_v, 9), round(c_v, 9), round(m_v, 9)) - 1e-15 as combined_wins from e join c using (lang) join m using (lang) join x using (lang)")
def best_single_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-05, SEL-06."""
    rows = combined(spark, sf_dir).withColumn("c3", r("combined_3"))
    names = {"aurc_entropy": "entropy", "aurc_confidence": "r_confidence", "aurc_margin": "r_margin", "aurc_combined": "c3"}
    out = None
    for name, column in names.items():
        one = selective.aurc(selective.risk_coverage(rows, ["lang"], column), ["lang"]).select("lang", r("aurc").alias(name))
        out = one if out is None else out.join(one, "lang")
    return selective.best_single(out, ["lang"], list(names)[:3], "aurc_combined")


@query("expected_random_aurc", f"with {s.SELECTION} select lang, round(1 - avg(correct), 9) + 0.0 as error_rate, round((1 - avg(correct)) * 0.9, 9) + 0.0 as aurc_random from sel group by 1")
def expected_random_aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-04."""
    return selective.expected_random_aurc(s.selection(spark, sf_dir), ["lang"]).withColumns({c: r(c) for c in ("error_rate", "aurc_random")})


@query("auroc_ranksum", f"with {s.SELECTION}, q as (select *, {ranks_sql('sel', 'entropy', 'lang', 'a')} from sel), t as (select lang, sum(a) filter (where correct = 0) as sm, count(*) filter (where correct = 0) as n1, count(*) filter (where correct <> 0) as n0 from q group by 1) select lang, n1, n0, case when n1 > 0 and n0 > 0 then round((sm - n1 * (n1 + 1) / 2.0::double) / (n1 * n0), 9) end as auroc from t")
def auroc_ranksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-08."""
    rows = s.selection(spark, sf_dir).withColumn("wrong", F.col("correct") == 0)
    return selective.auroc(rows, ["lang"], "entropy", "wrong").withColumn("auroc", r("auroc"))


PEARSON = "case when n * sxx - sx * sx > 1e-12 * n * sxx and n * syy - sy * sy > 1e-12 * n * syy then (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) end"


def sums_sql(source: str, by: str, x: str, y: str, name: str) -> str:
    return f"{name} as (select {by}, count(*)::double as n, sum({x})::double as sx, sum({y})::double as sy, sum({x} * {x})::double as sxx, sum({y} * {y})::double as syy, sum({x} * {y})::double as sxy from {source} group by all)"


@query("pearson_safe", f"with {s.SELECTION}, {sums_sql('sel', 'lang', 'entropy', 'confidence', 'p')} select lang, n::bigint as n, round({PEARSON}, 9) + 0.0 as r from p")
def pearson_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-06."""
    return stats.pearson(s.selection(spark, sf_dir), ["lang"], "entropy", "confidence").withColumn("r", r("r"))


@query("spearman_safe", f"with {s.SELECTION}, q as (select lang, {ranks_sql('sel', 'entropy', 'lang', 'a')}, {ranks_sql('sel', 'margin', 'lang', 'b')} from sel), {sums_sql('q', 'lang', 'a', 'b', 'p')} select lang, n::bigint as n, round({PEARSON}, 9) + 0.0 as rho from p")
def spearman_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-04."""
    return stats.spearman(s.selection(spark, sf_dir), ["lang"], "entropy", "margin").withColumn("rho", r("rho"))


FISHER = f"with {s.SELECTION}, q as (select lang, {ranks_sql('sel', 'entropy', 'lang', 'a')}, {ranks_sql('sel', 'margin', 'lang', 'b')} from sel), {sums_sql('q', 'lang', 'a', 'b', 'p')}, f as (select lang, n::bigint as n, {PEARSON} as rho from p)"


@query("fisher_ci", FISHER + " select lang, n, round(rho, 9) + 0.0 as rho, case when n >= 10 then round(tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)), 9) + 0.0 end as ci_low, case when n >= 10 then round(tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)), 9) + 0.0 end as ci_high from f")
def fisher_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-05."""
    made = stats.spearman(s.selection(spark, sf_dir), ["lang"], "entropy", "margin")
    low, high = stats.fisher_interval(F.col("rho"), F.col("n"))
    return made.select("lang", "n", r("rho").alias("rho"), r(low).alias("ci_low"), r(high).alias("ci_high"))


@query("fisher_pooled", FISHER + " select count(*) as k, round(tanh(sum(atanh(rho) * (n - 3)) / sum(n - 3)), 9) + 0.0 as pooled, round(tanh(avg(atanh(rho))), 9) + 0.0 as pooled_unweighted from f where rho is not null and abs(rho) < 1 and n > 3")
def fisher_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-07."""
    made = stats.spearman(s.selection(spark, sf_dir), ["lang"], "entropy", "margin")
    return stats.fisher_pooled(made, [], "rho", "n").select("k", r("pooled").alias("pooled"), r("pooled_unweighted").alias("pooled_unweighted"))


@query("mwu_u", f"with {s.SELECTION}, q as (select lang, correct, {ranks_sql('sel', 'entropy', 'lang', 'a')}, count(*) over (partition by lang, entropy) as t from sel), t as (select lang, count(*) filter (where correct = 1) as n1, count(*) filter (where correct <> 1) as n2, sum(a) filter (where correct = 1) as sm, sum(t::double * t - 1) as ties from q group by 1), u as (select *, sm - n1 * (n1 + 1) / 2.0::double as u, n1 + n2 as n from t) select lang, n1, n2, u, round((u - n1 * n2 / 2.0::double + 0.5) / sqrt(n1 * n2 / 12.0::double * (n + 1 - ties / (n * (n - 1)))), 9) + 0.0 as z_less, round(1 - 2 * u / (n1 * n2), 9) + 0.0 as effect from u where n1 > 0 and n2 > 0")
def mwu_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-03, STA-29."""
    rows = s.selection(spark, sf_dir).withColumn("good", F.col("correct") == 1)
    return stats.mann_whitney(rows, ["lang"], "entropy", "good").where("n1 > 0 and n2 > 0").withColumns({c: r(c) for c in ("z_less", "effect")})


@query("kruskal_h", f"with o as (select o_orderstatus as by_status, o_orderpriority as grp, round(o_totalprice / 1000) as v from orders), q as (select *, {ranks_sql('o', 'v', 'by_status', 'a')}, count(*) over (partition by by_status, v) as t from o), g as (select by_status, grp, sum(a) as sm, count(*) as n, sum(t::double * t - 1) as ties from q group by 1, 2), h as (select by_status, sum(n)::bigint as n, count(*) as k, sum(sm * sm / n) as q, sum(ties) as ties from g group by 1) select by_status, n, k, round((12 / (n::double * (n + 1)) * q - 3 * (n::double + 1)) / (1 - ties / (n::double * n * n - n)), 6) + 0.0 as h, k - 1 as df from h")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-16."""
    rows = s.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("by_status"), F.col("o_orderpriority").alias("grp"), F.round(F.col("o_totalprice") / 1000).alias("v"))
    return stats.kruskal(rows, ["by_status"], "grp", "v").withColumn("h", r("h", 6))


P_VALUES = "p as (select 'f' || (s_suppkey % 3) as family, s_suppkey as test, ((s_suppkey * 7919) % 1009) / 20000.0::double as p from supplier)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return s.table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), (k % 3).cast("string")).alias("family"), k.alias("test"), (((k * 7919) % 1009) / F.lit(20000.0)).alias("p"))


@query("holm_adjust", f"with {P_VALUES}, k as (select *, row_number() over (partition by family order by p, test) as k, count(*) over (partition by family) as n from p) select family, test, p, round(least(1.0, max((n - k + 1) * p) over (partition by family order by k rows unbounded preceding)), 9) as p_holm from k")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-09."""
    return stats.holm(p_values(spark, sf_dir), ["family"], "p", "test").withColumn("p_holm", r("p_holm"))


@query("bh_adjust", f"with {P_VALUES}, k as (select *, row_number() over (partition by family order by p, test) as k, count(*) over (partition by family) as n from p) select family, test, p, round(least(1.0, min(p * n / k) over (partition by family order by k desc rows unbounded preceding)), 9) as p_bh from k")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-10."""
    return stats.benjamini_hochberg(p_values(spark, sf_dir), ["family"], "p", "test").withColumn("p_bh", r("p_bh"))


@query("test_outcomes", f"with {P_VALUES}, k as (select *, row_number() over (partition by family order by p, test) as k, count(*) over (partition by family) as n from p), h as (select family, test, least(1.0, max((n - k + 1) * p) over (partition by family order by k rows unbounded preceding)) as ph, (test % 21 - 10) / 20.0::double as d from k) select family, test, case when ph < 0.05 and d < 0 then 'better' when ph < 0.05 and d > 0 then 'worse' else 'undecided' end as outcome, case when abs(d) < 0.1 then 'negligible effect' when ph >= 0.05 then 'not significant' when d < 0 then 'first more stable' else 'second more stable' end as reading from h")
def test_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-14, STA-15."""
    rows = stats.holm(p_values(spark, sf_dir), ["family"], "p", "test").withColumn("d", (F.col("test") % 21 - 10) / F.lit(20.0))
    return rows.select("family", "test", stats.holm_outcome(F.col("p_holm"), F.col("d")).alias("outcome"), stats.interpretation(F.col("d"), F.col("p_holm")).alias("reading"))


@query("bootstrap_p", "with x as (select l_linenumber as cell, l_discount - 0.04::double + (l_orderkey % 5) / 1000.0::double as v from lineitem), c as (select cell, count(v) as b, count(*) filter (where v >= 0) as u, count(*) filter (where v <= 0) as d from x group by 1) select cell, b, round(least(1.0, 2.0 * (least(u, d) + 1) / (b + 1)), 9) as p_boot from c")
def bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-13."""
    rows = s.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("cell"), (F.col("l_discount") - F.lit(0.04) + (F.col("l_orderkey") % 5) / F.lit(1000.0)).alias("v"))
    return stats.bootstrap_p(rows, ["cell"], "v").withColumn("p_boot", r("p_boot"))


@query("quantile_summary", f"with {s.GRID} select model_name, count(*) as n, round(min(confidence), 6) as min, round(quantile_cont(confidence, 0.25), 6) as q1, round(quantile_cont(confidence, 0.5), 6) as median, round(quantile_cont(confidence, 0.75), 6) as q3, round(max(confidence), 6) as max, round(quantile_cont(confidence, 0.75) - quantile_cont(confidence, 0.25), 6) as iqr, count(distinct confidence) as n_distinct from g group by 1")
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, AGG-20, AGG-10."""
    c = F.col("confidence")
    rows, _ = kept(s.grid(spark, sf_dir).select("model_name", "confidence"))
    q = quantiles.quantiles(rows, ["model_name"], "confidence", [0.0, 0.25, 0.5, 0.75, 1.0]).drop("n")
    made = rows.groupBy("model_name").agg(F.count("*").alias("n"), F.count_distinct(c).alias("n_distinct")).join(q, "model_name")
    at = lambda i: r(F.col("q")[i], 6)
    return made.select("model_name", "n", at(0).alias("min"), at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"), at(4).alias("max"), r(F.col("q")[3] - F.col("q")[1], 6).alias("iqr"), "n_distinct")


@query("quartile_bins", f"with {s.GRID}, q as (select model_name, quantile_cont(confidence, [0.25, 0.5, 0.75]) as q from g group by 1) select model_name, 1 + (confidence > q[1])::int + (confidence > q[2])::int + (confidence > q[3])::int as bin, count(*) as n from g join q using (model_name) group by all")
def quartile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07, WIN-08: ties stay in one bin."""
    made = quantiles.binned(s.grid(spark, sf_dir).select("model_name", "confidence"), ["model_name"], "confidence", [0.25, 0.5, 0.75])
    return made.groupBy("model_name", "bin").agg(F.count("*").alias("n"))


@query("standardised", f"with {s.SELECTION}, m as (select avg(entropy) as me, stddev_pop(entropy) as se, avg(confidence) as mc, stddev_pop(confidence) as sc from sel) select _ord, round((entropy - me) / se, 6) + 0.0 as entropy, round((confidence - mc) / sc, 6) + 0.0 as confidence, 0.0::double as one, round(ln(greatest(0.0001, least(0.9999, sel.entropy)) / (1 - greatest(0.0001, least(0.9999, sel.entropy)))), 6) + 0.0 as logit from sel, m")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06, PRJ-08, PRJ-09."""
    from ..functions.scalar import logit

    rows = s.selection(spark, sf_dir).withColumns({"one": F.lit(1.0), "logit": logit(F.col("entropy"))})
    made = regress.standardised(rows, ["entropy", "confidence", "one"])
    return made.select("_ord", *[r(c, 6).alias(c) for c in ("entropy", "confidence", "one", "logit")])


@query("ols_cluster", f"with {s.SELECTION}, f as (select regr_slope(entropy, confidence) as b, regr_intercept(entropy, confidence) as a, regr_r2(entropy, confidence) as r2 from sel) select 'const' as term, round(a, 7) + 0.0 as coef from f union all select 'confidence', round(b, 7) + 0.0 from f union all select 'r2', round(r2, 7) + 0.0 from f")
def ols_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-19: coefficients and R2; the errors' test is in the suite."""
    fit = regress.ols(s.selection(spark, sf_dir), "entropy", ["confidence"], "lang")
    rows = [*zip(fit.names, (round(x, 7) + 0.0 for x in fit.coef.tolist()), strict=True), ("r2", round(fit.r2, 7) + 0.0)]
    return spark.createDataFrame(rows, "term string, coef double")


def hurdle_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Labelled documents with indicators of their language, as models; the source is the instance that rows cluster in."""
    source = s.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_ord"), "source")
    return regress.with_effects(s.selection(spark, sf_dir).join(source, "_ord"), "lang")


@query("logit_hurdle")
def logit_hurdle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-18, STA-21: a logistic fit with fixed effects of models; it has no closed form in SQL, the suite holds it against Newton's
    steps in NumPy."""
    rows, effects = hurdle_rows(spark, sf_dir)
    return regress.logit(rows, "correct", ["entropy", "margin", *effects], "source").table(spark)


@query("magnitude_fixed_effects")
def magnitude_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-19, STA-21: least squares on the logit of what is above 0, with fixed effects of models."""
    from ..functions.scalar import logit

    rows, effects = hurdle_rows(spark, sf_dir)
    used = rows.where("entropy > 0").withColumn("logit_h", logit(F.col("entropy")))
    return regress.ols(used, "logit_h", ["confidence", "margin", *effects], "source").table(spark)


@query("mixed_intercepts")
def mixed_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-20, STA-24: a random intercept a source, fixed effects of models; the suite holds it against a dense fit."""
    rows, effects = hurdle_rows(spark, sf_dir)
    fit = mixed.random_intercept(rows, "entropy", ["confidence", "margin", *effects], "source")
    figures = [("group_variance", fit.group_variance), ("residual_variance", fit.residual_variance), ("log_likelihood", fit.log_likelihood), ("r2_marginal", fit.r2_marginal), ("r2_conditional", fit.r2_conditional)]
    figures = spark.createDataFrame([(n, float(v)) for n, v in figures], "term string, coef double")
    return fit.fixed.table(spark).unionByName(figures, allowMissingColumns=True)


@query("cluster_bootstrap")
def cluster_bootstrap(spark: SparkSession, sf_dir: str, b: int = 1000) -> DataFrame:
    """STA-23: intervals of coefficients over resampled orders, with the account of failed refits."""
    rows = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_returnflag") == "R").cast("double").alias("returned"))
    made, _ = kept(resample.cluster_coefficients(rows, "l_discount", ["quantity", "returned"], "l_orderkey", b))
    return resample.cluster_intervals(made, ["const", "quantity", "returned"])


@query("bootstrap_means")
def bootstrap_means(spark: SparkSession, sf_dir: str, b: int = BOOTSTRAP_CI) -> DataFrame:
    """STA-25: means of the signals' cells with their intervals."""
    rows = s.selection(spark, sf_dir)
    values = resample.means(rows, ["lang"], "entropy", "_ord", b)
    return rows.groupBy("lang").agg(F.avg("entropy").alias("mean")).join(resample.intervals(values, ["lang"], ["value"]).drop("signal"), "lang")


@query("mean_difference")
def mean_difference(spark: SparkSession, sf_dir: str, b: int = BOOTSTRAP_CI) -> DataFrame:
    """STA-29: the difference of two means, each side resampled by itself."""
    rows = s.selection(spark, sf_dir).withColumn("side", F.when(F.col("correct") == 1, "good").otherwise("bad"))
    values = resample.means(rows, ["lang", "side"], "entropy", "_ord", b)
    both = values.groupBy("lang", "replicate").agg((F.max(F.when(F.col("side") == "good", F.col("value"))) - F.max(F.when(F.col("side") == "bad", F.col("value")))).alias("value")).where("value is not null")
    held, _ = kept(both)
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("entropy")))
    point = rows.groupBy("lang").agg((mean("good") - mean("bad")).alias("difference"))
    return point.join(resample.intervals(held, ["lang"], ["value"]).drop("signal", "b"), "lang").join(stats.bootstrap_p(held, ["lang"], "value"), "lang")


@query("line_with_band")
def line_with_band(spark: SparkSession, sf_dir: str, b: int = 1000) -> DataFrame:
    """STA-25: a line through two signals at five points, with its bootstrap band."""
    return resample.linear_band(s.selection(spark, sf_dir), ["lang"], "entropy", "confidence", "_ord", [0.0, 0.25, 0.5, 0.75, 1.0], b)


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str, b: int = BOOTSTRAP_CI) -> DataFrame:
    """STA-11: intervals of the rank-biserial of order pairs; draws are random, so SQL has no counterpart."""
    values = resample.effects(order_differences(spark, sf_dir), ["pair"], "d", "instance", b)
    return resample.intervals(values, ["pair"], ["value"]).drop("signal")


def signal_replicates(spark: SparkSession, sf_dir: str, b: int) -> tuple[DataFrame, DataFrame]:
    """(lang, replicate, an area a signal), and the areas of the rows themselves, (lang, a column a signal)."""
    rows = s.selection(spark, sf_dir)
    held, _ = kept(combined(spark, sf_dir))
    orders = {"entropy": "entropy", "confidence": [F.col("confidence").desc()], "margin": [F.col("margin").desc()], "combined": [F.col("entropy").asc(), F.col("confidence").desc()], "combined_3": "combined_3"}
    point = None
    for name, order in orders.items():
        one = selective.aurc(selective.risk_coverage(held, ["lang"], order), ["lang"]).withColumnRenamed("aurc", name)
        point = one if point is None else point.join(one, "lang")
    values, _ = kept(resample.areas(rows, ["lang"], b=b))
    return values, point


@query("bootstrap_aurc")
def bootstrap_aurc(spark: SparkSession, sf_dir: str, b: int = DEFAULT.bootstrap) -> DataFrame:
    """STA-12: the area of each of five signals with its interval, one draw for all signals, combined_3 ranked anew in each replicate."""
    values, point = signal_replicates(spark, sf_dir, b)
    names = [*resample.SIGNALS, *resample.COMBINED]
    areas = point.select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("aurc")) for n in names])).alias("_v")).select("lang", "_v.*")
    return areas.join(resample.intervals(values, ["lang"], names), ["lang", "signal"])


@query("bootstrap_aurc_difference")
def bootstrap_aurc_difference(spark: SparkSession, sf_dir: str, b: int = DEFAULT.bootstrap) -> DataFrame:
    """STA-12, STA-13: combined_3 against the best single signal of the rows themselves, on the same draws."""
    values, point = signal_replicates(spark, sf_dir, b)
    best = selective.best_single(point, ["lang"], ["entropy", "confidence", "margin"], "combined_3").select("lang", "best_single", (F.col("combined_3") - F.col("best_single_value")).alias("delta"))
    single = F.when(F.col("best_single") == "entropy", F.col("entropy")).when(F.col("best_single") == "confidence", F.col("confidence")).otherwise(F.col("margin"))
    deltas, _ = kept(values.join(F.broadcast(best), "lang").select("lang", (F.col("combined_3") - single).alias("value")))
    ends = resample.intervals(deltas, ["lang"], ["value"]).drop("b", "signal")
    return best.join(stats.bootstrap_p(deltas, ["lang"], "value"), "lang").join(ends, "lang").withColumn("better", F.col("ci_high") < 0)


@query("kendall_tau", f"with {PAIR_SQL}, x as (select pair, instance, round(d / 10000) as a, instance % 7 as b from dp), p as (select l.pair, sign(l.a - r.a) as sa, sign(l.b - r.b) as sb from x l join x r on l.pair = r.pair and l.instance < r.instance), c as (select pair, count(*) filter (where sa * sb > 0) as c, count(*) filter (where sa * sb < 0) as d, count(*) filter (where sa = 0) as ta, count(*) filter (where sb = 0) as tb, count(*) as n from p group by 1) select pair, (select count(*) from x where x.pair = c.pair) as n, round((c - d) / sqrt((n - ta)::double * (n - tb)), 9) + 0.0 as tau from c")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-17."""
    rows = order_differences(spark, sf_dir).select("pair", F.round(F.col("d") / 10000).alias("a"), (F.col("instance") % 7).alias("b"))
    return stats.kendall(rows, ["pair"], "a", "b").withColumn("tau", r("tau"))


@query("predictor_coverage")
def predictor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, STA-22: which predictors are usable, with their variance inflation."""
    rows = s.selection(spark, sf_dir).withColumns({"twin": F.col("entropy"), "sparse": F.when(F.col("_ord") % 3 == 0, F.col("margin"))})
    columns = regress.usable_predictors(rows, ["entropy", "twin", "confidence", "sparse", "margin"])
    vif = regress.collinearity(rows, columns)["vif"]
    return spark.createDataFrame([(c, float(vif[c])) for c in columns], "predictor string, vif double")


@query("order_flips", f"with {s.GRID}, x as (select model_name, instance_id, confidence < lag(confidence) over (partition by model_name, instance_id order by _ord) as f from g) select model_name, count(*) as n, count(*) filter (where f) as n_flips from x group by 1")
def order_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10."""
    from ..operators.receipts import order_flips as flips

    return flips(s.grid(spark, sf_dir), CELL, "_ord", "confidence").groupBy("model_name").agg(F.sum("n").alias("n"), F.sum("n_flips").alias("n_flips"))


@query("highest_lowest_group", f"with {s.DUAL}, mm as (select model_name, avg(normalised_entropy_dedup) as e from dual where retained_m_distinct group by 1) select (select model_name from mm order by e desc, model_name limit 1) as highest, (select model_name from mm order by e, model_name limit 1) as lowest, round(max(e) - min(e), 9) as spread from mm")
def highest_lowest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27, SRT-02."""
    means = entropy.retained(entropy.dual_entropy(s.grid(spark, sf_dir), CELL)).groupBy("model_name").agg(F.avg("entropy").alias("e"))
    return means.agg(F.max_by("model_name", "e").alias("highest"), F.min_by("model_name", "e").alias("lowest"), r(F.max("e") - F.min("e")).alias("spread"))
