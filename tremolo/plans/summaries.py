"""Queries of summaries: figures of groups, bimodality, collisions, contrasts of quartiles, stored curves, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entropy, perturb, receipts, reports, selective, stats
from . import standins as s
from .analysis import CURVE, curve
from .concept_lane import CELL, SIGNED, r
from .registry import query

FIGURES = "count(*) as n, round(avg(v), 9) + 0.0 as mean, round(quantile_cont(v, 0.5), 9) + 0.0 as median, round(coalesce(stddev_samp(v), 0), 9) as sd, round(min(v), 9) + 0.0 as min, round(max(v), 9) + 0.0 as max, count(*) filter (where v > 0) as nonzero_count, round(avg((v > 0)::int), 9) as nonzero_rate, round(100 * avg((v <= 1e-12)::int), 7) as pct_zero, round(100 * avg((v > 0.2)::int), 7) as pct_above"


@query("stacked_summaries", f"""with {s.DUAL}, x as (select model_name, split_part(instance_id, '-', 2) as week, dominant, normalised_entropy_dedup as v, retained_m_distinct as kept from dual where normalised_entropy_dedup is not null),
u as (select 'week' as group_type, week as group_name, v from x where kept union all select 'dominant', dominant, v from x where kept union all select 'model_name', model_name, v from x) select group_type, group_name, {FIGURES} from u group by all""")
def stacked_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26, AGG-22, AGG-09: two keys over the retained cells, the model's over all."""
    both = entropy.dual_entropy(s.grid(spark, sf_dir), CELL)
    cells = both.select("model_name", F.split_part("instance_id", F.lit("-"), F.lit(2)).alias("week"), "dominant", F.col("normalised_entropy_dedup").alias("v"), "retained_m_distinct")
    made = reports.group_figures(cells.where("retained_m_distinct"), ["week", "dominant"], "v").unionByName(reports.group_figures(cells, ["model_name"], "v"))
    return made.withColumns({**{c: r(c) for c in ("mean", "median", "sd", "min", "max", "nonzero_rate")}, **{c: r(c, 7) for c in ("pct_zero", "pct_above")}})


@query("bimodality", f"""with {s.DUAL}, x as (select 'all' as pool, normalised_entropy as v from dual union all select 'distinct', normalised_entropy_dedup from dual where retained_m_distinct),
p as (select pool, 100 * avg((v <= 1e-12)::int) as z, 100 * avg((v > 0.05 and v <= 0.2)::int) as m, 100 * avg((v > 0.2)::int) as a from x where v is not null group by 1) select pool, round(z, 7) as pct_zero, round(m, 7) as pct_middle, round(a, 7) as pct_above, z >= 40 and a >= 15 and m < a as persists from p""")
def bimodality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22."""
    both = entropy.dual_entropy(s.grid(spark, sf_dir), CELL)
    pools = both.select(F.lit("all").alias("pool"), F.col("normalised_entropy").alias("v")).unionByName(both.where("retained_m_distinct").select(F.lit("distinct").alias("pool"), F.col("normalised_entropy_dedup").alias("v")))
    return reports.bimodality(pools, ["pool"], "v").withColumns({c: r(c, 7) for c in ("pct_zero", "pct_middle", "pct_above")})


@query("legacy_entropy", f"""with {s.GRID}, c as (select instance_id, model_name, label, count(*) as n from g group by all), t as (select instance_id, model_name, sum(n)::bigint as k, count(*) as c, sum(n * log2(n)) as s from c group by 1, 2)
select instance_id, model_name, k, round(case when k <= 1 or c = 1 then 0 else (log2(k) - s / k) / log2(k + 1) end, 9) + 0.0 as entropy from t""")
def legacy_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-27: the older scale."""
    return entropy.legacy_entropy(s.grid(spark, sf_dir), CELL, "label").withColumn("entropy", r("entropy"))


AFTER = "case when k % 5 <> 0 then label when label = 'C0' then 'C1' when k % 3 = 0 then 'UNASSIGNED' else 'C0' end"


@query("collision_effect", f"""with {s.GRID}, ch as (select *, {AFTER} as after from g), ga as (select instance_id, model_name, _ord, after as label from ch),
{s.entropy_sql('g', 'instance_id model_name', 'hb')}, {s.entropy_sql('ga', 'instance_id model_name', 'ha')},
mv as (select instance_id, model_name, b.normalised_entropy as x, a.normalised_entropy as y from hb b join ha a using (instance_id, model_name) where abs(coalesce(b.normalised_entropy, -1) - coalesce(a.normalised_entropy, -1)) > 1e-8),
hit as (select distinct ch.instance_id, ch.model_name from ch where ch.after <> ch.label and exists (select 1 from g where g.instance_id = ch.instance_id and g.model_name = ch.model_name and g._ord <> ch._ord and g.label = ch.after)),
t as (select hit.instance_id is not null as any_collision, case when y > x then 'up' when y < x then 'down' else 'undefined' end as direction, count(*) as n from mv left join hit using (instance_id, model_name) group by all)
select any_collision, direction, coalesce(n, 0) as n from (values (true), (false)) a(any_collision) cross join (values ('up'), ('down'), ('undefined')) d(direction) left join t using (any_collision, direction)""")
def collision_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COL-01: does a collision tell the direction of a cell's entropy?"""
    k = F.col("k")
    after = F.when(k % 5 != 0, F.col("label")).when(F.col("label") == "C0", "C1").when(k % 3 == 0, "UNASSIGNED").otherwise("C0")
    return perturb.collision_effect(s.grid(spark, sf_dir).withColumn("after", after), CELL, "_ord", "label", "after")


@query("quartile_wilcoxon", f"""with {s.SELECTION}, q as (select lang, quantile_cont(confidence, 0.75) as t, quantile_cont(confidence, 0.25) as b from sel group by 1),
sd as (select sel.lang, 'top' as side, entropy, _ord from sel join q using (lang) where confidence >= t union all select sel.lang, 'bottom', entropy, _ord from sel join q using (lang) where confidence <= b),
n as (select *, row_number() over (partition by lang, side order by md5('42:' || _ord || ':' || side), _ord) as k from sd),
dp as (select a.lang, a.entropy - b.entropy as d from n a join n b on a.lang = b.lang and a.k = b.k and a.side = 'top' and b.side = 'bottom'), dr as (select lang, round(d, 9) as d from dp),
{SIGNED('dr', 'lang')} select lang, n_used, round(rank_biserial, 9) + 0.0 as rank_biserial, round(z, 9) + 0.0 as z, abs(rank_biserial) >= 0.3 as meaningful from ss""")
def quartile_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-30: the best quarter against as many of the worst, in arbitrary pairs; not the default test."""
    pairs = reports.quartile_pairs(s.selection(spark, sf_dir), ["lang"], "confidence", "entropy", "_ord").withColumn("d", r("d"))
    made = stats.signed_ranks(pairs, ["lang"])
    return made.select("lang", "n_used", r("rank_biserial").alias("rank_biserial"), r("z").alias("z"), (F.abs("rank_biserial") >= 0.3).alias("meaningful"))


@query("curve_ledger", f"""with {CURVE}, st as (select lang, coverage, round(risk, 4) as risk from cv), w as (select lang, (coverage - lag(coverage) over (partition by lang order by coverage)) * (risk + lag(risk) over (partition by lang order by coverage)) / 2 as a from st),
c as (select lang, sum(a) as computed from w group by 1), e as (select *, coverage - lag(coverage) over (partition by lang order by coverage) as dx, (risk + lag(risk) over (partition by lang order by coverage)) / 2 as h from cv), d as (select lang, sum(dx * h) + case when lang = 'de' then 0.01 else 0 end as draft from e group by 1)
select lang, round(draft, 6) + 0.0 as draft, round(computed, 6) + 0.0 as computed, abs(draft - computed) <= 0.0001 as ok from d join c using (lang)""")
def curve_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-13: areas recomputed from a curve of four digits; one language's stored area is off and must be told."""
    made = curve(spark, sf_dir)
    off = F.when(F.col("lang") == "de", 0.01).otherwise(0.0)
    stored = selective.aurc(made, ["lang"]).select("lang", (F.col("aurc") + off).alias("value"))
    return receipts.curve_ledger(made.withColumn("risk", F.round("risk", 4)), stored, ["lang"]).withColumns({c: r(c, 6) for c in ("draft", "computed")})


@query("concept_prompts", f"""with {s.TURNS} select conv_id, turn, md5('Identify the primary medical concept in the following clinical text. Reply with only the concept name.' || chr(10) || chr(10) || 'Text: ' || case when turn % 3 = 0 then '{{text}} {{question}} ' else '' end || pred) as prompt from qa""")
def concept_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16: the concept lane's; slots within a text stay as they are."""
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("{text} {question} "), "pred")).otherwise(F.col("pred"))
    return s.turns(spark, sf_dir).select("conv_id", "turn", F.md5(reports.concept_prompt(text)).alias("prompt"))
