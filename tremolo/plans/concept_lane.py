"""Queries of the concept lane: entropy, acceptance, dissociation, matched pairs, retrieval, assignment, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import concepts, entropy, ivf, perturb, receipts, retrieval, stats
from ..params import UNASSIGNED
from . import standins as s
from .registry import query

CELL = s.CELL


def r(x: Column | str, digits: int = 9) -> Column:
    """Rounded for comparison; without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


ENTROPY_COLUMNS = "instance_id, model_name, n_variants, n_assigned, n_unassigned, n_clusters, round(semantic_entropy, 9) + 0.0 as semantic_entropy, round(normalised_entropy, 9) + 0.0 as normalised_entropy, dominant, is_zero, all_unassigned"


@query("entropy_labels", f"with {s.GRID},\n{s.entropy_sql('g', 'instance_id model_name', 'e')} select {ENTROPY_COLUMNS} from e")
def entropy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02, AGG-03."""
    return entropy.label_entropy(s.grid(spark, sf_dir), CELL).withColumns({c: r(c) for c in ("semantic_entropy", "normalised_entropy")})


@query("entropy_dual_m", f"with {s.DUAL} select {ENTROPY_COLUMNS}, round(semantic_entropy_dedup, 9) + 0.0 as semantic_entropy_dedup, round(normalised_entropy_dedup, 9) + 0.0 as normalised_entropy_dedup, is_zero_dedup, m_accepted, m_distinct, n_duplicates, retained_m_accepted, retained_m_distinct from dual")
def entropy_dual_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, FLT-04, WIN-01, WIN-12."""
    return entropy.dual_entropy(s.grid(spark, sf_dir), CELL).withColumns({c: r(c) for c in ("semantic_entropy", "normalised_entropy", "semantic_entropy_dedup", "normalised_entropy_dedup")})


@query("retained_filter_arms", f"""with {s.DUAL}, arms as (select 'dedup' as arm, model_name, normalised_entropy_dedup as e from dual where retained_m_distinct union all select 'raw', model_name, normalised_entropy from dual where retained_m_accepted)
select arm, model_name, count(*) as n, round(avg(e), 9) as mean_entropy, round(stddev_samp(e), 9) as sd_entropy, count(*) filter (where e = 0) as n_zero from arms group by all""")
def retained_filter_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, AGG-09."""
    both = entropy.dual_entropy(s.grid(spark, sf_dir), CELL)
    arms = [entropy.retained(both, a).select(F.lit(a).alias("arm"), "model_name", "entropy") for a in ("dedup", "raw")]
    return arms[0].unionByName(arms[1]).groupBy("arm", "model_name").agg(F.count("*").alias("n"), r(F.avg("entropy")).alias("mean_entropy"), r(F.stddev_samp("entropy")).alias("sd_entropy"), F.count_if(F.col("entropy") == 0).alias("n_zero"))


@query("sensitivity_delta", f"""with {s.DUAL}, a as (select model_name, avg(normalised_entropy_dedup) as d from dual where retained_m_distinct group by 1), b as (select model_name, avg(normalised_entropy) as w from dual where retained_m_accepted group by 1)
select model_name, round(d, 9) as dedup, round(w, 9) as raw, round(w - d, 9) + 0.0 as delta, sign(w - d)::int as direction from a join b using (model_name)""")
def sensitivity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-01."""
    both = entropy.dual_entropy(s.grid(spark, sf_dir), CELL)
    a, b = (entropy.retained(both, arm).groupBy("model_name").agg(F.avg("entropy").alias(name)) for arm, name in (("dedup", "_d"), ("raw", "_w")))
    delta = F.col("_w") - F.col("_d")
    return a.join(b, "model_name").select("model_name", r("_d").alias("dedup"), r("_w").alias("raw"), r(delta).alias("delta"), F.signum(delta).cast("int").alias("direction"))


@query("entropy_mesh", f"""with {s.GRID}, c as (select instance_id, model_name, label, count(*) as n from g group by all), t as (select instance_id, model_name, sum(n)::bigint as n, count(*) as n_clusters, sum(n * log2(n)) as sl, '{{' || string_agg('"' || label || '":' || n, ',' order by label) || '}}' as cluster_distribution from c group by 1, 2),
h as (select *, case when n_clusters = 1 then 0.0 else (log2(n) - sl / n) / log2(greatest(n, 2)) end as e from t) select instance_id, model_name, n, n_clusters, round(e, 9) + 0.0 as entropy, e >= 0.5 as unstable, cluster_distribution from h""")
def entropy_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, JSN-01."""
    return entropy.mesh_entropy(s.grid(spark, sf_dir), CELL).withColumn("entropy", r("entropy"))


@query("entropy_conditional", f"""with {s.GRID}, x as (select instance_id, model_name, k % 4 as ptype, label from g where not is_orig union all select o.instance_id, o.model_name, p.ptype, o.label from (select * from g where is_orig) o join (select distinct instance_id, model_name, k % 4 as ptype from g where not is_orig) p using (instance_id, model_name)),
c as (select instance_id, model_name, ptype, label, count(*) as n from x group by all), t as (select instance_id, model_name, ptype, sum(n)::bigint as n, count(*) as n_clusters, sum(n * log2(n)) as sl from c group by 1, 2, 3)
select instance_id, model_name, ptype, n, n_clusters, round(case when n_clusters = 1 then 0.0 else (log2(n) - sl / n) / log2(greatest(n, 2)) end, 9) + 0.0 as entropy from t""")
def entropy_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, JOI-13."""
    rows = s.grid(spark, sf_dir).withColumn("ptype", F.col("k") % 4)
    return entropy.conditional_entropy(rows, CELL, ["ptype"]).select(*CELL, "ptype", "n", "n_clusters", r("entropy").alias("entropy"))


@query("cluster_entropy", f"""with {s.GRID}, z as (select instance_id, model_name, label, count(*) as size from g group by all), t as (select instance_id, model_name, sum(size)::bigint - 1 as m, count(*) as n_clusters, sum(size)::bigint as total, sum(size * log2(size)) as sl from z group by 1, 2),
h as (select *, case when n_clusters = 1 then 0.0 else log2(total) - sl / total end as e from t) select instance_id, model_name, m, n_clusters, round(e, 9) + 0.0 as entropy, round(case when m > 0 then e / log2(m + 1) else 0 end, 9) + 0.0 as norm_entropy, true as complete from h""")
def cluster_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07."""
    sizes = s.grid(spark, sf_dir).groupBy(*CELL, "label").agg(F.count("*").alias("size"))
    m = sizes.groupBy(*CELL).agg((F.sum("size") - 1).alias("m"))
    return entropy.cluster_entropy(sizes.join(m, CELL), CELL).withColumns({c: r(c) for c in ("entropy", "norm_entropy")})


@query("accuracy_confidence", f"with {s.GRID} select instance_id, model_name, coalesce(max(case when is_orig then (label = case when k % 3 = 0 then 'C1' else 'C0' end and label <> 'UNASSIGNED')::int end), 0) as accuracy, round(avg(confidence) filter (where is_orig), 9) as mapping_confidence from g group by all")
def accuracy_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08."""
    rows = s.grid(spark, sf_dir).withColumn("gold", F.when(F.col("k") % 3 == 0, "C1").otherwise("C0"))
    return entropy.original_accuracy(rows, CELL).withColumn("mapping_confidence", r("mapping_confidence"))


@query("acceptance_semijoin", f"with {s.GRID} select model_name, count(*) as n, count(*) filter (where is_orig) as n_orig from g where is_orig or text_key < 6 group by all")
def acceptance_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, JOI-07."""
    rows = s.grid(spark, sf_dir)
    accepted = rows.where("not is_orig and text_key < 6").select("_ord")
    return entropy.accepted_rows(rows, accepted, ["_ord"]).groupBy("model_name").agg(F.count("*").alias("n"), F.count_if("is_orig").alias("n_orig"))


@query("incremental_antijoin", f"with {s.GRID}, done as (select distinct instance_id, model_name from g where label = 'C2') select instance_id, model_name, count(*) as n from g anti join done using (instance_id, model_name) group by all")
def incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-08."""
    from ..streaming import new_rows

    rows = s.grid(spark, sf_dir)
    return new_rows(rows, rows.where("label = 'C2'"), CELL).groupBy(*CELL).agg(F.count("*").alias("n"))


@query("key_symdiff", f"with {s.GRID}, a as (select distinct instance_id from g where model_name = 'view'), b as (select distinct instance_id from g where model_name = 'purchase') select instance_id, 'left' as side from a anti join b using (instance_id) union all select instance_id, 'right' from b anti join a using (instance_id)")
def key_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-06, SET-03, SET-04."""
    rows = s.grid(spark, sf_dir)
    return receipts.key_differences(rows.where("model_name = 'view'"), rows.where("model_name = 'purchase'"), ["instance_id"])


@query("type_share_pivot", "with t as (select user_id, event_type from events) select user_id, count(*) as n, " + ", ".join(f"round(count(*) filter (where event_type = '{v}') / count(*)::double, 9) as share_{v}" for v in ("view", "click", "purchase", "signup")) + " from t group by 1")
def type_share_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    from ..operators.regress import type_shares

    values = ["view", "click", "purchase", "signup"]
    return type_shares(s.table(spark, sf_dir, "events"), ["user_id"], "event_type", values).withColumns({f"share_{v}": r(f"share_{v}") for v in values})


@query("value_counts", f"with {s.GRID}, c as (select model_name, label, count(*) as n from g group by all) select model_name, label, n, round(n / (sum(n) over (partition by model_name))::double, 9) as share from c")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, AGG-12."""
    n = s.grid(spark, sf_dir).groupBy("model_name", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("model_name"))))


@query("zero_transition", f"with {s.DUAL} select z.raw_zero, z.dedup_zero, coalesce(t.n, 0) as n from (values (true, true), (true, false), (false, true), (false, false)) z(raw_zero, dedup_zero) left join (select is_zero, is_zero_dedup, count(*) as n from dual where retained_m_distinct group by all) t on z.raw_zero = t.is_zero and z.dedup_zero = t.is_zero_dedup")
def zero_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: all four cells are there."""
    both = entropy.retained(entropy.dual_entropy(s.grid(spark, sf_dir), CELL))
    cells = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "raw_zero boolean, dedup_zero boolean")
    n = both.groupBy(F.col("is_zero").alias("raw_zero"), F.col("is_zero_dedup").alias("dedup_zero")).agg(F.count("*").alias("n"))
    return cells.join(n, ["raw_zero", "dedup_zero"], "left").select("raw_zero", "dedup_zero", F.coalesce("n", F.lit(0)).alias("n"))


ACCURACY = "acc as (select instance_id, model_name, max(case when is_orig then (label = 'C0')::int end) as accuracy from g group by all)"


def dissociated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.grid(spark, sf_dir)
    cells = entropy.retained(entropy.dual_entropy(rows, CELL)).where("entropy is not null")
    right = rows.groupBy(*CELL).agg(F.max(F.when(F.col("is_orig"), (F.col("label") == "C0").cast("int"))).alias("accuracy"))
    return cells.join(right, CELL).withColumn("stable", F.col("entropy") == 0)


@query("dissociation_2x2", f"with {s.DUAL}, {ACCURACY}, x as (select model_name, normalised_entropy_dedup = 0 as stable, accuracy = 1 as correct from dual join acc using (instance_id, model_name) where retained_m_distinct and normalised_entropy_dedup is not null) select model_name, count(*) filter (where stable and correct) as stable_correct, count(*) filter (where stable and not correct) as stable_wrong, count(*) filter (where not stable and correct) as unstable_correct, count(*) filter (where not stable and not correct) as unstable_wrong, round(case when count(*) filter (where stable) > 0 then count(*) filter (where stable and not correct) / (count(*) filter (where stable))::double end, 9) as wrong_given_stable from x group by 1")
def dissociation_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05, AGG-16."""
    x, ok = F.col("stable"), F.col("accuracy") == 1
    return dissociated(spark, sf_dir).groupBy("model_name").agg(F.count_if(x & ok).alias("stable_correct"), F.count_if(x & ~ok).alias("stable_wrong"), F.count_if(~x & ok).alias("unstable_correct"), F.count_if(~x & ~ok).alias("unstable_wrong"), r(F.try_divide(F.count_if(x & ~ok), F.count_if(x))).alias("wrong_given_stable"))


WILSON = lambda k, n: f"(({k} / {n}::double + 3.8414588206941245 / (2 * {n})) %s 1.959963984540054 * sqrt({k} / {n}::double * (1 - {k} / {n}::double) / {n} + 3.8414588206941245 / (4.0 * {n} * {n}))) / (1 + 3.8414588206941245 / {n})"


@query("wilson_newcombe", f"""with {s.SELECTION}, c as (select lang, count(*) as n1, sum(correct)::bigint as k1, (select count(*) from sel) as n2, (select sum(correct)::bigint from sel) as k2 from sel group by 1), w as (select *, {WILSON('k1', 'n1') % '-'} as l1, {WILSON('k1', 'n1') % '+'} as u1, {WILSON('k2', 'n2') % '-'} as l2, {WILSON('k2', 'n2') % '+'} as u2 from c)
select lang, n1 as n, k1 as hits, round(l1, 9) as ci_low, round(u1, 9) as ci_high, round(k1 / n1::double - k2 / n2::double - sqrt((k1 / n1::double - l1) ** 2 + (u2 - k2 / n2::double) ** 2), 9) as diff_low, round(k1 / n1::double - k2 / n2::double + sqrt((u1 - k1 / n1::double) ** 2 + (k2 / n2::double - l2) ** 2), 9) as diff_high from w""")
def wilson_newcombe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-08: a language's share of good texts, and its difference from all."""
    rows = s.selection(spark, sf_dir)
    whole = rows.agg(F.count("*").alias("n2"), F.sum("correct").alias("k2"))
    made = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("correct").alias("hits")).crossJoin(F.broadcast(whole))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    d_low, d_high = stats.newcombe(F.col("hits"), F.col("n"), F.col("k2"), F.col("n2"))
    return made.select("lang", "n", "hits", r(low).alias("ci_low"), r(high).alias("ci_high"), r(d_low).alias("diff_low"), r(d_high).alias("diff_high"))


@query("concept_ids", "with x as (select event_id, case event_id % 6 when 0 then 'UMLS:C00' || (event_id % 90) when 1 then 'C' || event_id when 2 then 'NA' when 3 then ' nan ' when 4 then 'aspirin' else '' end as raw from events) select event_id, case when regexp_replace(trim(raw), '^UMLS:', '') in ('', 'NA', 'nan', 'None') then 'UNASSIGNED' else regexp_replace(trim(raw), '^UMLS:', '') end as concept, regexp_full_match(trim(raw), '(?i)(UMLS:)?C[0-9]+') as direct from x")
def concept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-02."""
    i = F.col("event_id")
    raw = F.when(i % 6 == 0, F.concat(F.lit("UMLS:C00"), (i % 90).cast("string"))).when(i % 6 == 1, F.concat(F.lit("C"), i.cast("string"))).when(i % 6 == 2, "NA").when(i % 6 == 3, " nan ").when(i % 6 == 4, "aspirin").otherwise("")
    return s.table(spark, sf_dir, "events").select("event_id", scalar.norm_concept(raw).alias("concept"), scalar.is_direct_concept(raw).alias("direct"))


@query("variant_ids", f"with {s.GRID}, v as (select *, row_number() over (partition by instance_id, model_name order by _ord) as k1 from g where not is_orig) select _ord, instance_id || '_p' || lpad(k1::varchar, 2, '0') as variant_id from v union all select _ord, instance_id || '_orig' from g where is_orig")
def variant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03, PRJ-04, PRJ-11, WIN-01."""
    rows = s.grid(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy(*CELL).orderBy("_ord"))
    variants = rows.where("not is_orig").withColumn("_k", k).select("_ord", scalar.variant_id(F.col("instance_id"), F.col("_k")).alias("variant_id"))
    return variants.unionByName(rows.where("is_orig").select("_ord", scalar.variant_id(F.col("instance_id"), F.lit(None).cast("int")).alias("variant_id")))


SIGNED = lambda source, by: f"""sg as (select *, rank() over (partition by {by} order by abs(d)) + (count(*) over (partition by {by}, abs(d)) - 1) / 2.0::double as rk, count(*) over (partition by {by}, abs(d)) as t from {source} where d <> 0),
sr as (select {by}, count(*) as n_used, coalesce(sum(rk) filter (where d > 0), 0) as tp, coalesce(sum(rk) filter (where d < 0), 0) as tm, sum(t::double * t - 1) as ties from sg group by {by}),
ss as (select {by}, n_used, tp as t_plus, tm as t_minus, (tp - tm) / (tp + tm) as rank_biserial, (tp - n_used * (n_used + 1) / 4.0::double) / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24.0::double - ties / 48) as z from sr)"""  # noqa: E731

PAIR_SQL = f"{s.ORDER_PAIRS}, dp as (select 'urgent-low' as pair, a.instance, a.value - b.value as d from op a join op b on a.instance = b.instance and a.model = '1-URGENT' and b.model = '5-LOW' union all select 'high-medium', a.instance, a.value - b.value from op a join op b on a.instance = b.instance and a.model = '2-HIGH' and b.model = '3-MEDIUM')"


def order_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.order_pairs(spark, sf_dir)
    pair = lambda name, a, b: stats.paired(rows, [], ["instance"], "model", a, b, "value").withColumn("pair", F.lit(name))
    return pair("urgent-low", "1-URGENT", "5-LOW").unionByName(pair("high-medium", "2-HIGH", "3-MEDIUM"))


@query("rank_biserial", f"with {PAIR_SQL},\n{SIGNED('dp', 'pair')} select pair, n_used, t_plus, t_minus, round(rank_biserial, 9) + 0.0 as rank_biserial, round(z, 9) + 0.0 as z from ss")
def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-01, STA-02, JOI-04, WIN-09."""
    return stats.signed_ranks(order_differences(spark, sf_dir), ["pair"]).withColumns({c: r(c) for c in ("rank_biserial", "z")})


@query("matched_pairs", f"""with {s.DUAL}, e as (select instance_id, model_name, normalised_entropy_dedup as h from dual where retained_m_distinct and normalised_entropy_dedup is not null),
dp as (select 'purchase-view' as pair, a.h - b.h as d from e a join e b on a.instance_id = b.instance_id and a.model_name = 'purchase' and b.model_name = 'view' union all select 'signup-click', a.h - b.h from e a join e b on a.instance_id = b.instance_id and a.model_name = 'signup' and b.model_name = 'click'),
{SIGNED('dpr', 'pair').replace('from dpr', 'from (select pair, round(d, 12) as d from dp)')} select pair, n_used, round(rank_biserial, 9) + 0.0 as rank_biserial, round(z, 9) + 0.0 as z, abs(rank_biserial) >= 0.1 as large from ss""")
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: is one model of a pair more stable than the other? FLT-06, JOI-04, STA-01, STA-02."""
    cells = entropy.retained(entropy.dual_entropy(s.grid(spark, sf_dir), CELL))
    pair = lambda name, a, b: stats.paired(cells, [], ["instance_id"], "model_name", a, b, "entropy").select(F.lit(name).alias("pair"), F.round("d", 12).alias("d"))
    both = pair("purchase-view", "purchase", "view").unionByName(pair("signup-click", "signup", "click"))
    made = stats.signed_ranks(both, ["pair"])
    return made.select("pair", "n_used", r("rank_biserial").alias("rank_biserial"), r("z").alias("z"), (F.abs("rank_biserial") >= 0.1).alias("large"))


@query("vector_topk", f"with {s.VECTORS} select query_id, form_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, form_id)::int as rank from scores) where rank <= 1000")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-03 by block products."""
    q, f = s.vectors(spark, sf_dir)
    return retrieval.topk(q, f).withColumn("score", r("score", 6))


@query("vector_argmax", f"with {s.VECTORS} select query_id, form_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, form_id) as k from scores) where k = 1")
def vector_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-02, JOI-17."""
    return retrieval.nearest(*s.vectors(spark, sf_dir)).withColumn("score", r("score", 6))


TOP = f"{s.VECTORS}, top as (select query_id as qid, form_id as form, cui, score from scores qualify row_number() over (partition by query_id order by score desc, form_id) <= 1000), pred as (select qid, arg_max(cui, {{'s': score, 'f': -form}}) as pred, max(score) as s1 from top group by 1)"


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retrieved (qid, form, score), (form, cui), and the best concept of each query (qid, pred, s1)."""
    q, f = s.vectors(spark, sf_dir)
    top = retrieval.topk(q, f).select(F.col("query_id").alias("qid"), F.col("form_id").alias("form"), "score")
    forms = f.select(F.col("form_id").alias("form"), "cui")
    pred = top.join(forms, "form").groupBy("qid").agg(F.max_by("cui", F.struct("score", -F.col("form"))).alias("pred"), F.max("score").alias("s1"))
    return top, forms, pred


@query("runner_up_margin", f"with {TOP}, f as (select t.qid, form, max(score) as score, bool_or(cui = pred) as own from top t join pred using (qid) group by 1, 2), s2 as (select qid, max(score) filter (where not own) as s2 from f group by 1) select qid, pred, round(s1, 6) as s1, round(coalesce(s2, 0), 6) as s2, round(s1 - coalesce(s2, 0), 6) as margin from pred left join s2 using (qid)")
def runner_up_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-01, JOI-09."""
    top, forms, pred = found(spark, sf_dir)
    return concepts.runner_up(pred, top, forms).withColumns({c: r(c, 6) for c in ("s1", "s2", "margin")})


@query("top_two_concepts", f"with {TOP}, b as (select qid, cui, max(score) as s from top group by 1, 2), k as (select *, row_number() over (partition by qid order by s desc, cui) as k from b) select qid, max(cui) filter (where k = 1) as cui1, round(max(s) filter (where k = 1), 6) as s1, max(cui) filter (where k = 2) as cui2, round(coalesce(max(s) filter (where k = 2), 0), 6) as s2, round(max(s) filter (where k = 1) - coalesce(max(s) filter (where k = 2), 0), 6) as margin from k group by 1")
def top_two_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-04."""
    top, forms, _ = found(spark, sf_dir)
    return concepts.top_two(top, forms).withColumns({c: r(c, 6) for c in ("s1", "s2", "margin")})


ASSIGN_SQL = f"""with {s.VECTORS.replace("list_dot_product(q.embedding::double[], f.embedding::double[])", "0.5 + round(list_dot_product(q.embedding::double[], f.embedding::double[]), 6) / 2")},
top as (select query_id as qid, form_id as form, cui, score from scores qualify row_number() over (partition by query_id order by score desc, form_id) <= 1000),
nf as (select 'C' || lpad(label::varchar, 7, '0') as cui, count(*) as n_forms, label % 3 <> 0 as in_type from embeddings group by label),
c0 as (select qid, cui, max(score) as score from top where (qid // 100) % 5 <> 4 group by all), ex as (select vec_id as qid, 'C' || lpad(((label + vec_id // 100) % 10)::varchar, 7, '0') as cui from embeddings where vec_id % 100 = 0 and (vec_id // 100) % 2 = 0),
b as (select coalesce(c0.qid, ex.qid) as qid, coalesce(c0.cui, ex.cui) as cui, c0.score, ex.cui is not null as is_exact, c0.score is not null as was_found from c0 full join ex on c0.qid = ex.qid and c0.cui = ex.cui),
w as (select b.*, n_forms, in_type, bool_or(was_found) over (partition by qid) as any_found, bool_or(is_exact and was_found) over (partition by qid) as hit, bool_or(is_exact) over (partition by qid) as has_exact from b join nf using (cui)),
w1 as (select *, coalesce(score, 1.0) as sc, case when hit then 'exact_match' when has_exact then 'exact_match_inject' else 'no_exact_match' end as rule1 from w where any_found and case when hit then is_exact and was_found else true end),
w2 as (select *, bool_or(in_type) over (partition by qid) as any_type from w1), w3 as (select *, max(sc) over (partition by qid) as best from w2 where in_type or not any_type),
w4 as (select *, count(*) over (partition by qid, n_forms, sc) as ties, row_number() over (partition by qid order by n_forms desc, sc desc, cui) as k from w3 where best - sc <= 0.02),
won as (select * from w4 where k = 1), q as (select vec_id as qid, case when (vec_id // 100) % 5 = 3 then 'C' || lpad(label::varchar, 7, '0') end as direct from embeddings where vec_id % 100 = 0)
select q.qid, case when direct is not null then direct when won.qid is null or best < 0.7 then 'UNASSIGNED' else cui end as predicted_cui, round(case when direct is not null then 1.0 when won.qid is null then 0.0 when best < 0.7 then best else sc end, 7) as confidence,
  case when direct is not null then 'direct_cui' when won.qid is null then 'faiss_empty' else concat_ws('+', rule1, case when any_type then 'st21pv' else 'st21pv_skip' end, 'encoder_cosine', case when best < 0.7 then 'below_thresh_0.7' else 'freq_tiebreak' end) end as assign_rule_path,
  case when direct is not null or won.qid is null or best < 0.7 then 1 else ties end::bigint as ties from q left join won using (qid)"""


@query("five_rule_assign", ASSIGN_SQL)
def five_rule_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASG-00 to ASG-08."""
    q, f = s.vectors(spark, sf_dir)
    e = s.table(spark, sf_dir, "embeddings")
    name = lambda x: F.concat(F.lit("C"), F.lpad(x.cast("string"), 7, "0"))
    kinds = e.groupBy(name(F.col("label")).alias("cui")).agg(F.count("*").alias("n_forms"), (F.max("label") % 3 != 0).alias("in_type"))
    top = retrieval.topk(q, f.select("form_id", "vector")).join(f.select("form_id", "cui"), "form_id").where("query_id div 100 % 5 != 4")
    candidates = top.select(F.col("query_id").alias("qid"), "cui", (F.lit(0.5) + F.round("score", 6) / 2).alias("score")).join(kinds, "cui")
    own = e.where("vec_id % 100 = 0").withColumn("no", F.expr("vec_id div 100"))
    exact = own.where("no % 2 = 0").select(F.col("vec_id").alias("qid"), name((F.col("label") + F.col("no")) % 10).alias("cui")).join(kinds, "cui")
    queries = own.select(F.col("vec_id").alias("qid"), F.when(F.col("no") % 5 == 3, name(F.col("label"))).alias("direct"))
    return concepts.assign(queries, candidates, exact).withColumn("confidence", r("confidence", 7))


@query("margin_aggregate", f"with {s.GRID}, x as (select *, case when label <> 'UNASSIGNED' then confidence - (k % 7) end as margin, confidence as s1, (k % 7)::double as s2 from g) select instance_id, model_name, count(margin) as n_retrieval_rows, round(arg_min(margin, _ord) filter (where is_orig and margin is not null), 9) + 0.0 as margin_original, round(avg(margin), 9) + 0.0 as margin_mean, round(min(margin), 9) + 0.0 as margin_min, round(avg(s1), 9) as s1_mean, round(avg(s2), 9) as s2_mean from x group by all")
def margin_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-05, FLT-08."""
    rows = s.grid(spark, sf_dir).withColumns({"s1": F.col("confidence"), "s2": (F.col("k") % 7).cast("double")}).withColumn("margin", F.when(F.col("label") != UNASSIGNED, F.col("s1") - F.col("s2")))
    return concepts.margin_summary(rows, CELL).withColumns({c: r(c) for c in ("margin_original", "margin_mean", "margin_min", "s1_mean", "s2_mean")})


@query("subtree_filter", r"with p as (select page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages) select page_id, path, path = 'en' or starts_with(path, 'en/') or path = 'de' or starts_with(path, 'de/') as in_subtree from p")
def subtree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POOL-02."""
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    return s.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), concepts.below(path, ["en", "de"], "/").alias("in_subtree"))


@query("pool_build", "with n as (select 'C' || p_size as cui, p_name as form, p_brand as sab, p_type as tty from part), f as (select cui, list_sort(list_distinct(list(form))) as f, list_sort(list_distinct(list(sab || '/' || tty))) as st from n group by 1), t as (select cui, string_agg(distinct tty, '|' order by tty) as tuis, bool_or(tty = 'BRASS') as hit from n group by 1) select f.cui, len(f.f) as n_forms, f.f[1] as first_form, array_to_string(f.st, '|') as sab_tty, t.tuis, t.hit as in_subtree from f join t using (cui)")
def pool_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POOL-01, POOL-02."""
    p = s.table(spark, sf_dir, "part").select(F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("cui"), F.col("p_name").alias("form"), F.col("p_brand").alias("sab"), F.col("p_type").alias("tty"))
    pool = concepts.build_pool(p, p.select("cui", F.col("tty").alias("tui"), F.col("tty").alias("stn")), ["BRASS"])
    return pool.select("cui", F.size("surface_forms").cast("long").alias("n_forms"), F.element_at("surface_forms", 1).alias("first_form"), F.array_join("sab_tty", "|").alias("sab_tty"), F.array_join("tuis", "|").alias("tuis"), "in_subtree")


@query("threshold_band", f"with {s.GRID} select model_name, count(*) as n, count(*) filter (where abs(confidence - 50) <= 1) as within_1, count(*) filter (where abs(confidence - 50) <= 2) as within_2, count(*) filter (where abs(confidence - 50) <= 5) as within_5, round(min(abs(confidence - 50)), 6) as nearest from g group by 1")
def threshold_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, SRT-03."""
    off = F.abs(F.col("confidence") - 50)
    return s.grid(spark, sf_dir).groupBy("model_name").agg(F.count("*").alias("n"), *[F.count_if(off <= k).alias(f"within_{k}") for k in (1, 2, 5)], r(F.min(off), 6).alias("nearest"))


@query("sparse_cells", f"with {s.GRID}, few as (select user, label from (select split_part(instance_id, '-', 1) as user, label, instance_id from g) group by 1, 2 having count(distinct instance_id) < 3) select split_part(g.instance_id, '-', 1) as user, g.label, count(*) as n from g anti join few on split_part(g.instance_id, '-', 1) = few.user and g.label = few.label group by 1, 2")
def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14."""
    rows = s.grid(spark, sf_dir).withColumn("user", F.split_part("instance_id", F.lit("-"), F.lit(1)))
    return perturb.sparse_removed(rows, ["user", "label"], "instance_id").groupBy("user", "label").agg(F.count("*").alias("n"))


@query("diversity_rescue", f"with {s.GRID}, x as (select k % 30 as ptype, _ord, confidence, text_key < 2 and k % 30 < 12 as acc from g), none as (select ptype from x group by 1 having not bool_or(acc)) select ptype, arg_max(_ord, {{'c': confidence, 'o': -_ord}}) as _ord, max(confidence) as confidence from x semi join none using (ptype) group by 1")
def diversity_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04."""
    rows = s.grid(spark, sf_dir).withColumns({"ptype": F.col("k") % 30, "acc": (F.col("text_key") < 2) & (F.col("k") % 30 < 12)})
    return perturb.rescued(rows, "ptype", "acc", "confidence", "_ord")


@query("kept_attempts", f"with {s.GRID}, x as (select *, row_number() over (partition by instance_id, model_name order by _ord) as attempt, k < 30 as accepted from g) select instance_id, model_name, attempt, accepted from x where attempt <= 3 qualify row_number() over (partition by instance_id, model_name order by (not accepted)::int, case when accepted then attempt else -attempt end) = 1")
def kept_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRT-05: the first accepted attempt, else the last."""
    k = F.row_number().over(Window.partitionBy(*CELL).orderBy("_ord"))
    rows = s.grid(spark, sf_dir).withColumn("attempt", k.cast("long")).where("attempt <= 3").withColumn("accepted", F.col("k") < 30)
    return perturb.kept_attempts(rows, CELL).select(*CELL, "attempt", "accepted")


@query("collision_analysis", f"with {s.GRID}, ch as (select instance_id, model_name, _ord, case label when 'C0' then 'C1' else 'C0' end as new_label from g where k % 5 = 0) select instance_id, model_name, _ord, new_label, exists (select 1 from g where g.instance_id = ch.instance_id and g.model_name = ch.model_name and g._ord <> ch._ord and g.label = ch.new_label) as collides from ch")
def collision_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COL-01."""
    rows = s.grid(spark, sf_dir)
    changed = rows.where("k % 5 = 0").select(*CELL, "_ord", F.when(F.col("label") == "C0", "C1").otherwise("C0").alias("new_label"))
    return perturb.collisions(rows, changed, CELL, "_ord", "label")


#: Neighbours that the index is asked for, and the share of the best by which its probes are chosen on some queries.
INDEX_K, INDEX_RECALL = 10, 0.95


@query("vector_index_recall")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-04: per query the share of its exact ten best that the nearest cells hold, as many as reach 0.95 on a sample; the index's
    cells are its own, so SQL has none."""
    q, f = s.vectors(spark, sf_dir)
    index = ivf.build(f.select("form_id", "vector"))
    found = ivf.search(index, q, INDEX_K, ivf.probes_for(index, q, INDEX_K, INDEX_RECALL)).select("query_id", "form_id", F.lit(1).alias("hit"))
    exact = retrieval.topk(q, f, INDEX_K)
    return exact.join(found, ["query_id", "form_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


@query("vector_index_exact", f"with {s.VECTORS} select query_id, form_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, form_id)::int as rank from scores) where rank <= {INDEX_K}")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-04 with its exact completion: few cells first, then those whose bound leaves a better form possible."""
    q, f = s.vectors(spark, sf_dir)
    return ivf.search(ivf.build(f.select("form_id", "vector")), q, INDEX_K, n=4, exact=True).withColumn("score", r("score", 6))
