"""Queries of features, selectors, controls, exact matches, and of sources and sinks through files that the query writes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cuts, perturb, reports
from ..sources import readers, sinks
from . import standins as s
from .concept_lane import r
from .quality import BARE
from .registry import query


@query("instance_features", f"with {s.GRID} select instance_id, count(*) as n_accepted_perts, round(avg(confidence), 9) as mean_change, max(confidence) as max_change, round(avg(k % 6), 9) as mean_changed_tokens_n, length(arg_min(label, _ord))::int as mention_char_len from g where not is_orig group by 1")
def instance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14."""
    rows = s.grid(spark, sf_dir).where("not is_orig").withColumn("changed", F.col("k") % 6)
    return reports.instance_features(rows, ["instance_id"], "confidence", "changed", "label").withColumns({c: r(c) for c in ("mean_change", "mean_changed_tokens_n")})


@query("type_diagnostics", f"with {s.GRID} select k % 5 as kind, count(*) as n, sum((text_key < 6)::int)::bigint as n_accepted, round(avg(confidence), 9) as mean_change, round(quantile_cont(confidence, 0.5), 9) as median_change, round(1 - avg((text_key < 6)::int), 9) as fail_rate from g group by 1")
def type_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18."""
    rows = s.grid(spark, sf_dir).select((F.col("k") % 5).alias("kind"), (F.col("text_key") < 6).alias("accepted"), "confidence")
    return reports.type_diagnostics(rows, "kind", "accepted", "confidence").withColumns({c: r(c) for c in ("mean_change", "median_change", "fail_rate")})


@query("column_mode", f"with {s.GRID}, c as (select instance_id, case when k % 9 > 0 then label end as v, count(*) as n from g group by 1, 2), b as (select * from c where v is not null qualify row_number() over (partition by instance_id order by n desc, v) = 1) select i.instance_id, coalesce(v, 'N/A') as mode from (select distinct instance_id from g) i left join b using (instance_id)")
def column_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25."""
    return reports.column_mode(s.grid(spark, sf_dir).withColumn("v", F.when(F.col("k") % 9 > 0, F.col("label"))), ["instance_id"], "v")


@query("scope_values", f"with {s.GRID}, x as (select case when k % 10 = 0 then 'none' when k % 10 = 1 then null else k::varchar end as v from g), t as (select sum(coalesce(try_cast(v as double), 0)::bigint)::double as a, avg(try_cast(v as double)) as b, count(*)::double as c from x) select 'sum_int' as agg, a as value from t union all select 'mean', round(b, 9) from t union all select 'rows', c from t")
def scope_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23."""
    k = F.col("k")
    rows = s.grid(spark, sf_dir).select(F.when(k % 10 == 0, "none").when(k % 10 == 1, None).otherwise(k.cast("string")).alias("v"))
    return reports.scope_values(rows, "v").withColumn("value", r("value"))


PAIR_ROWS = "p as (select n_name as pair, case n_nationkey % 2 when 0 then 'POOLED' else 'corpus' end as dataset, n_nationkey * 0.5::double as value from nation)"


@query("selected_rows", f"with {PAIR_ROWS} select 'first' as what, pair, dataset, value from (select * from p where dataset = 'corpus' order by pair limit 1) union all select 'third', pair, dataset, value from (select * from p where dataset = 'corpus' order by pair limit 1 offset 2) union all select 'named', pair, dataset, value from p where dataset = 'POOLED' and pair = (select n_name from nation where n_nationkey = 4)")
def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-12, WIN-11."""
    n = s.table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_name").alias("pair"), F.when(F.col("n_nationkey") % 2 == 0, "POOLED").otherwise("corpus").alias("dataset"), (F.col("n_nationkey") * 0.5).alias("value"))
    name = n.where("n_nationkey = 4").first()["n_name"]
    picks = {"first": reports.selected(rows, {"dataset": "corpus"}, ["pair", "dataset"], ["pair"], 1), "third": reports.selected(rows, {"dataset": "corpus"}, ["pair", "dataset"], ["pair"], 3), "named": reports.selected(rows, {"dataset": "POOLED", "pair": name}, ["pair", "dataset"])}
    out = None
    for what, pick in picks.items():
        one = pick.select(F.lit(what).alias("what"), "pair", "dataset", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("prompts", f"""with {s.TURNS} select conv_id, turn, md5(case when turn % 2 = 0 and gold <> '' then 'Answer the question using only the context. Reply with a short answer span only. If the question is unanswerable from the context, reply with ''unanswerable''.' || chr(10) || chr(10) || 'Context: ' || gold || chr(10) || chr(10) || 'Question: ' || pred || chr(10) || chr(10) || 'Answer:' else 'Answer the biomedical factoid question with a short exact answer only. Do not explain.' || chr(10) || chr(10) || 'Question: ' || pred || chr(10) || chr(10) || 'Answer:' end) as prompt from qa""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16."""
    context = F.when(F.col("turn") % 2 == 0, F.col("gold"))
    return s.turns(spark, sf_dir).select("conv_id", "turn", F.md5(reports.prompt(F.col("pred"), context)).alias("prompt"))


@query("rule_branches", f"with {s.GRID}, x as (select case when k % 3 = 0 then 'no_exact_match+st21pv' when k % 3 = 1 then 'exact_match_inject+x' else 'faiss_empty' end as path from g) select split_part(path, '+', 1) as branch, contains(path, 'inject') as injected, count(*) as n from x group by all")
def rule_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17."""
    k = F.col("k")
    path = F.when(k % 3 == 0, "no_exact_match+st21pv").when(k % 3 == 1, "exact_match_inject+x").otherwise("faiss_empty")
    return s.grid(spark, sf_dir).groupBy(reports.rule_branch(path).alias("branch"), F.contains(path, F.lit("inject")).alias("injected")).agg(F.count("*").alias("n"))


@query("flat_answers", f"with {s.TURNS} select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(pred, ' '), lambda a: {BARE('a')}), lambda a: a <> ''))), '|') as answers from qa")
def flat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18: sorted for comparison; the suite has the order by hand."""
    return s.turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(reports.flat_answers(F.split("pred", " "))), "|").alias("answers"))


@query("negative_controls", f"with {s.GRID}, {s.entropy_sql('g', 'instance_id model_name', 'e')}, m as (select model_name, avg(normalised_entropy) as h from e group by 1) select model_name, round(h, 9) as mean_identical, coalesce(h > 0.05, false) as excluded from m")
def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-26."""
    from ..operators.entropy import label_entropy

    made = label_entropy(s.grid(spark, sf_dir), s.CELL)
    return reports.negative_controls(made, "model_name", "normalised_entropy").withColumn("mean_identical", r("mean_identical"))


@query("quartile_contrast", f"with {s.SELECTION}, q as (select lang, quantile_cont(confidence, 0.75) as t, quantile_cont(confidence, 0.25) as b from sel group by 1), m as (select lang, count(*) filter (where confidence >= t) as n_top, count(*) filter (where confidence <= b) as n_bottom, avg(entropy) filter (where confidence >= t) as x, avg(entropy) filter (where confidence <= b) as y from sel join q using (lang) group by 1) select lang, n_top, n_bottom, round(x, 9) as mean_top, round(y, 9) as mean_bottom, round(x - y, 9) + 0.0 as difference from m")
def quartile_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-30."""
    return reports.quartile_contrast(s.selection(spark, sf_dir), ["lang"], "confidence", "entropy").withColumns({c: r(c) for c in ("mean_top", "mean_bottom", "difference")})


@query("exact_lookup", "with f as (select p_name as form, 'C' || p_size as cui from part), q as (select p_partkey as qid, '  ' || upper(p_name) as text from part) select distinct qid, cui from q join f on lower(trim(q.text)) = lower(trim(f.form))")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-10."""
    p = s.table(spark, sf_dir, "part")
    forms = p.select(F.col("p_name").alias("form"), F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("cui"))
    queries = p.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("  "), F.upper("p_name")).alias("text"))
    return reports.exact_matches(queries, forms)


@query("rescored_forms", f"with {s.VECTORS} select query_id, form_id, round(score, 6) + 0.0 as score from scores where form_id % 13 = query_id % 13 and length(form_id::varchar) >= 3")
def rescored_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-06."""
    q, f = s.vectors(spark, sf_dir)
    found = f.select("form_id").withColumn("m", F.col("form_id") % 13).join(q.select("query_id", (F.col("query_id") % 13).alias("m")), "m")
    return reports.rescored(found, q, f.withColumn("form", F.col("form_id").cast("string"))).withColumn("score", r("score", 6))


@query("preferred_pool", "select count(distinct p_name) as n_forms, count(distinct p_size) as n_concepts from part where p_type = (select min(p_type) from part) and length(trim(p_name)) >= 3 and regexp_matches(p_name, '[A-Za-z]')")
def preferred_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-08."""
    p = s.table(spark, sf_dir, "part")
    kind = p.agg(F.min("p_type")).first()[0]
    pool = reports.preferred(p.select(F.col("p_name").alias("form"), F.col("p_size").alias("cui"), F.col("p_type").alias("tty")), (kind,))
    return pool.agg(F.count_distinct("form").alias("n_forms"), F.count_distinct("cui").alias("n_concepts"))


@query("final_acceptance", f"with {s.GRID} select _ord, k > 20 and confidence > 10 and k % 7 <> 0 and not (k % 3 = 0 and k % 2 = 0) as accepted from g")
def final_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-7: all gates, an unknown one failing, and no fallback that changed nothing."""
    k = F.col("k")
    noop = perturb.no_op(F.lit("a b"), F.when(k % 2 == 0, " a b ").otherwise("b"), k % 3 == 0)
    gates = [k > 20, F.col("confidence") > 10, F.when(k % 7 != 0, F.lit(True))]
    return s.grid(spark, sf_dir).select("_ord", perturb.accepted_final(gates, noop).alias("accepted"))


@query("gate_similarity")
def gate_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-1c without an embedder: TF-IDF of words and pairs; the suite has it by hand."""
    return s.turns(spark, sf_dir).select("conv_id", "turn", r(perturb.tfidf_cosine("pred", "gold")).alias("similarity"))


@query("csv_round_trip", "select event_id, value, 'a \"q\" \\' || chr(10) || props as text from events")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SRC-09, SRC-10, SRC-18: quotes, backslashes and line ends in cells, doubles to the last bit."""
    where = cuts.folder(spark, "csv")
    sinks.write_csv(s.table(spark, sf_dir, "events").select("event_id", "value", F.concat(F.lit('a "q" \\\n'), "props").alias("text")), where)
    return sinks.read_csv(spark, where, "event_id long, value double, text string")


def _lines(spark: SparkSession, lines: DataFrame, what: str) -> str:
    where = cuts.folder(spark, what)
    lines.write.text(where)
    return where


@query("rrf_names", "select 'C' || p_size as cui, p_brand as sab, p_type as tty, p_partkey::varchar as code, p_name as form from part where p_partkey % 5 <> 0 and p_partkey % 3 <> 0")
def rrf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01."""
    p, k = s.table(spark, sf_dir, "part"), F.col("p_partkey")
    blank = lambda n: [F.lit("x")] * n
    cells = [F.concat(F.lit("C"), F.col("p_size").cast("string")), F.when(k % 5 == 0, "GER").otherwise("ENG"), *blank(9), F.col("p_brand"), F.col("p_type"), k.cast("string"), F.col("p_name"), F.lit("0"), F.when(k % 3 == 0, "O").otherwise("N"), F.lit("")]
    return readers.rrf_names(spark, _lines(spark, p.select(F.concat_ws("|", *cells)), "rrf")).drop("_ord")


@query("first_codes", "select p_brand as code, min(p_partkey) as cui from part where p_partkey % 2 = 0 group by 1")
def first_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: the first line of a code counts; lines come in the order of their files."""
    p, k = s.table(spark, sf_dir, "part"), F.col("p_partkey")
    blank = lambda n: [F.lit("x")] * n
    cells = [k.cast("string"), F.lit("ENG"), *blank(9), F.when(k % 2 == 0, "SNOMEDCT_US").otherwise("MSH"), F.lit("PT"), F.col("p_brand"), F.col("p_name"), F.lit("0"), F.lit("N"), F.lit("")]
    where = _lines(spark, p.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select(F.concat_ws("|", *cells)), "codes")
    return readers.code_map(readers.rrf_names(spark, where)).select("code", F.col("cui").cast("long").alias("cui"))


@query("first_types", "select s_nationkey::varchar as cui, 'T' || min(s_suppkey) as tui from supplier where s_nationkey % 3 = 0 group by 1")
def first_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SRC-04."""
    t = s.table(spark, sf_dir, "supplier")
    cells = [F.col("s_nationkey").cast("string"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")), F.lit("A1.2"), F.lit("Type"), F.lit("")]
    where = _lines(spark, t.repartitionByRange("s_suppkey").sortWithinPartitions("s_suppkey").select(F.concat_ws("|", *cells)), "types")
    needed = t.where("s_nationkey % 3 = 0").select(F.col("s_nationkey").cast("string").alias("cui"))
    return readers.first_types(readers.rrf_types(spark, where), needed)


@query("pubtator", "select c_custkey::varchar as pmid, c_name || ' of ' || c_mktsegment as text, 0 as start, length(c_name)::int as \"end\", c_name as mention, 'T1' as types, 'C' || c_nationkey as cui from customer union all select c_custkey::varchar, c_name || ' of ' || c_mktsegment, length(c_name)::int + 4, (length(c_name) + 4 + length(c_mktsegment))::int, c_mktsegment, 'T2', 'C99' from customer where c_custkey % 2 = 0")
def pubtator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05."""
    c = s.table(spark, sf_dir, "customer")
    pmid, name, rest = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    at = F.char_length(name)
    first = F.concat_ws("\t", pmid, F.lit("0"), at.cast("string"), name, F.lit("T1"), F.concat(F.lit("UMLS:C"), F.col("c_nationkey").cast("string")))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n"), F.concat_ws("\t", pmid, (at + 4).cast("string"), (at + 4 + F.char_length(rest)).cast("string"), rest, F.lit("T2"), F.lit("UMLS:C99")))).otherwise("")
    block = F.concat(pmid, F.lit("|t|"), name, F.lit("\n"), pmid, F.lit("|a|of "), rest, F.lit("\n"), first, second, F.lit("\n"))
    return readers.pubtator(spark, _lines(spark, c.select(block), "pubtator"))


@query("replaced_table", "select r_regionkey, r_name from region where r_regionkey > 1")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: a table put in place of another, and read."""
    rows, where = s.table(spark, sf_dir, "region"), cuts.folder(spark, "replaced")
    for least in (-1, 0, 1):
        sinks.replace(rows.where(F.col("r_regionkey") > least), where)
    return sinks.current(spark, where)
