"""Queries of texts, gates, answers, and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import entropy, perturb, qa, receipts
from ..operators.running import running
from ..providers import LexicalNli
from . import standins as s
from .concept_lane import CELL, r
from .registry import query

#: White space and words in SQL's patterns, which know no Unicode of their own.
BLANKS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}\p{M}_]"
LINE = lambda x: f"regexp_replace({x}, '{BLANKS}+', ' ', 'g')"
BARE = lambda x: f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"
PLAIN = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')"
OTHER = "[^" + WORD[1:]


def NORMAL(x: str) -> str:  # noqa: N802
    """SQL of squad_normalise()."""
    words = f"list_transform(regexp_extract_all({PLAIN(x)}, '{WORD}+|{OTHER}+'), lambda t: case when t in ('a', 'an', 'the') then ' ' else t end)"
    joined = f"array_to_string({words}, '')"
    return f"trim({LINE(joined)})"


QA_TURNS = f"{s.TURNS}, qn as (select *, {NORMAL('pred')} as np, {NORMAL('gold')} as ng from qa)"
EMPTY = "('', 'unanswerable', 'no answer', 'none', 'n/a', 'unknown', 'cannot answer')"
F1 = "case when len(p) = 0 or len(g) = 0 then (len(p) = len(g))::int::double when b = 0 then 0 else 2.0::double * b / (len(p) + len(g)) end"
OVERLAP = "list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) as b"
TOKENS = lambda x: f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


@query("squad_normalise", f"with {QA_TURNS} select conv_id, turn, np as normal from qn")
def squad_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02."""
    return s.turns(spark, sf_dir).select("conv_id", "turn", scalar.squad_normalise(F.col("pred")).alias("normal"))


@query("token_f1", f"with {QA_TURNS}, t as (select conv_id, turn, {TOKENS('np')} as p, {TOKENS('ng')} as g from qn), f as (select *, {OVERLAP} from t) select conv_id, turn, round({F1}, 9) as f1 from f")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04, SET-05."""
    return s.turns(spark, sf_dir).select("conv_id", "turn", r(scalar.token_f1(F.col("pred"), F.col("gold"))).alias("f1"))


@query("exact_match", f"with {QA_TURNS} select conv_id, count(*) as n, count(*) filter (where np = ng) as em, count(*) filter (where ng <> '' and contains(np, ng)) as contained, count(*) filter (where np in {EMPTY}) as empty from qn group by 1")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03, STR-05, STR-06."""
    p, g = F.col("pred"), F.col("gold")
    return s.turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(scalar.exact_match(p, g)).alias("em"), F.count_if(scalar.contains_gold(p, g)).alias("contained"), F.count_if(scalar.is_empty_answer(p)).alias("empty"))


MADE_ANSWERS = f"qb as (select conv_id, turn, gold, turn % 5 = 0 as un, case turn % 4 when 0 then 'Cannot answer.' when 1 then ' The ' || gold else pred end as pred from qa), qm as (select *, {NORMAL('pred')} as np, {NORMAL('gold')} as ng from qb), qe as (select *, np in {EMPTY} as empty, {TOKENS('np')} as p, {TOKENS('ng')} as g from qm), qs as (select *, {OVERLAP} from qe)"


def made_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with some answers that stand for none, some that are right, and some questions that can't be answered."""
    t = F.col("turn")
    pred = F.when(t % 4 == 0, "Cannot answer.").when(t % 4 == 1, F.concat(F.lit(" The "), "gold")).otherwise(F.col("pred"))
    return s.turns(spark, sf_dir).select("conv_id", "turn", pred.alias("pred"), F.array("gold", F.lit("zz none zz")).alias("golds"), (t % 5 == 0).alias("un"))


@query("scored_answers", f"with {s.TURNS}, {MADE_ANSWERS} select conv_id, turn, case when un then empty else not empty and np = ng end::int as em, round(case when un then empty::int::double when empty then 0 else greatest({F1}, case when list_contains(p, 'none') or list_contains(p, 'zz') then (least(len(list_filter(p, lambda y: y = 'none')), 1) + least(len(list_filter(p, lambda y: y = 'zz')), 2)) * 2.0::double / (len(p) + 3) else 0 end) end, 9) as f1, (not empty and ng <> '' and contains(np, ng))::int as contained, case when un then empty else not empty and np = ng end::int as correct from qs")
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: the best over several gold answers; unanswerable questions and empty answers by their own rules."""
    return qa.scored(made_answers(spark, sf_dir), ["conv_id", "turn"], "pred", "golds", "un").withColumn("f1", r("f1"))


@query("contained_answers", f"with {s.TURNS}, {MADE_ANSWERS} select conv_id, turn, (np = ng or (ng <> '' and contains(np, ng)))::int as correct from qs")
def contained_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: the other corpus' rule."""
    return qa.scored(made_answers(spark, sf_dir), ["conv_id", "turn"], "pred", "golds", contained=True).select("conv_id", "turn", "correct")


#: SQL's distance counts bytes: letters of more become control characters there, one to one.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = lambda x: f"translate({x}, '{LETTERS}', {' || '.join(f'chr({c})' for c in (*range(1, 9), *range(14, 27)))})"


@query("norm_levenshtein", f"with {s.TURNS}, ql as (select conv_id, turn, {ONE_BYTE('pred')} as pred, {ONE_BYTE('gold')} as gold from qa), d as (select conv_id, turn, case when greatest(length(pred), length(gold)) = 0 then 0 else levenshtein(pred, gold)::double / greatest(length(pred), length(gold)) end as d from ql) select conv_id, turn, round(d, 9) as distance, d between 0.05 and 0.6 as in_band from d")
def norm_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, GAT-5 of whole turns."""
    return s.turns(spark, sf_dir).select("conv_id", "turn", r(scalar.edit_distance(F.col("pred"), F.col("gold"))).alias("distance"), scalar.edit_gate(F.col("pred"), F.col("gold")).alias("in_band"))


NEGATED = lambda x: f"len(list_intersect(regexp_extract_all(lower({x}), '{WORD}+'), ['no', 'not', 'never', 'without', 'absent', 'denies', 'denied'])) > 0"
MADE_TURNS = "qx as (select conv_id, turn, case turn % 3 when 0 then 'not ' || pred when 1 then pred || ' never' else pred end as a, case turn % 2 when 0 then 'no ' || gold else gold end as b from qa)"


@query("negation_gate", f"with {QA_TURNS}, {MADE_TURNS} select conv_id, turn, ({NEGATED('a')}) = ({NEGATED('b')}) as same_presence from qx")
def negation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-3c."""
    t = F.col("turn")
    rows = s.turns(spark, sf_dir).select("conv_id", "turn", F.when(t % 3 == 0, F.concat(F.lit("not "), "pred")).when(t % 3 == 1, F.concat("pred", F.lit(" never"))).otherwise(F.col("pred")).alias("a"), F.when(t % 2 == 0, F.concat(F.lit("no "), "gold")).otherwise(F.col("gold")).alias("b"))
    return rows.select("conv_id", "turn", scalar.negation_gate(F.col("a"), F.col("b")).alias("same_presence"))


HELD = lambda x: f"list_sort(list_distinct(list_filter(string_split(trim({LINE(f'lower({x})')}), ' '), lambda x: x in ('not', 'no', 'never', 'none', 'neither', 'nor', 'without', 'cannot', 'can''t', 'won''t', 'don''t'))))"


@query("negation_set_gate", f"with {QA_TURNS}, {MADE_TURNS}, w as (select conv_id, turn, {HELD('a')} as x, {HELD('b')} as y from qx) select conv_id, turn, x = y as same_set from w")
def negation_set_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-3q."""
    t = F.col("turn")
    rows = s.turns(spark, sf_dir).select("conv_id", "turn", F.when(t % 3 == 0, F.concat(F.lit("not "), "pred")).when(t % 3 == 1, F.concat("pred", F.lit(" never"))).otherwise(F.col("pred")).alias("a"), F.when(t % 2 == 0, F.concat(F.lit("no "), "gold")).otherwise(F.col("gold")).alias("b"))
    return rows.select("conv_id", "turn", scalar.negation_set_gate(F.col("a"), F.col("b")).alias("same_set"))


@query("entity_gate", f"with {QA_TURNS}, w as (select conv_id, turn, lower(pred) as p, {BARE("lower(array_to_string(string_split(gold, ' ')[1:2], ' '))")} as m from qa), t as (select *, list_filter(regexp_extract_all(m, '{WORD}+'), lambda x: length(x) > 2) as l from w) select conv_id, turn, case when m <> '' and contains(p, m) then 'mention_exact' when len(l) > 0 and len(list_filter(l, lambda x: not contains(p, x))) = 0 then 'mention_token_cover' else 'unverified' end as mode from t")
def entity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-6."""
    mention = F.array_join(F.slice(F.split("gold", " "), 1, 2), " ")
    return s.turns(spark, sf_dir).select("conv_id", "turn", scalar.entity_mode(F.col("pred"), mention).alias("mode"))


@query("gate_formulas", f"with {s.GRID}, x as (select _ord, (k % 10) / 10.0::double as e1, (k % 7) / 10.0::double as c1, (k % 9) / 10.0::double as e2, (k % 4) / 10.0::double as c2, (k % 8) / 10.0::double as sim, k % 5 as errors, k % 6 as toks from g) select _ord, round((greatest(greatest(0.0, e1 - 0.5 * c1), 0.85 * sim) + greatest(greatest(0.0, e2 - 0.5 * c2), 0.85 * sim)) / 2, 9) as concept, c1 < 0.72 as uncontradicted, round(greatest(0.0, 1 - errors::double / greatest(toks, 1)), 9) as grammar from x")
def gate_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-2c, GAT-2q, GAT-4."""
    k = F.col("k")
    rows = s.grid(spark, sf_dir).select("_ord", (k % 10 / F.lit(10.0)).alias("e1"), (k % 7 / F.lit(10.0)).alias("c1"), (k % 9 / F.lit(10.0)).alias("e2"), (k % 4 / F.lit(10.0)).alias("c2"), (k % 8 / F.lit(10.0)).alias("sim"), (k % 5).alias("errors"), (k % 6).alias("toks"))
    c = F.col
    return rows.select("_ord", r(scalar.concept_gate(c("e1"), c("c1"), c("e2"), c("c2"), c("sim"))).alias("concept"), scalar.contradiction_gate(c("c1")).alias("uncontradicted"), r(scalar.grammar_score(c("errors"), c("toks"))).alias("grammar"))


@query("gate_summary_unpivot", f"with {s.GRID}, x as (select k > 20 as g1, k % 3 <> 0 as g2, confidence > 50 as g3 from g), u as (unpivot (select g1::int as g1, g2::int as g2, g3::int as g3 from x) on g1, g2, g3 into name gate value passed) select gate, sum(passed)::bigint as n_pass, count(*) filter (where passed = 0) as n_fail, round(count(*) filter (where passed = 0) / count(*)::double, 9) as fail_rate from u group by 1")
def gate_summary_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17."""
    rows = s.grid(spark, sf_dir).select((F.col("k") > 20).alias("g1"), (F.col("k") % 3 != 0).alias("g2"), (F.col("confidence") > 50).alias("g3"))
    return perturb.gate_summary(rows, ["g1", "g2", "g3"]).withColumn("fail_rate", r("fail_rate"))


N_WORDS = lambda x: f"len(regexp_extract_all({x}, '[^{BLANKS[1:]}+'))"


@query("perturb_syntactic", f"""with x as (select doc_id, {BARE("coalesce(text, '')")} as s from documents),
y as (select *, list_filter(list_transform(string_split(s, ','), lambda p: {BARE('p')}), lambda p: p <> '') as c, string_split(s, ' and ') as a, string_split(s, ' because ') as w from x),
z as (select doc_id, list_distinct(list_filter([case when contains(s, ',') and len(c) >= 2 and {N_WORDS('c[1]')} <= 12 then c[2] || ', ' || c[1] || case when suffix(s, '.') then '' else '.' end end,
  case when len(a) = 2 and len(list_filter(a, lambda p: {N_WORDS('p')} not between 3 and 18)) = 0 then {BARE('a[2]')} || ' and ' || {BARE('a[1]')} end,
  case when len(w) = 2 then 'Because ' || {BARE('w[2]')} || ', ' || {BARE('w[1]')} end, {LINE('s')}], lambda v: v is not null and v <> '')) as v from y)
select doc_id, len(v)::bigint as n_variants, md5(array_to_string(list_sort(v), '#')) as variants from z""")
def perturb_syntactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRT-02: of whole texts."""
    v = perturb.reordered(F.col("text"))
    return s.table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).select("doc_id", F.size("v").cast("long").alias("n_variants"), F.md5(F.array_join(F.array_sort("v"), "#")).alias("variants"))


@query("sentence_counts", r"select doc_id, 1 + len(regexp_extract_all(text, '[.!?][ \t\n\x0B\f\r]+')) as n_sentences, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) as n_runs from documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09, STR-10."""
    return s.table(spark, sf_dir, "documents").select("doc_id", F.size(scalar.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.regexp_count("text", F.lit("[A-Za-z0-9_]+")).cast("long").alias("n_runs"))


@query("readability_filter", f"""with x as (select doc_id, coalesce(text, '') as t from documents), u as (select *, case when t = '' then 1.0 else length(regexp_replace(t, '[\\t\\n\\r\\x20-\\x7E]', '', 'g'))::double / length(t) end as u from x)
select doc_id, round(u, 9) as unreadable, length(t) >= 20 and length({BARE('t')}) >= 2 and regexp_matches(t, '[A-Za-z]') and u <= 0.2 as eligible from u""")
def readability_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-02, STR-15."""
    text = F.col("text")
    return s.table(spark, sf_dir, "documents").select("doc_id", r(scalar.unreadable_share(text)).alias("unreadable"), (F.coalesce(F.char_length(text) >= 20, F.lit(False)) & scalar.readable(text)).alias("eligible"))


@query("identity_exclusion", f"with {s.GRID} select instance_id, count(*) as m, count(*) filter (where k % 4 < 2) as n_identical, count(*) - count(*) filter (where k % 4 < 2) >= 3 as kept from g where not is_orig group by 1")
def identity_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13: equal but for outer blanks and case, that of the sharp s too."""
    k = F.col("k")
    text = F.when(k % 4 == 0, "  Same TEXT").when(k % 4 == 1, "STRASSE\t").otherwise(F.concat(F.lit("other "), k.cast("string")))
    rows = s.grid(spark, sf_dir).where("not is_orig").select("instance_id", text.alias("t"), F.when(k % 4 == 1, " straße").otherwise("same text").alias("o"))
    return entropy.identity_excluded(rows, ["instance_id"], "t", "o")


@query("changed_tokens")
def changed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: an edit script has no SQL; the suite holds it against difflib by hand."""
    return s.turns(spark, sf_dir).select("conv_id", "turn", F.array_join(perturb.changed_words("pred", "gold"), "|").alias("changed_tokens"))


@query("mention_context")
def mention_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11 over all documents: by span where the number is even, else by the mention's sentence or window; the mention is the twelfth
    word, or the last of fewer. The suite holds it against the rule row by row."""
    words = F.split("text", " ")
    mention = F.coalesce(F.get(words, 11), F.element_at(words, -1))
    start = F.when(F.col("doc_id") % 2 == 0, F.position(mention, F.col("text")) - 1)
    rows = s.table(spark, sf_dir, "documents").select("doc_id", "text", mention.alias("mention"), start.alias("start"))
    end = (F.col("start") + F.char_length("mention")).cast("int")
    return rows.select("doc_id", perturb.mention_context("text", "mention", F.col("start").cast("int"), end).alias("context"))


@query("answer_clusters")
def answer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLU-01 by the lexical stand-in; cells of up to eight turns."""
    rows = s.turns(spark, sf_dir).select("conv_id", F.col("turn").alias("_ord"), "pred")
    return qa.answer_clusters(rows, ["conv_id"], "pred", LexicalNli(), least=0.4)


#: The study's thresholds.
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.72, 0.75, 0.80]


@query("threshold_sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-28."""
    rows = s.turns(spark, sf_dir).select("conv_id", F.col("turn").alias("_ord"), "pred")
    return qa.threshold_sweep(rows, ["conv_id"], "pred", LexicalNli(), THRESHOLDS)


INSTANCES = "ins as (select o_orderkey as instance_id, row_number() over (order by o_orderkey) - 1 as ordinal from orders)"


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys with their rank, from 0."""
    keys = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id"))
    return running(keys, [], [F.col("instance_id").asc()], {"ordinal": F.lit(1)}).select("instance_id", (F.col("ordinal") - 1).alias("ordinal"))


@query("block_completeness", f"with {INSTANCES}, m as (select l_orderkey as instance_id, count(distinct l_returnflag) as models from lineitem group by 1), j as (select ordinal // 1000 as block, coalesce(models, 0) as models from ins left join m using (instance_id)) select block, count(*) as n_instances, count(*) filter (where models = 3) as n_complete, count(*) filter (where models in (1, 2)) as n_partial, count(*) filter (where models = 3) = count(*) as complete from j group by 1")
def block_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-03, RCP-05, AGG-21, PRJ-13."""
    rows = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_returnflag").alias("model_name"))
    return receipts.block_completeness(rows, instances(spark, sf_dir), 3, 1000)


@query("concat_receipts", f"""with {INSTANCES}, pt as (select 'p' || (o_orderkey % 3) as part, o_orderkey as instance_id, case when o_orderkey % 501 = 0 then 'exact_match_inject+x' else 'a' end as path, case when o_orderkey % 777 = 0 then ' ' else 'x' end as txt from orders where o_orderkey % 2 = 0 union all select 'p9', 999999999, 'a', 'x'),
b as (select *, ordinal // 1000 as block from ins), pl as (select pt.*, block from pt left join b using (instance_id)), held as (select block, count(distinct part) as np from pl where block is not null group by 1), sz as (select part, count(*) as n from pt group by 1), ex as (select 'p' || (o_orderkey % 3) as part, count(*) as n_rows from orders where o_orderkey % 2 = 0 group by 1)
select 'R0' as receipt, true as ok, '' as detail union all select 'R1', count(*) = 0, count(*) || ' rows' from (select distinct block from b) anti join held using (block) union all select 'R1b', count(*) = 0, count(*) || ' rows' from held where np > 1 union all select 'R2', count(*) = 0, count(*) || ' rows' from pl where block is null
union all select 'R3', count(*) = 0, count(*) || ' rows' from sz full join ex using (part) where n is distinct from n_rows union all select 'R4', count(*) = 0, count(*) || ' rows' from pl where starts_with(path, 'exact_match_inject') union all select 'R5', count(*) = 0, count(*) || ' rows' from sz where part not in ('p0', 'p1') union all select 'R6', count(*) = 0, count(*) || ' rows' from pl where trim(txt) = ''""")
def concat_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-02, SET-01."""
    k = F.col("o_orderkey")
    part = F.concat(F.lit("p"), (k % 3).cast("string"))
    rows = s.table(spark, sf_dir, "orders").where(k % 2 == 0).select(part.alias("part"), k.alias("instance_id"), F.when(k % 501 == 0, "exact_match_inject+x").otherwise("a").alias("assign_rule_path"), F.when(k % 777 == 0, " ").otherwise("x").alias("output_text"), F.lit("C1").alias("predicted_cui"))
    stray = spark.createDataFrame([("p9", 999999999, "a", "x", "C1")], rows.schema)
    expected = rows.groupBy("part").agg(F.count("*").alias("n_rows"))
    own = spark.createDataFrame([("p0", 0, 5), ("p1", 0, 5), ("p2", 3, 5)], "part string, violations int, evaluated int")
    return receipts.concat_receipts(rows.unionByName(stray), instances(spark, sf_dir), expected, own, rows.columns, 1000)


@query("na_sweep", "with x as (select case when s_suppkey % 5 = 0 then 'NA' when s_suppkey % 7 = 0 then null when s_suppkey % 3 = 0 then ' NA' else s_name end as a, case when s_suppkey % 11 = 0 then '1.#QNAN' when s_suppkey % 13 = 0 then 'None.' else s_name end as b from supplier), u as (select 'a' as col, a as v from x union all select 'b', b from x) select col as \"column\", count(*) filter (where v in ('NA', 'N/A', 'n/a', 'NULL', 'null', 'None', 'NaN', 'nan', '-nan', '<NA>', '#N/A', '#N/A N/A', '#NA', '1.#IND', '1.#QNAN', '-1.#IND', '-1.#QNAN', 'NAN', 'None.')) as n_na_tokens, count(*) filter (where v is null) as n_null, count(*) as n from u group by 1")
def na_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-07."""
    k = F.col("s_suppkey")
    a = F.when(k % 5 == 0, "NA").when(k % 7 == 0, None).when(k % 3 == 0, " NA").otherwise(F.col("s_name"))
    rows = s.table(spark, sf_dir, "supplier").select(a.alias("a"), F.when(k % 11 == 0, "1.#QNAN").when(k % 13 == 0, "None.").otherwise(F.col("s_name")).alias("b"))
    return receipts.na_sweep(rows, ["a", "b"])


@query("staleness", "with a as (select 'n' || n_nationkey as name, n_regionkey::double * 10 + n_nationkey % 3 as modified from nation), e as (select 'n' || n_nationkey as child, 'n' || ((n_nationkey + 1) % 25) as parent from nation union all select 'n' || n_nationkey, 'n' || ((n_nationkey + 7) % 25) from nation), p as (select child, max(modified) as newest from e join a on a.name = e.parent group by 1) select name, modified, newest as newest_input, newest > modified + 1 as stale from a join p on a.name = p.child")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-06."""
    n, k = s.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    artefacts = n.select(name(k).alias("name"), (F.col("n_regionkey").cast("double") * 10 + k % 3).alias("modified"))
    edges = n.select(name(k).alias("child"), name((k + 1) % 25).alias("parent")).union(n.select(name(k), name((k + 7) % 25)))
    return receipts.stale(artefacts, edges)


@query("key_mode", f"with {s.GRID}, o as (select distinct instance_id, _ord as v from g where text_key < 11) select count(*) as n, count(o.v) as n_own, round(count(o.v) / count(*)::double, 9) as share, case when count(o.v) / count(*)::double >= 0.99 then 'direct' else 'positional' end as mode from g left join o on g.instance_id = o.instance_id and g._ord = o.v")
def key_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-09."""
    rows = s.grid(spark, sf_dir)
    return receipts.key_mode(rows, rows.where("text_key < 11"), "instance_id", "_ord").withColumn("share", r("share"))


@query("identical_means", "with m as (select n_regionkey as g, avg(n_nationkey % 5) as mean from nation group by 1) select a.g as first, b.g as second, a.mean from m a join m b on a.g < b.g and abs(a.mean - b.mean) <= 1e-12")
def identical_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-10."""
    rows = s.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), (F.col("n_nationkey") % 5).alias("v"))
    return receipts.identical_means(rows, "g", "v")


@query("ledger", f"with {s.GRID}, c as (select model_name, avg(confidence) as computed from g group by 1), d as (select model_name, round(computed, 2) as draft from c where model_name <> 'view') select model_name, draft, round(computed, 9) as computed, coalesce(abs(draft - computed) <= 0.003, false) as ok from c full join d using (model_name)")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-13."""
    computed = s.grid(spark, sf_dir).groupBy("model_name").agg(F.avg("confidence").alias("value"))
    draft = computed.where("model_name != 'view'").select("model_name", F.round("value", 2).alias("value"))
    return receipts.ledger(draft, computed, ["model_name"], 0.003).withColumn("computed", r("computed"))


@query("changed_only_diff", f"with {s.GRID} select _ord, case when k % 9 = 0 and k % 10 = 0 then 'label,confidence' when k % 9 = 0 then 'label' else 'confidence' end as changed from g where k % 9 = 0 or k % 10 = 0")
def changed_only_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, JOI-05: a difference below the tolerance is none."""
    rows = s.grid(spark, sf_dir)
    after = rows.withColumns({"label": F.when(F.col("k") % 9 == 0, "CX").otherwise(F.col("label")), "confidence": F.col("confidence") + F.when(F.col("k") % 10 == 0, 1e-3).otherwise(1e-12)})
    return receipts.changed_rows(rows, after, ["_ord"], ["label", "confidence"]).select("_ord", "changed")


@query("keyed_refresh", f"with {s.GRID}, h as (select instance_id, count(*) as h from g group by 1) select _ord, label, h, case when label = 'UNASSIGNED' then h::double else confidence end as confidence from g join h using (instance_id)")
def keyed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-01, JOI-02, JOI-14, JOI-15: columns refreshed by key, and filled where a mask says so."""
    rows = s.grid(spark, sf_dir)
    fresh = rows.groupBy("instance_id").agg(F.count("*").alias("h"))
    joined = receipts.join_unique(rows.select("_ord", "instance_id", "label", "confidence"), fresh, ["instance_id"])
    return joined.select("_ord", "label", "h", F.when(F.col("label") == "UNASSIGNED", F.col("h").cast("double")).otherwise(F.col("confidence")).alias("confidence"))


@query("incremental_append", f"with {s.GRID}, a as (select instance_id, model_name, k, 0 as new, _ord from g where k < 60 union all select instance_id, model_name, k, 1, _ord from g where k >= 40) select instance_id, model_name, k from a qualify row_number() over (partition by instance_id, model_name order by new desc, _ord desc) = 1")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, WIN-12."""
    from ..sources.sinks import append_last

    rows = s.grid(spark, sf_dir).select(*CELL, "k", "_ord")
    return append_last(rows.where("k < 60"), rows.where("k >= 40"), CELL, "_ord").select(*CELL, "k")


@query("most_variants_first", f"with {s.GRID}, n as (select instance_id, count(*) as n from g group by 1) select instance_id, n from n order by n desc, instance_id limit 20")
def most_variants_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07: a top-k report."""
    return s.grid(spark, sf_dir).groupBy("instance_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "instance_id").limit(20)


@query("per_group_head", f"with {s.GRID} select _ord, model_name from g qualify row_number() over (partition by instance_id, model_name order by _ord) <= 3")
def per_group_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08: the operator is a limit by group."""
    k = F.row_number().over(Window.partitionBy(*CELL).orderBy("_ord"))
    return s.grid(spark, sf_dir).withColumn("_k", k).where("_k <= 3").select("_ord", "model_name")


@query("hash_sample")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06: a sample of 100 without replacement by a hash; not that of another generator."""
    return s.table(spark, sf_dir, "documents").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(100).orderBy("doc_id")


@query("variants_ratio", f"with {s.GRID} select count(*) as n_rows, count(distinct instance_id) as n_instances, round(count(*) / count(distinct instance_id)::double, 9) as ratio, count(*) / count(distinct instance_id)::double between 1.5 and 9 as ok from g")
def variants_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCP-04."""
    return receipts.variants_per_instance(s.grid(spark, sf_dir), "instance_id").withColumn("ratio", r("ratio"))


@query("semantic_shift", f"with {s.GRID}, o as (select instance_id, model_name, max(label) filter (where is_orig) as ol from g group by 1, 2) select _ord, label <> ol as shifted from g join o using (instance_id, model_name)")
def semantic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-12."""
    own = F.max(F.when(F.col("is_orig"), F.col("label"))).over(Window.partitionBy(*CELL))
    return s.grid(spark, sf_dir).withColumn("_o", own).select("_ord", (F.col("label") != F.col("_o")).alias("shifted"))


@query("sibling_pairs", f"with {s.GRID} select a.instance_id, a.model_name, count(*) as n_pairs, count(*) filter (where a.label = b.label) as n_same from g a join g b on a.instance_id = b.instance_id and a.model_name = b.model_name and a._ord < b._ord group by 1, 2")
def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-16: pairs of a cell's few variants, counted from label counts rather than made."""
    n = s.grid(spark, sf_dir).groupBy(*CELL, "label").agg(F.count("*").alias("n"))
    pairs = lambda c: (c * (c - 1) / 2).cast("long")
    return n.groupBy(*CELL).agg(pairs(F.sum("n")).alias("n_pairs"), F.sum(pairs(F.col("n"))).alias("n_same")).where("n_pairs > 0")


@query("union_distinct", "select o_orderpriority as key from orders union select c_mktsegment from customer")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02, SET-06, PRJ-12."""
    return s.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key")).union(s.table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()


@query("json_props", "select json_extract_string(props, '$.k')::int as k, count(*) as n, round(avg(value), 6) as mean_value from events group by 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01, PRJ-07."""
    k = F.from_json("props", "k int").getField("k")
    return s.table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), r(F.avg("value"), 6).alias("mean_value"))
