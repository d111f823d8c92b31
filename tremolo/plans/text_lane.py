"""Queries of generators, cleaners, sentences and tags, and of what stands beside retrieval: vectors, pools, older margins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import concepts, inference, perturb, reports, retrieval, selective, stats
from ..providers import SuffixTagger, linguistic_category
from . import standins as s
from .concept_lane import TOP, found, r
from .quality import BARE, LINE
from .registry import query

#: A word in place of another, twice, as words beside one another share the blank between them.
WORD_SQL = lambda x, a, b: f"regexp_replace(regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_]){a}($|[^\\p{{L}}\\p{{N}}_])', '\\1{b}\\2', 'g'), '(^|[^\\p{{L}}\\p{{N}}_]){a}($|[^\\p{{L}}\\p{{N}}_])', '\\1{b}\\2', 'g')"
SQUEEZED = lambda x: BARE(LINE(x))
MADE_OUTPUTS = f"{s.TURNS}, mo as (select conv_id, turn, case turn % 5 when 0 then '<s>[INST] ' || gold || ' [/INST] Answer: \"' || pred || '\"' when 1 then '  ' || pred || '</s>' when 2 then 'Concept: ' || pred || '.' when 3 then 'I think the primary medical concept here is: ' || pred || '..' else '' end as out from qa)"


def made_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a model might print them."""
    t, pred = F.col("turn") % 5, F.col("pred")
    out = (
        F.when(t == 0, F.concat(F.lit("<s>[INST] "), "gold", F.lit(' [/INST] Answer: "'), pred, F.lit('"'))).when(t == 1, F.concat(F.lit("  "), pred, F.lit("</s>")))
        .when(t == 2, F.concat(F.lit("Concept: "), pred, F.lit("."))).when(t == 3, F.concat(F.lit("I think the primary medical concept here is: "), pred, F.lit(".."))).otherwise("")
    )
    return s.turns(spark, sf_dir).select("conv_id", "turn", out.alias("out"))


def _marks_sql(x: str, marks: tuple[str, ...]) -> str:
    for mark in marks:
        x = f"replace({x}, '{mark}', ' ')"
    return x


@query("clean_answers", f"""with {MADE_OUTPUTS}, c as (select conv_id, turn, string_split({_marks_sql(BARE('out'), scalar.CHAT_MARKS)}, 'Answer:')[-1] as x from mo) select conv_id, turn, left(trim({SQUEEZED('x')}, ' "''`'), 300) as answer from c""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: chat marks, leads and quotes go; the cut to 300 characters is the cleaner's own."""
    return made_outputs(spark, sf_dir).select("conv_id", "turn", scalar.clean_answer(F.col("out")).alias("answer"))


@query("clean_concepts", f"""with {MADE_OUTPUTS}, c0 as (select conv_id, turn, string_split({_marks_sql(BARE('out'), scalar.CONCEPT_CHAT_MARKS)}, 'Answer:')[-1] as x from mo), c1 as (select conv_id, turn, string_split(string_split(x, 'Concept:')[-1], 'The primary medical concept is')[-1] as x from c0),
c2 as (select conv_id, turn, regexp_replace(x, '(?is)^.*?the primary medical concepts?\\b.*?\\b(?:is|are)\\b\\s*:?\\s*', '') as x from c1) select conv_id, turn, left({SQUEEZED("trim(x, ' \"''`.')")}, 200) as concept from c2""")
def clean_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08; the cut to 200 characters is the cleaner's own."""
    return made_outputs(spark, sf_dir).select("conv_id", "turn", scalar.clean_concept(F.col("out")).alias("concept"))


@query("flags", "select o_orderkey, case o_orderkey % 6 when 0 then true when 1 then true when 2 then true else false end as flag from orders")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14: stringified booleans."""
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "True").when(k == 1, "1").when(k == 2, "TRUE").when(k == 3, "no").when(k == 4, "").otherwise(F.lit(None))
    return s.table(spark, sf_dir, "orders").select("o_orderkey", scalar.as_flag(text).alias("flag"))


@query("eligible_rows", f"with {s.TURNS}, e as (select conv_id, turn, {BARE('pred')} as c, {BARE("array_to_string(string_split(gold, ' ')[1:1], '')")} as m from qa) select 'first' as corpus, conv_id, turn from e where length(c) >= 20 and length(m) >= 2 union all select 'second', conv_id, turn from e where length(c) >= 8 and length(m) >= 1")
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02, FLT-03: enough context and mention, by each corpus' limits."""
    rows = s.turns(spark, sf_dir).select("conv_id", "turn", "pred", F.get(F.split("gold", " "), 0).alias("m"))
    one = lambda name, *least: inference.eligible(rows, "pred", "m", *least).select(F.lit(name).alias("corpus"), "conv_id", "turn")
    return one("first", 20, 2).unionByName(one("second", 8, 1))


@query("two_key_order", f"""with {s.SELECTION}, rk as (select *, row_number() over (partition by lang order by entropy, confidence desc, _ord) as rn, count(*) over (partition by lang) as n_total from sel), hs as (select *, sum(correct) over (partition by lang order by rn) as hits from rk),
gr as (select round_even(1.0::double - 0.05::double * i, 2) as coverage from range(19) t(i)) select lang, coverage, rn::int as n_keep, round(1 - hits / rn::double, 9) + 0.0 as risk from hs join gr on rn = greatest(1, ceil(coverage * n_total)::int)""")
def two_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: entropy first, confidence among equals."""
    curve = selective.risk_coverage(s.selection(spark, sf_dir), ["lang"], [F.col("entropy").asc(), F.col("confidence").desc()])
    return curve.select("lang", "coverage", "n_keep", r("risk").alias("risk"))


@query("unit_vectors", "with v as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings), u as (select vec_id, list_transform(embedding, lambda x: x::double / n) as u from v) select vec_id, round(u[1], 9) + 0.0 as first, round(u[len(u)], 9) + 0.0 as last, round(list_sum(list_transform(u, lambda x: x * x)), 9) as square from u")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-01."""
    u = s.table(spark, sf_dir, "embeddings").select("vec_id", retrieval.l2_normalise(F.col("embedding")).alias("u"))
    return u.select("vec_id", r(F.element_at("u", 1)).alias("first"), r(F.element_at("u", -1)).alias("last"), r(retrieval.dot(F.col("u"), F.col("u"))).alias("square"))


@query("embedded_texts", "with d as (select distinct text from conversations) select count(*) as n_rows, (select count(*) from d where text is not null) as n_embedded, sum(length(c.text))::bigint as total from conversations c")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-05: each different text goes to the provider once, every row gets its vector."""
    asked = spark.sparkContext.accumulator(0)

    def provider(texts: DataFrame) -> DataFrame:
        def embed(batches):
            for batch in batches:
                asked.add(len(batch))
                yield pd.DataFrame({"text": batch["text"], "vector": [[float(len(t))] for t in batch["text"]]})

        return texts.where("text is not null").mapInPandas(embed, "text string, vector array<double>")

    rows = retrieval.embed_distinct(s.table(spark, sf_dir, "conversations"), "text", provider)
    total = rows.agg(F.count("*").alias("n_rows"), F.sum(F.col("vector")[0]).cast("long").alias("total")).first()
    return spark.createDataFrame([(total.n_rows, asked.value, total.total)], "n_rows long, n_embedded long, total long")


@query("usable_forms", f"with f as (select p_partkey as id, case p_partkey % 4 when 0 then '  ' || p_name || ' ' when 1 then p_size::varchar || '-1' when 2 then 'ab' else p_brand end as form from part), b as (select id, {BARE('form')} as form from f) select id, form from b where length(form) >= 3 and regexp_matches(form, '[A-Za-z]')")
def usable_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-07."""
    k = F.col("p_partkey") % 4
    form = F.when(k == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit("-1"))).when(k == 2, "ab").otherwise(F.col("p_brand"))
    return retrieval.usable_forms(s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), form.alias("form")))


@query("pool_report", "with a as (select p_size, count(distinct p_name) as n from part group by 1), b as (select p_size, count(distinct p_name) as n from part where p_type = (select min(p_type) from part) group by 1) select 'all' as pool, count(*) as n_concepts, sum(n)::bigint as n_forms, round(sum(n) / count(*)::double, 9) as forms_per_concept from a union all select 'one', count(*), sum(n)::bigint, round(sum(n) / count(*)::double, 9) from b")
def pool_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POOL-03."""
    p = s.table(spark, sf_dir, "part")
    kind = p.agg(F.min("p_type")).first()[0]
    pool = lambda rows: rows.groupBy("p_size").agg(F.collect_set("p_name").alias("surface_forms"))
    return concepts.pool_report({"all": pool(p), "one": pool(p.where(F.col("p_type") == kind))}).select("pool", "n_concepts", "n_forms", r("forms_per_concept").alias("forms_per_concept"))


@query("older_margin", f"with {TOP}, f as (select t.qid, form, max(score) as score, bool_or(cui <> pred) as other from top t join pred using (qid) group by 1, 2), s2 as (select qid, max(score) filter (where other) as s2 from f group by 1) select qid, pred, round(coalesce(s2, 0), 6) as s2, round(s1 - coalesce(s2, 0), 6) as margin from pred left join s2 using (qid)")
def older_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-02: forms with any other concept count."""
    top, forms, pred = found(spark, sf_dir)
    return concepts.runner_up(pred, top, forms, exclude_polysemous=False).select("qid", "pred", r("s2", 6).alias("s2"), r("margin", 6).alias("margin"))


@query("own_scores", f"with {s.VECTORS} select query_id as qid, round(max(score), 6) + 0.0 as s1 from scores where cui = 'C' || lpad(((query_id // 100) % 5)::varchar, 7, '0') group by 1")
def own_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-03: the best of all forms of a given concept, not only of those retrieved."""
    q, f = s.vectors(spark, sf_dir)
    asked = q.select(F.col("query_id").alias("qid"), F.concat(F.lit("C"), F.lpad((F.expr("query_id div 100") % 5).cast("string"), 7, "0")).alias("cui"), "vector")
    forms = f.select(F.col("form_id").alias("form"), "cui", "vector")
    return concepts.own_score(asked, forms.select("form", "cui"), forms.select("form", "vector")).select("qid", r("s1", 6).alias("s1"))


@query("margin_identity", "select 0 as null_with_rows, 0 as value_without_rows")
def margin_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-06: a null margin and no retrieved row go together in every cell of the grid."""
    rows = s.grid(spark, sf_dir).withColumns({"s1": F.col("confidence"), "s2": (F.col("k") % 7).cast("double")}).withColumn("margin", F.when(F.col("k") % 3 == 0, F.col("s1") - F.col("s2")))
    made = concepts.null_identity(concepts.margin_summary(rows, s.CELL))
    return made.select(*[F.col(c).cast("int").alias(c) for c in made.columns])


@query("ordered_categories", "select (row_number() over (order by case o_orderpriority when '5-LOW' then 1 when '1-URGENT' then 2 else 3 end, o_orderpriority) - 1)::int as place, o_orderpriority, n from (select o_orderpriority, count(*) as n from orders group by 1)")
def ordered_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: named categories first, others by name; a report of as many rows as there are categories."""
    n = s.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    rows = reports.in_order(n, "o_orderpriority", ["5-LOW", "1-URGENT"]).collect()
    return spark.createDataFrame([(i, x.o_orderpriority, x.n) for i, x in enumerate(rows)], "place int, o_orderpriority string, n long")


@query("normal_tails")
def normal_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-03: p and log10 p of the rank tests of order pairs, also where p is too small for a double; the suite has known values."""
    from .concept_lane import order_differences

    tests = stats.signed_ranks(order_differences(spark, sf_dir), ["pair"]).collect()
    rows = [(t.pair, t.z, stats.normal_tail(abs(t.z)), stats.log10_normal_tail(abs(t.z))) for t in tests if t.z is not None]
    return spark.createDataFrame(rows, "pair string, z double, p double, log10_p double")


@query("template_paraphrases", f"""with {s.TURNS}, t as (select conv_id, turn, {BARE("case when turn % 3 = 0 then 'It is said with care: ' || pred else pred end")} as x from qa),
v as (select conv_id, turn, x, list_filter([replace(x, ' is ', ' remains '), replace(x, ' was ', ' remained '), {WORD_SQL('x', 'shows', 'demonstrates')}, {WORD_SQL('x', 'with', 'accompanied by')}], lambda y: y <> '' and y <> x) as l from t)
select conv_id, turn, case when len(l) > 0 then md5(array_to_string(l[1:3], '|')) else md5(x) end as variants from v""")
def template_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRT-03 without a model."""
    x = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("It is said with care: "), "pred")).otherwise(F.col("pred"))
    return s.turns(spark, sf_dir).select("conv_id", "turn", F.md5(F.array_join(perturb.template_paraphrase(x), "|")).alias("variants"))


@query("back_translations", f"""with {s.TURNS}, t as (select conv_id, turn, pred, {BARE("pred || '; which  ends'")} as x from qa) select conv_id, turn, turn % 4 <> 0 as fallback,
  case when turn % 4 = 0 then md5({BARE("'back ' || pred")}) else md5({LINE('x')} || '|' || replace(x, ';', '.') || '|' || {WORD_SQL('x', 'which', 'that')}) end as variants from t""")
def back_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRT-04: a translation where there is one, else small changes that are marked."""
    back = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("back "), "pred"))
    made = perturb.back_translated(F.concat("pred", F.lit("; which  ends")), back)
    return s.turns(spark, sf_dir).select("conv_id", "turn", made["fallback"].alias("fallback"), F.md5(F.array_join(made["variants"], "|")).alias("variants"))


@query("synonym_variants", "with w as (select n_nationkey as id, lower(string_split(r_name, ' ')[1]) as w, n_nationkey % 5 = 0 as named from nation join region on n_regionkey = r_regionkey) select id, unnest(['the zed' || w || ' coast near it', 'the alt' || w || ' coast near it']) as variant from w where not named union all select id, 'the ' || w || ' shore near it' from w")
def synonym_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRT-01: one token replaced at a time; what the mention says stays, and synonyms of fewer than three letters are none."""
    n, g = s.table(spark, sf_dir, "nation"), s.table(spark, sf_dir, "region")
    word = F.lower(F.split("r_name", " ")[0])
    mention = F.when(F.col("n_nationkey") % 5 == 0, word).otherwise("it")
    rows = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat_ws(" ", F.lit("the"), word, F.lit("coast near it")).alias("text"), mention.alias("mention"))
    lexicon = g.select(word.alias("word"), F.explode(F.array(F.concat(F.lit("zed"), word), F.concat(F.lit("alt"), word), F.lit("zz"))).alias("synonym"))
    lexicon = lexicon.unionByName(spark.createDataFrame([("coast", "shore"), ("coast", "coast")], "word string, synonym string"))
    return perturb.synonym_variants(rows, ["id"], "text", "mention", lexicon)


@query("surrounding_sentences")
def surrounding_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12 around the middle character of every document; the suite has the rule by hand."""
    middle = F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    return s.table(spark, sf_dir, "documents").select("doc_id", inference.surrounding_sentence(F.col("text"), middle, middle + 1).alias("sentence"))


@query("linguistic_categories")
def linguistic_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14: categories of each turn's first three words by the tagger of endings; the suite has it by hand."""

    @F.pandas_udf("string")
    def category(words: pd.Series) -> pd.Series:
        tagger = SuffixTagger()
        return words.map(lambda w: linguistic_category(tagger.tag(list(w)[:3])))

    rows = s.turns(spark, sf_dir).select(category(scalar.words(F.col("pred"))).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))
