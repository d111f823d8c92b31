"""The study's inputs, made from the driver's tables; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a model grid: user and week of the month are the instance, event types the models."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.expr("(day(ts) - 1) div 8").cast("string")).alias("instance_id"), F.col("event_type").alias("model_name"), F.col("event_id").alias("_ord"),
        F.col("value").alias("confidence"), k.alias("k"), (k % 12).alias("text_key"), F.when(k < 60, "C0").when(k < 75, "C1").when(k < 85, "C2").otherwise("UNASSIGNED").alias("label"),
    )
    return rows.withColumn("is_orig", F.col("_ord") == F.min("_ord").over(Window.partitionBy("instance_id", "model_name")))


CELL = ["instance_id", "model_name"]

GRID = """g0 as (select user_id::varchar || '-' || ((day(ts) - 1) // 8)::varchar as instance_id, event_type as model_name, event_id as _ord, value as confidence, json_extract_string(props, '$.k')::int as k from events),
g as (select *, k % 12 as text_key, case when k < 60 then 'C0' when k < 75 then 'C1' when k < 85 then 'C2' else 'UNASSIGNED' end as label, _ord = min(_ord) over (partition by instance_id, model_name) as is_orig from g0)"""


def entropy_sql(source: str, cell: str, name: str, label: str = "label") -> str:
    """SQL of label_entropy() over a CTE, as a CTE of that name."""
    keys = ", ".join(cell.split())
    return f"""{name}_c as (select {keys}, case when {label} = 'UNASSIGNED' or lower(coalesce({label}, '')) in ('nan', 'na', 'none', '') then null else {label} end as l, count(*) as n, min(_ord) as f from {source} group by all),
{name}_s as (select {keys}, sum(n)::bigint as n_variants, coalesce(sum(n) filter (where l is not null), 0)::bigint as n_assigned, count(l) as n_clusters, sum(n * log2(n)) filter (where l is not null) as s, coalesce(arg_max(l, {{'n': n, 'f': -f}}) filter (where l is not null), 'UNASSIGNED') as dominant from {name}_c group by {keys}),
{name} as (select *, n_variants - n_assigned as n_unassigned, case when n_assigned = 0 then null when n_clusters = 1 then 0.0 else log2(n_assigned) - s / n_assigned end as semantic_entropy,
  case when n_assigned = 0 or n_variants = 1 then null when n_clusters = 1 then 0.0 else (log2(n_assigned) - s / n_assigned) / log2(n_variants) end as normalised_entropy, n_variants > 1 and n_clusters = 1 as is_zero, n_assigned = 0 as all_unassigned from {name}_s)"""


#: Both arms of the grid, with the flags of retained cells.
DUAL = (
    GRID
    + ",\n"
    + entropy_sql("g", "instance_id model_name", "raw")
    + """,
d0 as (select * from g qualify row_number() over (partition by instance_id, model_name, is_orig, case when is_orig then null else text_key end order by _ord) = 1),
"""
    + entropy_sql("d0", "instance_id model_name", "dd")
    + """,
m as (select instance_id, model_name, count(*) filter (where not is_orig) as m_accepted, count(distinct case when not is_orig then text_key end) as m_distinct from g group by all),
dual as (select raw.*, dd.semantic_entropy as semantic_entropy_dedup, dd.normalised_entropy as normalised_entropy_dedup, dd.is_zero as is_zero_dedup, m_accepted, m_distinct, m_accepted - m_distinct as n_duplicates, m_accepted >= 3 as retained_m_accepted, m_distinct >= 3 as retained_m_distinct
  from raw join dd using (instance_id, model_name) join m using (instance_id, model_name))"""
)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions: good quality is right; signals come from length and characters; the language is the cell."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = F.regexp_count("text", F.lit(r"[^A-Za-z0-9\s]")) / F.greatest(F.char_length("text"), F.lit(1))
    capitals = F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.char_length("text"), F.lit(1))
    ranked = d.join(labels, "doc_id").select("lang", F.col("doc_id").alias("_ord"), F.col("quality").alias("correct"), F.col("toxic"), F.round(marks, 3).alias("entropy"), (F.col("n_chars") % 97 / 97.0).alias("confidence"), F.round(capitals, 3).alias("margin"))
    return ranked


SELECTION = r"""sel as (select lang, doc_id as _ord, quality as correct, toxic, round((length(regexp_replace(text, '[A-Za-z0-9\t\n\x0B\f\r ]', '', 'g')))::double / greatest(length(text), 1), 3) as entropy,
  (n_chars % 97) / 97.0::double as confidence, round((length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::double / greatest(length(text), 1), 3) as margin from documents join labels using (doc_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, vector) and (form_id, vector, cui): embeddings whose ids divide by 100 ask for all."""
    e = table(spark, sf_dir, "embeddings")
    cui = F.concat(F.lit("C"), F.lpad(F.col("label").cast("string"), 7, "0"))
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("form_id"), F.col("embedding").alias("vector"), cui.alias("cui"))


VECTORS = """scores as (select q.vec_id as query_id, f.vec_id as form_id, 'C' || lpad(f.label::varchar, 7, '0') as cui, list_dot_product(q.embedding::double[], f.embedding::double[]) as score from embeddings q, embeddings f where q.vec_id % 100 = 0)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers: each turn predicts the next."""
    c = table(spark, sf_dir, "conversations")
    gold = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.col("text").alias("pred"), gold.alias("gold")).where("gold is not null")


TURNS = """qa as (select * from (select conv_id, turn, text as pred, lead(text) over (partition by conv_id order by turn) as gold from conversations) where gold is not null)"""


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' mean order prices by priority, as values of matched models."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


ORDER_PAIRS = "op as (select o_custkey as instance, o_orderpriority as model, round(avg(o_totalprice), 4) as value from orders group by all)"
