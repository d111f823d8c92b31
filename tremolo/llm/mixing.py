"""Operator 9: mixing sources to target weights, with DataFrame operations only.

Sizes are added up per source; a source's target is its share by weight, at most ``cap`` times its size, the excess reshared by
weight. A document is then taken floor(rate) times, and once more with the probability of the fraction, drawn from a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Sources up to which their table is broadcast (a row each, some 100 bytes); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Columns that mix() makes.
MADE = ("size", "source_size", "target", "copies", "taken")


def word_count(column: str = "text") -> F.Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(common.NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source its target, from (source, source_size); sources by code point, null last, weigh ``weights``, repeating.

    The targets are min(cap * size, level * weight) with one level for all: sorted by cap * size / weight, a source is capped
    exactly if at its own ratio the sources up to it stop and the rest, by weight, still take less than all there is.
    """
    # one ordered pass over a row a source
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)))
    limit = cap * F.col("source_size")
    ranked = ranked.withColumn("ratio", limit.cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = ranked.withColumns({"stopped": F.coalesce(F.sum(limit).over(before), F.lit(0)), "left": F.sum("weight").over(after), "total": F.sum("source_size").over(whole)})
    ranked = ranked.withColumn("capped", F.col("stopped") * F.col("weight") + limit * F.col("left") <= F.col("total") * F.col("weight"))
    taken, rest = F.coalesce(F.sum(F.when(F.col("capped"), limit)).over(whole), F.lit(0)), F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    level = (F.col("total") - taken).cast("double") * F.col("weight") / rest
    return ranked.select("source", "source_size", F.when(F.col("capped"), limit.cast("double")).otherwise(level).alias("target"))


def draw(seed: str = SEED) -> F.Column:
    """A number in [0, 1) from doc_id and the seed: 52 bits of their MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` (doc_id, text, source, any more) with size, source_size, target, copies and taken.

    Null texts have size 0, as have empty ones; a source of size 0 gets target 0 and no copies. A null source is one source, the
    last. Repeated rows of a doc_id draw the same number. Columns of these names in ``docs`` are replaced (emit() keeps them).
    Sources whose targets tie go by code point. Very long texts are taken whole. An empty table gives none.

    Each document is drawn alone, so a source's taken words have the variance of sum(size^2 * f * (1 - f)), f the fraction of its
    rate: near its target where a source has many documents, further off where few long ones make it up.
    """
    docs = docs.drop(*MADE).withColumn("size", word_count())
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = common.cut(targets(sizes, weights, cap), keep=True).withColumnRenamed("source", "of_source")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SOURCES else sizes
    joined = docs.join(sizes, docs["source"].eqNullSafe(sizes["of_source"])).drop(sizes["of_source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(draw(seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns, whatever their names.

    Null and empty texts have size 0 and are taken as often as others of their source, repeated rows alike; a source of size 0, and
    an empty table, give none. Ties, null sources and very long texts are taken as by mix().
    """
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mix(rows, **how).where("copies > 0").select("row", copies.alias("copy")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, sources weighing 1, 2, 3."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in SQL.
ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sized group by source),
ranked as (
  select *, sum(source_size) over () as total, sum(weight) over (order by 3.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as left_weight,
    coalesce(sum(3 * source_size) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as stopped from sources),
judged as (
  select *, stopped * weight + 3 * source_size * left_weight <= total * weight as capped from ranked),
aimed as (
  select source, source_size, case when capped then (3 * source_size)::double
    else (total - coalesce(sum(case when capped then 3 * source_size end) over (), 0))::double * weight / sum(case when not capped then weight end) over () end as target from judged),
rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double as u
  from sized join aimed on sized.source is not distinct from aimed.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from rated
"""
