"""Operator 2: exact dedup by deterministic block naming, with DataFrame operations only.

A text without its white space is cut into blocks of ``BLOCK_BYTES`` bytes. The different blocks, sorted, get one integer name each;
then adjacent names are paired and the different pairs named the same way, level by level, until each document has one name. Names
are given to whole blocks and pairs after equal ones are brought together, partly before the shuffle, so copies cost no more than
their row. Blocks find their names by 128 bits of hash, which are checked to be of one block each (another hash is taken if not), so
no two different texts can get the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 4096
#: Names up to which their table is broadcast (some 100 bytes each). Of more, those that most rows share are broadcast, no more
#: than this, and the others are joined by a shuffle in which a key has few rows.
BROADCAST_NAMES = 300_000
#: The right half of a pair that has none; no name is this.
NO_NAME = -(1 << 63)
KEYS = ["key1", "key2"]


def stripped(column: str = "text") -> Column:
    """The text without white space, as UTF-8; null counts as empty."""
    return F.encode(reduce(lambda x, blank: F.replace(x, F.lit(blank), F.lit("")), " \t\n\x0b\x0c\r", common.text_of(column)), "UTF-8")


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(row, n, pos, block, facts): a row's n blocks, the first with doc_id, length and hash of its text."""
    body = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.char_length(common.text_of()).cast("long").alias("length"), stripped().alias("body"))
    body = body.withColumns({"n": F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(float(block_bytes))).cast("int")), "text_sha256": F.sha2("body", 256)})
    cut_up = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    return body.select("row", "n", "doc_id", "length", "text_sha256", F.posexplode(cut_up).alias("pos", "block")).select("row", "n", "pos", "block", F.when(F.col("pos") == 0, F.struct("doc_id", "length", "text_sha256")).alias("facts"))


def numbered(different: DataFrame, keys: list[str]) -> DataFrame:
    """A number for each of the different keys: its place in their order within a partition, and the partition's."""
    return different.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def hashes(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + k), F.col("block")).alias(c) for k, c in enumerate(KEYS)]


def block_names(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(key1, key2, times, name) of the different blocks, and the seed of hashes that tell them all apart."""
    names = common.cut(numbered(blocks.groupBy("block").agg(F.count("*").alias("times")), ["block"]).select(*hashes(0), "times", "name"))
    seed = 0
    while names.groupBy(*KEYS).count().where("count > 1").limit(1).count():
        seed += 1
        names = common.cut(numbered(blocks.groupBy("block").agg(F.count("*").alias("times")), ["block"]).select(*hashes(seed), "times", "name"))
    return names, seed


def attached(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], spread: str) -> DataFrame:
    """Each of ``rows`` with its ``values`` of a table (keys, times, values): one row a key, ``times`` rows have it.

    A key that many rows have is told by broadcast; in the shuffled join its rows go by ``spread``, a number of their own.
    """
    n, total = table.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    if n <= BROADCAST_NAMES:
        return rows.join(F.broadcast(table.select(*keys, *values)), keys).select(*rows.columns, *values)
    often = F.col("times") > total // max(1, BROADCAST_NAMES)
    told = lambda part, name: part.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias(name))
    same = lambda part: reduce(lambda a, b: a & b, [F.col(k) == part[f"_{k}"] for k in keys])
    hot, cold = told(table.where(often), "_hot"), told(table.where(~often), "_cold")
    marked = rows.join(F.broadcast(hot), same(hot), "left").drop(*[f"_{k}" for k in keys])
    # a told row looks for nothing: its key is its own number, which tells where it goes
    own = {f"_of_{k}": F.when(F.col("_hot").isNull(), F.col(k)).otherwise(F.col(spread)) for k in keys}
    looked = marked.withColumns(own)
    found = looked.join(cold, reduce(lambda a, b: a & b, [looked[f"_of_{k}"] == cold[f"_{k}"] for k in keys]), "left")
    return found.select(*rows.columns, *[F.coalesce(f"_hot.{v}", f"_cold.{v}").alias(v) for v in values])


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, length, text_sha256, level, name) for each row of ``docs``: two rows have the same level and name exactly if
    their texts are equal without white space."""
    blocks = blocks_of(docs, block_bytes)
    names, seed = block_names(blocks)
    named = common.cut(attached(blocks.select("row", "n", "pos", "facts", *hashes(seed)), names, KEYS, ["name"], "row").drop(*KEYS))
    level, done = 0, []
    while True:
        done.append(named.where("n = 1").select("row", "facts.*", F.lit(level).alias("level"), "name"))
        rest = named.where("n > 1")
        if not rest.limit(1).count():
            break
        half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("row", ((F.col("n") + 1) / 2).cast("int").alias("n"), (F.col("pos") / 2).cast("int").alias("pos"))
        pairs = common.cut(pairs.agg(F.max("facts").alias("facts"), half(0).alias("key1"), F.coalesce(half(1), F.lit(NO_NAME)).alias("key2")))
        names = common.cut(numbered(pairs.groupBy(*KEYS).agg(F.count("*").alias("times")), KEYS))
        named, level = common.cut(attached(pairs, names, KEYS, ["name"], "row").drop(*KEYS)), level + 1
    return reduce(DataFrame.unionByName, done)


@common.tidy
def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty and all-white texts are equal. Very long texts have more blocks and levels. Of equal texts,
    the row with the most code points stays, then that with the smallest doc_id (null last); of rows that tie in both, one stays.
    Repeated rows come out each and count each. An empty table gives none; other columns, whatever their names, aren't read.
    """
    rows = common.cut(identities(docs.select("doc_id", "text"), block_bytes), keep=True)
    first = F.min(F.struct((-F.col("length")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d")))
    groups = common.cut(rows.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("times")), keep=True)
    joined = attached(rows, groups.withColumn("group_size", F.col("times")), ["level", "name"], ["first", "group_size"], "row")
    return joined.select("doc_id", F.col("first.c").alias("keep_id"), "group_size", (F.col("row") == F.col("first.d")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return dedup(common.table(spark, sf_dir, "documents"))


#: The same rows in SQL.
ORACLE = r"""
with stripped as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
ranked as (select doc_id, body, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size, row_number() over w = 1 as kept
  from stripped window w as (partition by body order by length(text) desc, doc_id))
select doc_id, keep_id, group_size, kept, sha256(body) as text_sha256 from ranked
"""
