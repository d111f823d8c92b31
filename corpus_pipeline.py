"""The corpus pipeline: documents through quality, near-duplicate removal, decontamination and mixing, to token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremolo.llm import common, decontaminate, mixing, near_dedup, quality, wavelet

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the quality classifier accepts, by the labels of good ones."""
    return quality.accepted(docs, common.table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.deduplicated(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emit(docs).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet shards, and per document where they begin and end there."""
    import public_tokenizers

    where = common.work_dir(spark, "tokens")
    wavelet.write_shards(docs, where, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_shards(spark, where)


STAGES = [
    ("quality classifier", filter_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token shards", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder for the next."""
    docs = common.table(spark, sf_dir, "documents")
    where = common.work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{where}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{where}/{k}")
    return docs


#: Kneser-Ney training, BagMinHash classes, automata and tokenizers are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None
