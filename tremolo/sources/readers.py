"""Readers of the study's file formats; schemas are declared, not inferred."""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV in which the empty cell alone is missing: NA, null and None are text; cells may hold line ends (SRC-09, SRC-10)."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _piped(spark: SparkSession, path: str) -> DataFrame:
    """(f, _ord): a line's fields, and its place: file, block of the file, line."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.split("value", r"\|").alias("f"), place.alias("_ord"))


def rrf_names(spark: SparkSession, path: str, language: str = "ENG") -> DataFrame:
    """(cui, sab, tty, code, form, _ord): names in a language that aren't suppressed; short rows drop (SRC-01)."""
    f = F.col("f")
    rows = _piped(spark, path).where((F.size(f) > 16) & (f[1] == language) & (f[16] == "N"))
    return rows.select(f[0].alias("cui"), f[11].alias("sab"), f[12].alias("tty"), f[13].alias("code"), f[14].alias("form"), "_ord")


def rrf_types(spark: SparkSession, path: str) -> DataFrame:
    """(cui, tui, stn, sty, _ord) (SRC-02)."""
    f = F.col("f")
    return _piped(spark, path).where(F.size(f) > 3).select(f[0].alias("cui"), f[1].alias("tui"), f[2].alias("stn"), f[3].alias("sty"), "_ord")


def code_map(names: DataFrame, sab: str = "SNOMEDCT_US") -> DataFrame:
    """(code, cui): the first concept of each code of a source (SRC-03)."""
    return names.where(F.col("sab") == sab).groupBy("code").agg(F.min_by("cui", "_ord").alias("cui"))


def first_types(types: DataFrame, needed: DataFrame) -> DataFrame:
    """(cui, tui): the first type of each needed concept (SRC-04)."""
    return types.join(needed.select("cui").distinct(), "cui", "left_semi").groupBy("cui").agg(F.min_by("tui", "_ord").alias("tui"))


def pubtator(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, text, start, end, mention, types, cui): a row a mention; text is title, blank, abstract (SRC-05)."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.split(F.col("value"), "\n").alias("l"))
    grab = lambda mark: F.element_at(F.filter("l", lambda x: x.rlike(rf"^\d+\|{mark}\|")), 1)
    body = lambda mark: F.coalesce(F.regexp_replace(grab(mark), rf"^\d+\|{mark}\|", ""), F.lit(""))
    rows = blocks.where(grab("t").isNotNull()).select(F.regexp_extract(grab("t"), r"^(\d+)\|", 1).alias("pmid"), F.concat_ws(" ", body("t"), body("a")).alias("text"), F.explode(F.filter("l", lambda x: F.size(F.split(x, "\t")) >= 6)).alias("a"))
    f = F.split("a", "\t")
    return rows.select("pmid", "text", F.expr("try_cast(split(a, '\t')[1] as int)").alias("start"), F.expr("try_cast(split(a, '\t')[2] as int)").alias("end"), f[3].alias("mention"), f[4].alias("types"), F.regexp_replace(f[5], "^UMLS:", "").alias("cui"))


def standoff(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ann_id, status, codes, start, end, mention) of .ann files: a row a text-bound annotation (SRC-07).

    status is ok, multi_code, discontinuous, concept_less or malformed.
    """
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.ann$", 1).alias("doc_id"), F.split("value", "\t").alias("f")).where(F.col("f")[0].startswith("T"))
    head = F.col("f")[1]
    codes, spans = F.regexp_extract_all(head, F.lit(r"\b(\d{6,})\b(?!\s+\d+\s*$)(?=[^;]*\s)"), 1), F.regexp_extract_all(head, F.lit(r"(\d+ \d+)(?=;|$)"), 1)
    status = F.when((F.size("f") < 3) | (F.size(spans) == 0), "malformed").when(head.contains("CONCEPT_LESS"), "concept_less").when(F.size(spans) > 1, "discontinuous").when(F.size(codes) > 1, "multi_code").otherwise("ok")
    edge = lambda span, i: F.split(span, " ")[i].cast("int")
    return lines.select("doc_id", F.col("f")[0].alias("ann_id"), status.alias("status"), codes.alias("codes"), edge(F.element_at(F.when(F.size(spans) > 0, spans), 1), 0).alias("start"), edge(F.element_at(F.when(F.size(spans) > 0, spans), -1), 1).alias("end"), F.get("f", F.lit(2)).alias("mention"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a row a file (SRC-08)."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("doc_id"), F.col("value").alias("text"))


def zipped_questions(spark: SparkSession, path: str, member: str, kind: str = "factoid") -> DataFrame:
    """(id, body, answers) of questions of a kind in a JSON member of ZIP files, each read whole by one task (SRC-14).

    An exact answer may be a text, a list, or a list of lists.
    """
    def unzip(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return next(archive.read(n).decode() for n in archive.namelist() if n.endswith(member))

        return contents.map(one)

    raw = spark.read.format("binaryFile").load(path).select(F.pandas_udf(unzip, "string")("content").alias("j"))
    rows = raw.select(F.explode(F.from_json("j", "struct<questions: array<struct<id: string, body: string, type: string, exact_answer: string>>>").getField("questions")).alias("q"))
    exact = F.col("q.exact_answer")
    nested, flat = F.from_json(exact, "array<array<string>>"), F.from_json(exact, "array<string>")
    answers = F.when(exact.rlike(r"^\s*\[\s*\["), F.flatten(nested)).when(exact.rlike(r"^\s*\["), flat).otherwise(F.array(exact))
    return rows.where(F.col("q.type") == kind).select("q.id", "q.body", F.array_distinct(F.array_compact(answers)).alias("answers"))


def candidate_labels(rows: DataFrame, column: str) -> DataFrame:
    """A CUI||name label as cui and name (SRC-16)."""
    return rows.withColumns({"cui": F.regexp_replace(F.split_part(column, F.lit("||"), F.lit(1)), "^UMLS:", ""), "name": F.split_part(F.col(column), F.lit("||"), F.lit(2))})


def quoted_answers(column: str) -> Column:
    """The quoted texts of a cell that holds a printed dict or array (SRC-15)."""
    return F.filter(F.transform(F.regexp_extract_all(column, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), 0), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), lambda x: ~x.isin("text", "answer_start"))


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns of a CSV, from its first line alone (SRC-12)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


#: Parts of a path, and what each adds to its score.
CORPUS_HINTS = (("pubtator", 4), ("medmentions", 3), ("corpus", 2), ("st21pv", 2))
CORPUS_PATTERNS = ("*corpus_pubtator.txt.gz", "*pubtator*", "*corpus*", "*st21pv*", "*.txt", "*.gz")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, score) of files below a folder that may hold the corpus, likely ones first (SRC-06). Names alone are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name, low = F.element_at(F.split("path", "/"), -1), F.lower("path")
    like = [name.rlike("^" + re.escape(p).replace(r"\*", ".*") + "$") for p in CORPUS_PATTERNS]
    score = F.when(F.endswith(low, F.lit(".txt")), 1).otherwise(0)
    for hint, more in CORPUS_HINTS:
        score = score + F.when(F.contains(low, F.lit(hint)), more).otherwise(0)
    return files.where(reduce(lambda a, b: a | b, like)).select("path", score.alias("score")).orderBy(F.col("score").desc(), "path")


def cached(spark: SparkSession, where: str, make) -> DataFrame:
    """A table that is made once and read after that (SRC-17). Half a table is none: it is whole when its _SUCCESS is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)
